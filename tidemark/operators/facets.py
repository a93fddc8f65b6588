"""Facets of postings from free text: discipline, seniority, place, contingency, employers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.places import home_pattern, overseas_pattern

#: Words that mark a senior title.
LEAD_WORDS = ["lead", "senior", "sr", "principal", "head", "chief", "director", "manager", "supervisor", "coordinator"]
LEAD = r"(?i)\b(?:" + "|".join(LEAD_WORDS) + r")\b"
#: Disciplines in the order in which they win, by label, what names them, and capitals that name them where no letter stands beside.
DISCIPLINES = [
    ("cognitive-performance", "Cognitive Performance", [r"\bcognitive performance\b", r"\bmental performance\b", r"\bperformance psycholog", r"\bsport psycholog", r"\bCPS\b", r"\bR2PC\b", r"\bmaster resilience trainer\b"], []),
    ("behavioral-health", "Behavioral Health", [r"\blicensed clinical social worker\b", r"\bbehavioral health\b", r"\bclinical psycholog", r"\bmental health (?:counselor|clinician|provider)\b", r"\bsubstance abuse counselor\b"], ["LCSW"]),
    ("nutrition", "Performance Nutrition", [r"\bdietit", r"\bdietic", r"\bnutrition"], ["RDN?"]),
    ("physical-therapy", "Physical Therapy", [r"\bphysical therap", r"\bphysiotherap", r"\bPT\s*/\s*", r"\brehabilitation specialist\b"], ["DPT"]),
    ("occupational-therapy", "Occupational Therapy", [r"\boccupational therap"], ["OTR?/?L?"]),
    ("athletic-training", "Athletic Training", [r"\bathletic train"], ["ATC"]),
    ("strength-conditioning", "Strength & Conditioning", [r"\bstrength\s*(?:and|&)\s*conditioning\b", r"\bstrength coach\b", r"\bconditioning coach\b", r"\bS\s*&\s*C\b"], ["CSCS", "TSAC(?:-F)?"]),
    ("sport-science", "Sport Science", [r"\bsports? scien", r"\bbiomechan", r"\bexercise physiolog", r"\bphysiologist\b", r"\bperformance analyst\b", r"\bkinesiolog", r"\bdata scientist\b"], []),
    ("human-performance", "Human Performance (generalist)", [r"\bhuman performance\b", r"\bperformance specialist\b", r"\bperformance coach\b", r"\bHPO\b", r"\bH2F\b", r"\bperformance expert\b", r"\bperformance advisor\b"], []),
]
#: Words of postings that wait for a contract, of awards, of checks at hiring, of posts that are paid for.
PIPELINE = (
    r"\b(?:talent (?:pool|pipeline|community)|resume (?:pool|bank)|pipeline requisition|future (?:opening|opportunit|consideration)|anticipated (?:opening|award|need|requirement)|"
    r"pending (?:contract )?award|proposal (?:effort|pending)|not yet awarded|should we be awarded|if awarded|upon award|pre-?award|expression of interest)\b"
    r"|\bcontingen(?:t|cy) (?:posting|position|role|opening|requisition|opportunit|vacanc|job|listing|hire|hiring|billet|seat|award)"
)
CONTINGENT = r"\bcontingen(?:t|cy)\b"
AWARD = (
    r"\b(?:award|contract|task order|re-?compete|recompete|proposal|bid|funding|funded|solicitation|RFP|capture|win|program start|vacancy|headcount|position availability|billet)\b"
)
ONBOARDING = (
    r"\b(?:background|drug|screen|physical exam|reference|E-?Verify|I-?9|credential|licensure|fingerprint|medical exam|security clearance adjudicat|successful completion)\b"
)
FUNDED = (
    r"\b(?:currently funded|fully funded|funded (?:position|requisition|seat|billet)|immediate (?:fill|hire|opening|need)|position is (?:open|active)|active contract|awarded contract|"
    r"contract has been awarded)\b"
)
#: Remote work, and what denies it.
REMOTE = r"(?i)\b(?:remote|work\s+from\s+home|telework|telecommut|virtual|anywhere)\b"
NOT_REMOTE = r"(?i)\b(?:not\s+remote|no\s+remote|remote\s+work\s+is\s+not|non-remote|cannot\s+be\s+performed\s+remotely)\b"
#: Legal forms that end a company's name.
LEGAL_SUFFIXES = ["inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "plc", "lp", "llp"]
HEAD_CHARS = 400


def _spaced(pattern: str) -> str:
    """A pattern whose spaces stand for any white space."""
    return pattern.replace(" ", r"\s+")


def _apart(pattern: str) -> str:
    return f"(?<![A-Za-z])(?:{pattern})(?![A-Za-z])"


def first_class(title: Column, body: Column, classes: list[tuple[str, list[str]]]) -> Column:
    """The first class with a pattern in the title, else in the body's first 400 characters; null if none.  classes: (name, patterns) in order."""
    out = F.lit(None).cast("string")
    for text in (title, F.substring(F.coalesce(body, F.lit("")), 1, HEAD_CHARS)):
        for name, patterns in classes:
            out = F.coalesce(out, F.when(text.rlike("(?i)" + "|".join(patterns)), F.lit(name)))
    return out


def discipline(title: Column, description: Column) -> Column:
    """The slug of the first discipline named in the title, else in the description's first 400 characters, else `other`."""
    classes = [(slug, [*map(_spaced, patterns), *map(_apart, capitals)]) for slug, _, patterns, capitals in DISCIPLINES]
    return F.coalesce(first_class(F.coalesce(title, F.lit("")), description, classes), F.lit("other"))


def discipline_label(slug: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for slug_, label, _, _ in DISCIPLINES for x in (slug_, label))), slug), F.lit("Other"))


def contingency_of(*texts: Column) -> Column:
    """contingent, funded or unknown, by the words of fixed values over all texts."""
    joined = F.concat_ws("\n", *(F.nullif(t, F.lit("")) for t in texts))
    return contingency(joined, *(_spaced(p) for p in (PIPELINE, CONTINGENT, AWARD, ONBOARDING, FUNDED)))


def salary_floor(low: Column, high: Column, period: Column) -> Column:
    """The lower bound, else the upper, a year; hourly pay at 2080 hours; null for other periods."""
    worth = F.coalesce(low, high).cast("double")
    return F.when(F.lower(period).startswith("hour"), worth * 2080).when(F.lower(period).startswith("year") | F.lower(period).startswith("annual"), worth)


def facets(df: DataFrame) -> DataFrame:
    """Postings (title, description, location, remote, compensation, enrichment) with a struct column `facets`: discipline, discipline_label, lead, location_classes, contingency, salary_floor_annual."""
    found = discipline(F.col("title"), F.col("description"))
    pay = F.col("enrichment")
    values = {
        "discipline": found, "discipline_label": discipline_label(found), "lead": is_lead(F.col("title")),
        "location_classes": location_classes(F.col("location"), F.col("remote"), overseas_pattern(), home_pattern()),
        "contingency": contingency_of(F.col("title"), F.col("description"), F.col("compensation")), "salary_floor_annual": salary_floor(pay["salary_min"], pay["salary_max"], pay["salary_period"]),
    }
    return df.withColumn("facets", F.struct(*(v.alias(k) for k, v in values.items())))


def is_lead(title: Column) -> Column:
    return F.coalesce(title.rlike(LEAD), F.lit(False))


def location_classes(location: Column, remote: Column, overseas: str, home: str) -> Column:
    """Sorted classes of a place: conus, oconus, remote.  overseas and home are patterns."""
    text = F.coalesce(location, F.lit(""))
    is_remote = F.coalesce(remote, F.lit(False)) | (text.rlike(REMOTE) & ~text.rlike(NOT_REMOTE))
    return F.array_compact(F.array(F.when(text.rlike(home), F.lit("conus")), F.when(text.rlike(overseas), F.lit("oconus")), F.when(is_remote, F.lit("remote"))))


def contingency(text: Column, pipeline: str, word: str, award: str, onboarding: str, funded: str, window: int = 80) -> Column:
    """contingent, funded or unknown.  After each `word` the next `window` characters are read: onboarding language passes over it, award language decides."""
    after = F.regexp_extract_all(text, F.lit(rf"(?is){word}(?=(.{{0,{window}}}))"), 1)
    hit = F.exists(after, lambda w: ~w.rlike("(?i)" + onboarding) & w.rlike("(?i)" + award))
    return F.when(text.rlike("(?i)" + pipeline) | F.coalesce(hit, F.lit(False)), "contingent").when(text.rlike("(?i)" + funded), "funded").otherwise("unknown")


def strict_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def loose_key(name: Column) -> Column:
    """The strict key without a leading `the` and trailing legal forms."""
    bare = F.regexp_replace(strict_key(name), "^the ", "")
    return F.regexp_replace(bare, "( (" + "|".join(LEGAL_SUFFIXES) + "))+$", "")


def match_employers(df: DataFrame, employer: str, registry: DataFrame, name: str, order: str, most: int = 100_000) -> DataFrame:
    """df with `registered`: the registry's name for an employer by strict key, else by loose key; the first registered wins a key."""
    small = registry.count() <= most
    hint = F.broadcast if small else (lambda x: x)
    out = df
    for key, label in ((strict_key, "_strict"), (loose_key, "_loose")):
        index = registry.select(key(F.col(name)).alias(label), F.col(order).alias("_o"), F.col(name).alias("_n")).where(F.col(label) != "")
        index = index.groupBy(label).agg(F.min_by("_n", "_o").alias(f"{label}_name"))
        out = out.withColumn(label, key(F.col(employer))).join(hint(index), label, "left")
    return out.withColumn("registered", F.coalesce("_strict_name", "_loose_name")).drop("_strict", "_loose", "_strict_name", "_loose_name")
