"""The posting pipeline and the corpus report as plans over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.enrichment import enrich
from tidemark.functions.money import annual_pay
from tidemark.functions.places import state_code
from tidemark.functions.text import fingerprint, identity
from tidemark.operators import counts, history
from tidemark.operators.lexicon import classify
from tidemark.operators.storage import stored


@dataclass(frozen=True)
class Rules:
    domain: dict[str, float]
    discipline: dict[str, float]
    exclusions: list[str] = field(default_factory=list)
    max_age_days: int = 45


def ingest(postings: DataFrame, rules: Rules, now) -> DataFrame:
    """Required fields, staleness, identity and verdict: the cheap filters come before the scoring."""
    rows = postings.where("url != '' and title != ''")
    if rules.max_age_days > 0:
        rows = rows.where(F.col("posted_at").isNull() | (F.col("posted_at") >= F.lit(now) - F.expr(f"interval {rules.max_age_days} days")))
    rows = rows.withColumn("identity", identity("source", "source_id")).withColumn("fingerprint", fingerprint("employer", "title", "location"))
    return classify(rows, "title", "description", "employer", rules.domain, rules.discipline, rules.exclusions)


def run(postings: DataFrame, seen: DataFrame, rules: Rules, now, auto_publish: bool = True) -> dict[str, DataFrame]:
    """scored, approved, review and the next seen state of a batch with a unique seq; scored is what an archive takes, duplicates included."""
    scored = ingest(postings, rules, now).where("verdict != 'reject'")
    fresh = history.filter_new(scored, seen)
    approved = fresh.where("verdict = 'publish'") if auto_publish else fresh.limit(0)
    review = fresh.where("verdict = 'review'") if auto_publish else fresh
    batch = fresh.select("identity", "fingerprint", F.lit(now).alias("seen_at"), F.col("verdict").alias("status"))
    return {"scored": scored, "approved": approved, "review": review, "state": history.mark(seen, batch)}


#: What each report of `insights` looks at of a job.
SHOWN = {
    "salary": ["salary"], "salary_by_discipline": ["salary", "disciplines"], "totals": ["employer", "salary", "posted_at"], "employers": ["employer", "disciplines", "salary", "seq"],
    "disciplines": ["disciplines", "salary"], "domains": ["domains", "salary"], **{f"{name}s": [name, "seq"] for name in ("branch", "installation", "state", "clearance", "title")},
    "certifications": ["certifications", "seq"], "remote": ["remote"], "timeline": ["posted_at"], "movement": ["posted_at"], "growth": ["employer", "posted_at"],
}


def insights(archive: DataFrame, top: int = 10, disciplines: list[str] | None = None, domains: list[str] | None = None, reports: set[str] | None = None) -> dict[str, DataFrame]:
    """Corpus reports over the newest record of each job (by fingerprint, else id, else url).

    The archive's records have seq, archived_at, posted_at, employer, title, location, remote, tags, and an enrichment struct; without one the
    newest records, and no others, are enriched from their texts (also description, compensation).  disciplines and domains are the tags that count as
    such (all of them if not given).  Of reports only those named are made, if any are: the quantiles of pay take jobs of their own, and facts
    that no named report shows aren't read from the texts.
    """
    keyed = archive.withColumn("_job", F.coalesce("fingerprint", "id", "url", F.concat(F.lit("#"), F.col("seq"))))
    e = F.col("enrichment")
    jobs = history.latest(keyed, "_job", "archived_at", "seq")
    jobs = (jobs if "enrichment" in jobs.columns else enrich(jobs)).withColumn("salary", annual_pay(e["salary_min"], e["salary_max"], e["salary_period"]))
    tags = F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower))
    among = lambda known: tags if known is None else F.array_intersect(F.array(*map(F.lit, known)).cast("array<string>"), tags)
    jobs = jobs.withColumns({
        "disciplines": among(disciplines), "domains": among(domains), "state": state_code(F.col("location")), "certifications": counts.distinct_spellings(e["certifications"]),
        "clearance": e["clearance"], "installation": e["installation"], "branch": e["service_branch"], "remote": F.coalesce("remote", F.lit(False)),
    })
    shown = set(SHOWN) if reports is None else reports
    jobs = stored(jobs.select(*sorted({c for name in shown for c in SHOWN[name]})), "jobs")
    each = lambda: jobs.select("salary", F.explode("disciplines").alias("discipline"))
    tallies = {f"{name}s": lambda name=name: counts.tally(jobs, name, "seq", top) for name in ("branch", "installation", "state", "clearance", "title")}
    made = {
        "salary": lambda: counts.amount_stats(jobs, F.col("salary")), "salary_by_discipline": lambda: counts.amount_stats(each(), F.col("salary"), "discipline"),
        "totals": lambda: archive.agg(F.count("*").alias("postings")).crossJoin(jobs.agg(  # single rows
            F.count("*").alias("jobs"), F.count_distinct(F.lower("employer")).alias("employers"), F.count("salary").alias("with_salary"), F.min("posted_at").alias("first"), F.max("posted_at").alias("last"))),
        "employers": lambda: counts.by_employer(jobs, "employer", "disciplines", "salary", "seq", top),
        "disciplines": lambda: counts.facet_share(jobs, "disciplines", "salary"), "domains": lambda: counts.facet_share(jobs, "domains", "salary").drop("median_amount"),
        **tallies, "certifications": lambda: counts.share_of_any(jobs, "certifications", "seq", top), "remote": lambda: counts.flagged_share(jobs, "remote"),
        "timeline": lambda: counts.timeline(jobs, "posted_at"), "movement": lambda: counts.month_movement(counts.timeline(jobs, "posted_at")), "growth": lambda: counts.growth(jobs, "employer", "posted_at"),
    }
    return {name: make() for name, make in made.items() if name in shown}
