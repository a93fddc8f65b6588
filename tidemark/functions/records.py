"""Fields of JSON records whose keys and shapes vary: normalised keys, display texts, envelopes, titles that hold more than a title."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.places import STATES

#: Keys under which a wrapped value shows its text, and under which a payload keeps its listings, in order.
DISPLAY_KEYS = ["name", "value", "label", "text", "title", "display", "href", "url", "link"]
ENVELOPE_KEYS = ["results", "jobs", "items", "listings", "postings", "records", "rows", "joblist", "searchresults", "data", "d", "content"]
#: Words of roles, which tell a title from an employer.
ROLES = (
    "coach coaches trainer trainers therapist therapists dietitian dietician nutritionist physiologist psychologist specialist scientist analyst director manager coordinator supervisor "
    "instructor educator intern internship fellow fellowship assistant associate consultant practitioner technician technologist researcher clinician physician nurse chiropractor counselor "
    "counsellor lead officer aide apprentice resident preceptor"
).split()


def normal_key(c: Column) -> Column:
    """A key without case and marks: jobTitle, job_title and Job-Title are one."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def index(record: Column) -> Column:
    """A JSON object as a map from normalised keys to texts or JSON; of keys that become one the first stays.  Anything else is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    entries = F.map_entries(F.coalesce(F.from_json(F.when(F.ltrim(record).startswith("{"), record), "map<string,string>"), empty))
    keys = F.transform(entries, lambda e: normal_key(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(keys, normal_key(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(normal_key(e["key"]).alias("key"), e["value"].alias("value"))))


def flat(value: Column, depth: int = 2) -> Column:
    """The text of a JSON value: itself, an object's first display key, a list's texts with commas between; booleans and null are empty."""
    text = F.trim(F.coalesce(value, F.lit("")))
    plain = F.when(text.isin("true", "false", "null"), "").otherwise(text)
    if not depth:
        return F.when(text.startswith("{") | text.startswith("["), "").otherwise(plain)
    held = index(value)
    shown = F.transform(F.array(*map(F.lit, DISPLAY_KEYS)), lambda k: flat(F.element_at(held, k), depth - 1))
    shown = F.coalesce(F.try_element_at(F.filter(shown, lambda x: x != ""), F.lit(1)), F.lit(""))
    listed = F.array_join(F.filter(F.transform(F.from_json(text, "array<string>"), lambda x: flat(x, depth - 1)), lambda x: x != ""), ", ")
    return F.when(text.startswith("["), F.coalesce(listed, F.lit(""))).when(text.startswith("{"), shown).otherwise(plain)


def pick_field(record: Column, *candidates: str, depth: int = 2) -> Column:
    """Text of the first candidate key that has any, keys compared as normal_key does; empty for none."""
    held = index(record)
    texts = F.transform(F.array(*(F.element_at(held, "".join(c for c in k.lower() if c.isascii() and c.isalnum())) for k in candidates)), lambda x: flat(x, depth))
    return F.coalesce(F.try_element_at(F.filter(texts, lambda x: x != ""), F.lit(1)), F.lit(""))


def envelope(payload: Column, depth: int = 2) -> Column:
    """The rows of a payload, as JSON texts: a list itself; the first list with rows under a known key; else what its objects hold, to the depth."""
    empty = F.array().cast("array<string>")
    rows = F.from_json(F.when(F.ltrim(payload).startswith("["), payload), "array<string>")
    held = index(payload)
    lists = F.transform(F.array(*(F.element_at(held, k) for k in ENVELOPE_KEYS)), lambda x: F.coalesce(F.from_json(F.when(F.ltrim(x).startswith("["), x), "array<string>"), empty))
    found = F.try_element_at(F.filter(lists, lambda x: F.size(x) > 0), F.lit(1))
    if depth:
        nested = F.transform(F.filter(F.map_values(held), lambda x: F.ltrim(x).startswith("{")), lambda x: envelope(x, depth - 1))
        found = F.coalesce(found, F.try_element_at(F.filter(nested, lambda x: F.size(x) > 0), F.lit(1)))
    return F.coalesce(rows, found, empty)


def looks_like_place(text: Column) -> Column:
    """A label of remote work, or a comma and a state behind it."""
    bare = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\.+$", ""))
    tail = F.trim(F.regexp_extract(F.regexp_replace(bare, r"(?i),?\s*(?:USA?|United States)$", ""), r",([^,]*)$", 1))
    state = F.upper(tail).isin(*STATES.values()) | F.lower(tail).isin(*STATES)
    return (F.length(bare) <= 80) & (state | F.lower(bare).rlike(r"^(?:fully )?(?:remote|virtual|work from home|telework|anywhere)\b[^,]{0,30}$"))


def _has_role(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.arrays_overlap(words, F.array(*map(F.lit, ROLES)))


def listing_title(text: Column) -> Column:
    """struct(title, employer, location) of a listing's title: `Role - Employer - Place`, `Role at Employer (Place)`, `Employer: Role (Place)`.

    Each step is optional, a plain title stays.  A colon splits only where a role is behind it and none before it.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return _let(_let(_let(raw, _placed), _parted), _titled)


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _placed(raw: Column) -> Column:
    """rest and place: a title without the place in brackets at its end."""
    inside = F.trim(F.regexp_extract(raw, r"\(([^()]+)\)\s*$", 1))
    found = (inside != "") & looks_like_place(inside)
    return F.struct(F.when(found, F.trim(F.regexp_replace(raw, r"\([^()]+\)\s*$", ""))).otherwise(raw).alias("rest"), F.when(found, inside).otherwise("").alias("place"))


def _parted(x: Column) -> Column:
    """kept and place: the parts between dashes, without a place at their end."""
    parts = F.filter(F.transform(F.split(x["rest"], r"\s+[-–—|]\s+"), lambda p: F.trim(p)), lambda p: p != "")

    def cut(parts: Column) -> Column:
        last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
        behind = (x["place"] == "") & (F.size(parts) >= 2) & looks_like_place(last)
        return F.struct(F.when(behind, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts).alias("kept"), F.when(behind, last).otherwise(x["place"]).alias("place"), x["rest"].alias("rest"))

    return _let(parts, cut)


def _titled(x: Column) -> Column:
    first = F.struct(
        F.coalesce(F.try_element_at(x["kept"], F.lit(1)), x["rest"]).alias("title"),
        F.when(F.size(x["kept"]) > 1, F.array_join(F.slice(x["kept"], F.lit(2), F.size(x["kept"]) - 1), " - ")).otherwise("").alias("employer"),
    )

    def split(y: Column) -> Column:
        title, employer = y["title"], y["employer"]
        head, tail = F.trim(F.regexp_extract(title, r"^([^:]*):", 1)), F.trim(F.regexp_extract(title, r"^[^:]*:(.*)$", 1))
        colon = (employer == "") & (head != "") & (tail != "") & _has_role(tail) & ~_has_role(head)
        role, where = (F.trim(F.regexp_extract(title, r"(?i)^(.+?)\s+(?:at|@)\s+(.+)$", k)) for k in (1, 2))
        at = (employer == "") & ~colon & (where != "") & (F.size(F.split(where, " ")) <= 10)
        return F.struct(
            F.when(colon, tail).when(at, role).otherwise(title).alias("title"), F.when(colon, head).when(at, where).otherwise(employer).alias("employer"), x["place"].alias("location"),
        )

    return _let(first, split)


def board_slugs(name: Column) -> Column:
    """Names under which a company's board may lie: hyphenated, joined, joined with its capitals (if any is within), its first word; no repeats."""
    text = F.trim(F.coalesce(name, F.lit("")))
    hyphens = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cased = F.regexp_replace(text, "[^A-Za-z0-9]+", "")
    found = F.array(hyphens, F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), F.when(cased.rlike("^.+[A-Z]"), cased), F.substring_index(hyphens, "-", 1))
    return F.array_distinct(F.filter(found, lambda x: F.coalesce(x, F.lit("")) != ""))


def any_of(text: Column, parts: list[str]) -> Column:
    """Whether a text, in small letters, holds any of the parts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in parts), F.lit(False))


def included(url: Column, include: list[str], exclude: list[str]) -> Column:
    """URLs with any of the fragments to include (all if none is given) and none of those to exclude."""
    held = lambda parts: reduce(lambda a, b: a | b, (F.contains(url, F.lit(p)) for p in parts), F.lit(False))
    return (held(include) if include else F.lit(True)) & ~held(exclude)
