"""Documents with a header block: parsing, lint, routing, rendering, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Header fields that must be there, sections that should, and words a body should have.
REQUIRED, RECOMMENDED, LEAST_WORDS = ["name", "description", "color"], ["Identity", "Core Mission", "Critical Rules"], 50
#: Section titles of the first part.
SOUL = r"identity|learning.*memory|communication|style|critical.rule|rules.you.must.follow"
#: Named colours, and that of anything else.
COLOURS = {
    "cyan": "#00FFFF", "blue": "#3498DB", "green": "#2ECC71", "red": "#E74C3C", "purple": "#9B59B6", "orange": "#F39C12", "teal": "#008080", "indigo": "#6366F1",
    "pink": "#E84393", "gold": "#EAB308", "amber": "#F59E0B", "neon-green": "#10B981", "neon-cyan": "#06B6D4", "metallic-blue": "#3B82F6", "yellow": "#EAB308",
    "violet": "#8B5CF6", "rose": "#F43F5E", "lime": "#84CC16", "gray": "#6B7280", "fuchsia": "#D946EF",
}
GREY = "#6B7280"


def header(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)


def field(text: Column, name: str) -> Column:
    """A header field's text, quotes off; empty if not there."""
    return F.regexp_replace(F.trim(F.regexp_extract(header(text), rf"(?m)^{name}:[ \t]*(.*)$", 1)), "^[\"']|[\"']$", "")


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\z)", "")


def parse(df: DataFrame, text: str, path: str) -> DataFrame:
    """slug, division, name, description, color, emoji, vibe, body of each document."""
    t, p = F.col(text), F.col(path)
    return df.select(
        F.regexp_extract(p, r"([^/]+)\.md$", 1).alias("slug"), F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("division"),
        *(field(t, c).alias(c) for c in (*REQUIRED, "emoji", "vibe")), body(t).alias("body"), p.alias("source_path"),
    )


def lint(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, level, rule: one row a finding.  Carriage returns, a missing fence and missing fields are errors; sections and length are warnings."""
    t = F.coalesce(F.col(text), F.lit(""))
    crlf, fenced = F.contains(t, F.lit("\r")), header(t) != ""
    sound = ~crlf & fenced
    found = [F.when(crlf, F.struct(F.lit("error").alias("level"), F.lit("crlf").alias("rule"))), F.when(~crlf & ~fenced, F.struct(F.lit("error").alias("level"), F.lit("fence").alias("rule")))]
    found += [F.when(sound & (field(t, c) == ""), F.struct(F.lit("error").alias("level"), F.lit(f"missing {c}").alias("rule"))) for c in REQUIRED]
    found += [F.when(sound & ~F.contains(F.lower(body(t)), F.lit(s.lower())), F.struct(F.lit("warning").alias("level"), F.lit(f"section {s}").alias("rule"))) for s in RECOMMENDED]
    words = F.size(F.filter(F.split(body(t), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    found.append(F.when(sound & (words < LEAST_WORDS), F.struct(F.lit("warning").alias("level"), F.lit("short").alias("rule"))))
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.level", "f.rule")


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, title, part (soul or agents), content of each `## ` section; what stands before the first has no title."""
    pieces = F.split(body(F.coalesce(F.col(text), F.lit(""))), r"(?m)^(?=## )")
    rows = df.select(F.col(key), F.posexplode(pieces).alias("at", "content"))
    title = F.trim(F.regexp_extract("content", r"\A## ([^\n]*)", 1))
    return rows.select(key, "at", title.alias("title"), F.when(F.lower(title).rlike(SOUL), "soul").otherwise("agents").alias("part"), "content").where("content != ''")


def normal_colour(c: Column) -> Column:
    """#RRGGBB from a name or six hex digits; grey for anything else."""
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = F.element_at(F.create_map(*(F.lit(x) for pair in COLOURS.items() for x in pair)), low)
    digits = F.regexp_extract(low, "^#?([0-9a-f]{6})$", 1)
    return F.coalesce(named, F.when(digits != "", F.concat(F.lit("#"), F.upper(digits))), F.lit(GREY))


def render(df: DataFrame, template: str, *columns: str) -> DataFrame:
    """slug and content from a format string."""
    return df.select("slug", F.format_string(template, *(F.coalesce(F.col(c), F.lit("")) for c in columns)).alias("content"))


def roster(df: DataFrame, by: str, line: Column, order: str) -> DataFrame:
    """One text a group, a line a row, in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(by).agg(lines.alias("_l")).select(by, F.array_join(F.transform("_l", lambda x: x["l"]), "\n").alias("content"))


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and side: keys of one side that the other lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def selected(df: DataFrame, divisions: list[str], slugs: list[str], names: list[str], division: str = "division", slug: str = "slug") -> DataFrame:
    """Rows of the divisions, and rows with the slugs or with names of a list that slugify to theirs; all rows if nothing is asked for.  Of names a # and what follows is dropped."""
    if not (divisions or slugs or names):
        return df
    wanted = {"".join(c if c.isascii() and c.isalnum() else "-" for c in x.split("#")[0].strip().lower()).strip("-") for x in [*slugs, *names]} - {""}
    wanted = {"-".join(p for p in x.split("-") if p) for x in wanted}
    return df.where(F.col(division).isin(*divisions) | F.col(slug).isin(*wanted))


def translated(df: DataFrame, translations: DataFrame, name: str = "name") -> DataFrame:
    """Rows with a translation (name, translated) of their name, with it; of several the first in order of itself."""
    return df.join(translations.groupBy(name).agg(F.min("translated").alias("translated")), name)
