"""Boards, feeds and review queues as tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.enrichment import enrich
from tidemark.functions.text import excerpt, feed_id
from tidemark.operators.facets import facets

#: Kinds of sources that are a publisher's own, rows of an RSS feed, characters of an excerpt.
FIRST_PARTY = [
    "workday", "greenhouse", "lever", "ashby", "workable", "smartrecruiters", "recruitee", "bamboohr", "breezy", "personio", "rippling", "icims", "taleo", "successfactors", "phenom",
    "jsonld", "governmentjobs", "usajobs",
]
RSS_ROWS, EXCERPT = 50, 400
#: Marks of the old feed and what they are called now.
OLD_MARKS = {"verified": "verified", "high": "listed", "high confidence": "listed", "aggregator": "aggregator"}


def public(df: DataFrame) -> DataFrame:
    """The published columns: ids, rounded score, sorted tags, excerpt."""
    return df.withColumn("score", F.round("score", 2)).withColumn("tags", F.array_sort(F.array_distinct("tags"))).withColumn("description", excerpt("description", EXCERPT))


def confidence(df: DataFrame, state: str = "state", legacy: str = "validity", source: str = "source", ident: str = "id") -> DataFrame:
    """df with confidence: a live page is verified; a row of the old feed (a validity mark and no id) goes by its mark; a first-party source is listed; all else is from an aggregator."""
    mark = F.element_at(F.create_map(*(F.lit(x) for pair in OLD_MARKS.items() for x in pair)), F.lower(legacy))
    first_party = F.lower(F.coalesce(F.col(source), F.lit(""))).rlike("^(?:" + "|".join(FIRST_PARTY) + ")")
    old = F.when(F.col(legacy).isNotNull() & F.col(ident).isNull(), F.coalesce(mark, F.lit("aggregator")))
    return df.withColumn("confidence", F.when(F.col(state) == "live", "verified").otherwise(F.coalesce(old, F.when(first_party, "listed"), F.lit("aggregator"))))


#: Columns that a feed row may have; those that it lacks are null.
FEED_COLUMNS = {
    "id": "string", "url": "string", "title": "string", "employer": "string", "location": "string", "description": "string", "remote": "boolean", "compensation": "string", "source": "string",
    "validity": "string", "notes": "string", "salary": "string", "program": "string", "state": "string", "rank": "double", "listed_at": "string",
}


def feed_rows(df: DataFrame) -> DataFrame:
    """Feed rows of the old shape (a validity mark, no id) and of the new in one shape, with enrichment, facets and confidence derived anew.

    An old row's description is its notes, salary and programme, its id comes from url and title, its source is `legacy`.  What is
    published as compensation is the salary, else the compensation; as program the row's own, else the one that its text names.
    """
    rows = df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in FEED_COLUMNS.items()))
    old = F.col("validity").isNotNull() & F.col("id").isNull()
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = F.concat_ws("\n", *(F.nullif(empty(c), F.lit("")) for c in ("notes", "salary", "program")))
    rows = confidence(rows).withColumn("_old", old)
    rows = rows.withColumns({
        "description": F.when(old, said).otherwise(empty("description")), "_pay": F.when(old, F.nullif("salary", F.lit(""))).otherwise(F.col("compensation")),
        "source": F.when(old, F.lit("legacy")).otherwise(empty("source")), "id": F.when(old, feed_id("url", "title")).otherwise(F.col("id")),
        "remote": F.when(old, F.lit(False)).otherwise(F.coalesce("remote", F.lit(False))), "_shown": F.coalesce(F.nullif("salary", F.lit("")), "compensation"),
        **{c: empty(c) for c in ("url", "title", "employer", "location", "notes")},
    })
    rows = facets(enrich(rows.withColumn("compensation", F.col("_pay"))))
    rows = rows.withColumn("program", F.coalesce(F.nullif("program", F.lit("")), "enrichment.program")).withColumn("compensation", F.col("_shown"))
    return rows.drop("_old", "_pay", "_shown", "validity", "salary")


def rss(board: DataFrame, rows: int = RSS_ROWS) -> DataFrame:
    """item: one RSS element a row of the board's newest, escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    top = board.orderBy(F.desc("listed_at"), F.desc("score"), "id").limit(rows)
    item = F.format_string("<item><title>%s</title><link>%s</link><guid isPermaLink=\"false\">%s</guid><description>%s</description></item>", esc("title"), esc("url"), esc("id"), esc("description"))
    return top.select("id", item.alias("item"))


def review_queue(df: DataFrame) -> DataFrame:
    """line: one Markdown line a row, the highest score first."""
    return df.orderBy(F.desc("score"), "id").select("id", F.format_string("- [ ] **%s** (%s) %.1f %s", F.col("title"), F.col("employer"), F.col("score"), F.col("url")).alias("line"))
