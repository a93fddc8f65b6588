"""Ranked lexical search, look-up, and filters that keep the unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import rounded
from tidemark.operators.storage import spread

#: Characters of a body that are searched; worth of a whole-query hit, of a token in the name and in the description; limits.
BODY_CHARS, PHRASE, IN_NAME, IN_DESCRIPTION = 8000, 5.0, 3.0, 1.5
DEFAULT_LIMIT, MOST_LIMIT = 8, 25


def query_tokens(query: str) -> list[str]:
    return sorted(set("".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()))


def rank(df: DataFrame, query: str, name: str, description: str, body: str, extra: tuple[str, ...] = (), order: tuple[str, ...] = (), limit: int = DEFAULT_LIMIT, where: Column | None = None) -> DataFrame:
    """df's best rows for a query, with score: tokens shared, plus 5 for the whole query, 3 for each token in the name,
    1.5 in the description, and 1 over the root of the distinct tokens of a row that scores.  Limited to 1 to 25."""
    tokens = query_tokens(query)
    rows = spread(df if where is None else df.where(where))
    text = F.lower(F.concat_ws("\n", *(F.coalesce(F.col(c), F.lit("")) for c in (name, description, *extra)), F.substring(F.coalesce(F.col(body), F.lit("")), 1, BODY_CHARS)))
    rows = rows.withColumn("_text", text)
    held = F.array_distinct(F.filter(F.split(F.regexp_replace("_text", "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    rows = rows.withColumn("_held", held)
    zero = F.lit(0.0)
    wanted = F.array(*map(F.lit, tokens)).cast("array<string>")
    score = F.size(F.array_intersect("_held", wanted)).cast("double") + F.when(F.contains("_text", F.lit(query.strip().lower())), PHRASE).otherwise(zero)
    for column, worth in ((name, IN_NAME), (description, IN_DESCRIPTION)):
        low = F.lower(F.coalesce(F.col(column), F.lit("")))
        score = reduce(lambda s, t: s + F.when(F.contains(low, F.lit(t)), worth).otherwise(zero), tokens, score)
    rows = rows.withColumn("_raw", score).where("_raw > 0")
    rows = rows.withColumn("score", rounded(F.col("_raw") + 1 / F.sqrt(F.greatest(F.size("_held"), F.lit(1)).cast("double")), 6)).drop("_text", "_held", "_raw")
    return rows.orderBy(F.desc("score"), *order).limit(min(max(limit, 1), MOST_LIMIT))


def lookup(df: DataFrame, key: str, slug: str, name: str, order: str) -> DataFrame:
    """The first row whose slug is the key or whose name is, whatever the case."""
    return df.where((F.col(slug) == key) | (F.lower(name) == key.lower())).orderBy(order).limit(1)


def tag_filter(df: DataFrame, tags: list[str], text: str, tag_col: str, columns: list[str]) -> DataFrame:
    """Rows with any of the tags (all if none given) and the text in any of the columns or tags."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns), F.array_join(tag_col, " ")))
    out = df.where(F.contains(hay, F.lit(text.lower()))) if text else df
    return out.where(F.arrays_overlap(tag_col, F.array(*map(F.lit, tags)))) if tags else out


def facet_filter(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose facet is one of the values, or unknown: a filter never hides what isn't known."""
    return df.where(F.col(column).isin(*values) | F.col(column).isNull() | (F.col(column) == "unknown"))
