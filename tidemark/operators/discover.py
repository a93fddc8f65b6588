"""Candidates mined from text: domains, capitalised runs, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mined(df: DataFrame, text: str, pattern: str, least: int = 2, known: DataFrame | None = None, group: int = 0) -> DataFrame:
    """value, mentions, documents of a pattern's matches over all texts; those below `least` mentions or in `known` (value) left out."""
    found = df.select(F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all(F.col(text), F.lit(pattern), group).alias("_all"))
    per_row = found.select("_row", F.explode("_all").alias("value")).groupBy("value", "_row").agg(F.count("*").alias("_n"))
    out = per_row.groupBy("value").agg(F.sum("_n").alias("mentions"), F.count("*").alias("documents")).where(F.col("mentions") >= least)
    return out if known is None else out.join(known.select("value"), "value", "left_anti")


def domains(df: DataFrame, text: str, least: int = 1) -> DataFrame:
    return mined(df, text, r"https?://(?:www\.)?([a-z0-9.-]+\.[a-z]{2,})", least, group=1)


def acronyms(df: DataFrame, text: str, least: int = 2, known: DataFrame | None = None) -> DataFrame:
    return mined(df, text, r"\b([A-Z]{2,6}[0-9]?)\b", least, known, group=1)


def capital_runs(df: DataFrame, text: str, least: int = 2, known: DataFrame | None = None) -> DataFrame:
    return mined(df, text, r"\b([A-Z][a-z]+(?: [A-Z][a-z]+)+)\b", least, known, group=1)
