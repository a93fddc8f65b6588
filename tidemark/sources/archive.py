"""Archives of JSON lines: a true sequence over files, lines of any shape, and what can't be read counted instead of fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ranks import numbered


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, seq (from 0, over all files by name and place) and text of every line that isn't blank.

    A line's place is its split's first byte and its place within; only counts of ranges are added up for seq, so files may be
    of any size, and seq is the same however they are split.
    """
    read = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), F.col("value").alias("text")
    )
    placed = numbered(read.where(F.trim("text") != "").withColumn("_all", F.lit(0)), "_all", ["file", "_block", "_row"], tree="_tree", pos="seq", n="_n")
    return placed.select("file", "seq", "text")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """file, seq, text, whether the line is whole, and `record` by the schema; null for a line that isn't a JSON object.

    A field that a line lacks, or holds in a shape that doesn't fit, is null; a string field takes an object or a list as its JSON text.
    Fields that the schema doesn't name are left out.
    """
    whole = F.coalesce(F.get_json_object("text", "$").startswith("{"), F.lit(False))
    return rows.withColumns({"whole": whole, "record": F.when(whole, F.from_json("text", schema, {"mode": "PERMISSIVE"}))})


def read(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """seq and the schema's columns of every line that is whole: broken lines and a tail cut off in writing are passed over, and leave their seq unused.

    With operators.history.revisions over seq it gives what changed, in the order of writing.
    """
    return parsed(lines(spark, path), schema).where("whole").select("seq", "record.*")


def faults(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, lines, broken (lines that are no whole JSON objects) and cut_off: whether the file's last line is one of them."""
    rows = parsed(lines(spark, path), "_none string")
    last = F.max_by(~F.col("whole"), "seq")
    return rows.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(~F.col("whole")).alias("broken"), last.alias("cut_off"))
