"""Exact duplicates: frequent digests by Misra-Gries, their verified winners broadcast, all other digests shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.work import unused, written

#: Counters of a Misra-Gries summary: every digest of more than one row in COUNTERS + 1 is found.
COUNTERS = 1024
#: Summaries that one task merges at a time.
FAN_IN = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z in lower case, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), 256))


def reduced(rows: pa.Table, counters: int) -> pa.Table:
    """(digest, n) summed by digest; of more than `counters` digests all lose the next largest count, and those left with nothing go."""
    rows = rows.group_by("digest").aggregate([("n", "sum")]).rename_columns(["digest", "n"])
    if rows.num_rows <= counters:
        return rows
    n = rows["n"].to_numpy()
    n = n - np.partition(n, -(counters + 1))[-(counters + 1)]
    return pa.table({"digest": rows["digest"], "n": n}).filter(pa.array(n > 0))


def _summaries(counters: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.table({"digest": batch.column("digest"), "n": batch.column("n")})
            held = reduced(rows if held is None else pa.concat_tables([held, rows]), counters)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return summarise


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, n) with at most `counters` rows, among them every digest of more than one row in counters + 1; n is a lower bound.

    Each task keeps one summary; summaries meet in tasks of at most FAN_IN of them until one is left, so no task holds
    more than one summary and a batch.  A null digest counts as a value.
    """
    schema = "digest binary, n long"
    out = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(_summaries(counters), schema)
    out = written(out.withColumn("part", F.spark_partition_id()), "frequent")
    parts = out.select("part").distinct().count()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        out = out.repartition(parts, F.floor(F.col("part") / FAN_IN)).select("digest", "n").mapInArrow(_summaries(counters), schema)
        out = written(out.withColumn("part", F.spark_partition_id()), "frequent")
    return out.select("digest", "n")


def _placed(digests: DataFrame, counters: int) -> DataFrame:
    """digests (id, digest, row) with keep_id, group_size and kept."""
    least = max(2, digests.count() // (counters + 1))
    candidates = F.broadcast(frequent_digests(digests, counters).select("digest"))
    found = digests.join(candidates, "digest").groupBy("digest").agg(
        F.count("*").alias("group_size"), F.max("id").alias("keep_id"), F.coalesce(F.max_by("row", "id"), F.max("row")).alias("winner")
    )
    # At most one row a counter, so the broadcast is bounded.
    winners = F.broadcast(written(found.where(F.col("group_size") >= least), "winners"))
    columns = ["id", "digest", "row", "keep_id", "group_size", "kept"]
    heavy = digests.join(winners, "digest").withColumn("kept", F.col("row") == F.col("winner")).select(*columns)
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())
    rest = digests.join(winners.select("digest"), "digest", "left_anti")
    rest = rest.withColumns({
        "keep_id": F.first("id").over(order), "group_size": F.count("*").over(group), "kept": F.row_number().over(order) == 1,
    })
    return heavy.unionByName(rest.select(*columns))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size (long), kept, text_sha256 (of the normalised text, lower-case hex).

    Texts are equal when identical after lower-casing A-Z only.  Of equal texts the row with the largest id stays;
    keep_id is that id and group_size the number of equal rows.

    Digests are worked out once and written; texts are never shuffled.  Misra-Gries summaries, merged by a tree of
    tasks, name every digest of more than one row in counters + 1.  Their exact counts and largest ids, added up before
    they are shuffled, make a table of at most `counters` winners; it is broadcast, so rows of a frequent text are decided
    where they are read.  All other digests are shuffled, each group at most that share of the rows.

    Defined cases: a null text counts as an empty one, and all of these are equal.  Null ids come before all others, so
    they stay only in a group of nothing else (keep_id is then null).  Of rows that repeat the largest id exactly one is kept.
    Extra columns are ignored, whatever their names.  Texts of any length are hashed whole.  Empty in, empty out.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text_col}`")).alias("digest"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    out = _placed(rows, counters)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest id, all columns as they are.

    Cases are those of exact_duplicates.  The rows are written once with a number of their own; frequent texts go where they
    are read, others by a join of row numbers.
    """
    (row,) = unused(docs.columns, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keys = rows.select(F.col(f"`{id_col}`").alias("id"), digest(F.col(f"`{text_col}`")).alias("digest"), F.col(row).alias("row"))
    gone = _placed(written(keys, "digests"), counters).where(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
