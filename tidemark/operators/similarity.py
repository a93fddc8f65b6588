"""Shingle similarity of candidates against a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import wordhash
from tidemark.functions.money import rounded
from tidemark.operators.storage import BROADCAST_ROWS, small_or_not, spread, stored

#: Shares at which a best match fails or warns.
FAIL, WARN = 0.40, 0.20


def shingle_text(text: Column, entities: list[str] | None = None) -> Column:
    """Lower case, header and named entities out, all but a-z and 0-9 as single spaces."""
    body = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)\A---.*?---", ""))
    if entities:
        body = F.regexp_replace(body, r"\b(" + "|".join(entities) + r")\b", " ")
    return F.regexp_replace(body, "[^a-z0-9]+", " ")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, k: int = 8, entities: list[str] | None = None) -> DataFrame:
    """id and the hashes of its distinct k-word shingles, one row a text: stored, so texts are cut and hashed once, by whole batches."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, data, offsets in wordhash.blocks(batch.column(1)):
                w = wordhash.split_words(data, offsets)
                rolled = wordhash.rolling_hashes(wordhash.word_hashes(w), k)
                sets = [np.unique(rolled[a : max(a, b - k + 1)]) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, past - first), wordhash.list_array(values.view(np.int64), ends)], names=["id", "hs"])

    rows = spread(df.select(id_col, text_col)).select(F.col(id_col).alias("id"), shingle_text(F.col(text_col), entities).alias("t"))
    return stored(rows.mapInArrow(hashed, f"id {rows.schema['id'].dataType.simpleString()}, hs array<long>"), "shingles")


#: So many rows at most, on average, go to one task of a join, so a task's memory doesn't grow with the corpus.
TASK_ROWS = 4_000_000


def _dealt(df: DataFrame, rows: int, by: str) -> DataFrame:
    """df dealt by a column to as many tasks as so many rows take, at least one a core."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), by)


def _exploded(sets: DataFrame) -> DataFrame:
    return sets.select("id", F.explode("hs").alias("h"))


#: Runs of few rows are joined row by row as long as that makes so many rows for each held shingle.  The others are frequent: rows that hold the same ones are
#: compared as one.
RARE_ROWS = 2


def _least_two(df: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the two rows with the least m, of equals with the least other: one more than is needed, as a row is no match of itself."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("m", "other"))).where("k <= 2").drop("k")


def best_match(candidates: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, entities: list[str] | None = None) -> DataFrame:
    """id, best_id, similarity, verdict: each candidate's highest Jaccard similarity to any other row of the corpus, the least id of equals.

    Of the corpus only shingles that a candidate holds are joined.  Shingles that the same rows hold (a shared passage, all of a copy) become one with
    a weight, told by their number of rows and 128 bits of hash, and those of a single row go, so a pair costs a row for each run of such
    shingles that it shares and not for each shingle.  Pairs are made of rows that share a run of few rows.  Of those that share frequent runs alone, rows
    that hold the same ones differ only in size, so the two smallest stand for them, and again the two smallest of all that share as much: the pairs don't
    grow with the square of a run's rows.  Sizes are those of the stored sets.  No shared shingle gives 0 and no best_id.  An id is one row of the corpus.
    """
    base = shingle_sets(corpus, id_col, text_col, k, entities)
    mine = candidates.select(F.col(id_col).alias("id")).distinct()
    wanted = stored(_exploded(base.join(mine, "id", "left_semi")), "wanted")
    asked = stored(wanted.select("h").distinct(), "asked")
    rows = base.agg(F.sum(F.size("hs"))).first()[0] or 0
    few = asked.count() <= 5 * BROADCAST_ROWS  # single numbers
    all_, asked = (_exploded(base), F.broadcast(asked)) if few else (_dealt(_exploded(base), rows, "h"), _dealt(asked, rows, "h").hint("shuffle_hash"))
    held = stored(all_.join(asked, "h", "left_semi").withColumnRenamed("id", "other"), "held")
    marks = [F.bit_xor(F.xxhash64("other", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    of_rows = _dealt(held, held.count(), "h").groupBy("h").agg(F.count("*").alias("r"), *marks).where("r > 1")
    runs = stored(of_rows.groupBy("r", "x0", "x1").agg(F.min("h").alias("h"), F.count("*").alias("w")).select("h", "w", "r"), "runs")
    n = runs.count()
    sizes = base.select(F.col("id").alias("other"), F.size("hs").alias("m"))
    shared = stored(held.join(small_or_not(runs, n), "h"), "shared")
    by_r = wanted.join(small_or_not(runs.select("h", "r"), n), "h").groupBy("r").agg(F.sum("r").alias("rows"))
    most = by_r.withColumn("all", F.sum("rows").over(Window.orderBy("r"))).where(F.col("all") <= RARE_ROWS * held.count()).agg(F.max("r")).first()[0] or 0  # a row for each r, a single number
    rare, frequent = shared.where(F.col("r") <= most), shared.where(F.col("r") > most)

    # Rows by the frequent runs that they hold; a class goes by its smallest row.
    of_row = stored(frequent.groupBy("other").agg(F.count("*").alias("runs"), *(F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"x{k}") for k in (0, 1))).join(sizes, "other"), "of_row")
    same = ["runs", "x0", "x1"]
    least = stored(_least_two(of_row, same), "least")
    first = least.groupBy(same).agg(F.min(F.struct("m", "other"))["other"].alias("cls"))
    classed = stored(of_row.join(first, same).select("other", "m", "cls"), "classed")
    asking = classed.join(mine.withColumnRenamed("id", "other"), "other", "left_semi").select(F.col("other").alias("id"), F.col("cls").alias("of"))
    held_by = stored(frequent.join(first.select(F.col("cls").alias("other")), "other", "left_semi").select("h", "w", F.col("other").alias("cls")), "held_by")
    asked_by = held_by.join(asking.select(F.col("of").alias("cls")).distinct(), "cls", "left_semi").select("h", F.col("cls").alias("of"))
    alike = stored(asked_by.join(held_by, "h").groupBy("of", "cls").agg(F.sum("w").alias("f")), "alike")
    ends = least.join(first, same).select("cls", "m", "other")
    by_frequent = _least_two(alike.join(ends, "cls"), ["of", "f"]).join(asking, "of").select("id", "other", "m", F.col("f").alias("c"))

    m = rare.count()
    wanted = wanted.join(small_or_not(runs.where(F.col("r") <= most).select("h"), n), "h", "left_semi")
    met = wanted.join(F.broadcast(rare), "h") if m <= BROADCAST_ROWS else _dealt(wanted, m, "h").join(_dealt(rare, m, "h"), "h")
    by_rare = met.where("id != other").groupBy("id", "other").agg(F.sum("w").alias("c")).join(sizes, "other")
    both = by_rare.join(asking, "id", "left").join(classed.select("other", "cls"), "other", "left").join(alike, ["of", "cls"], "left")
    by_rare = both.select("id", "other", "m", (F.col("c") + F.coalesce("f", F.lit(0))).alias("c"))
    pairs = by_rare.union(by_frequent.where("id != other")).join(sizes.select(F.col("other").alias("id"), F.col("m").alias("n")), "id")
    scored = pairs.withColumn("similarity", F.col("c") / (F.col("n") + F.col("m") - F.col("c")))
    best = scored.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("b"))
    out = mine.join(best, "id", "left")
    similarity = F.coalesce("b.similarity", F.lit(0.0))
    verdict = F.when(similarity >= FAIL, "fail").when(similarity >= WARN, "warn").otherwise("ok")
    return out.select(F.col("id").alias(id_col), (-F.col("b.o")).alias("best_id"), rounded(similarity, 6).alias("similarity"), verdict.alias("verdict"))


def contained(items: DataFrame, corpus: DataFrame, item_id: str, id_col: str, text_col: str = "text", k: int = 8) -> DataFrame:
    """item, document and the share of the item's shingles that the document holds, for every pair that shares one."""
    sets = shingle_sets(items, item_id, text_col, k)
    wanted = stored(_exploded(sets), "wanted")
    asked = small_or_not(stored(wanted.select("h").distinct(), "asked"))
    held = stored(_exploded(shingle_sets(corpus, id_col, text_col, k)).join(asked, "h", "left_semi").withColumnRenamed("id", "doc"), "held")
    common = wanted.join(small_or_not(held), "h").groupBy("id", "doc").agg(F.count("*").alias("c")).join(sets.select("id", F.size("hs").alias("n")), "id")
    return common.select(F.col("id").alias(item_id), F.col("doc").alias(id_col), rounded(F.col("c") / F.col("n"), 6).alias("share"))
