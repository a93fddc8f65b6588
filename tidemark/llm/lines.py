"""Removal of lines that recur across many sites, with HyperLogLog sketches. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.work import small_or_not, unused, written


def _line_hash(line: Column) -> Column:
    return F.xxhash64(F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))


def boilerplate_lines(docs: DataFrame, text_col: str, site_col: str, min_sites: int, log2_k: int = 12, margin: float = 0.15) -> DataFrame:
    """line_hash and sites of lines found on at least min_sites distinct sites.

    A sketch per line hash is merged map-side.  Where its estimate lies within the margin (about nine
    standard errors of a 2**12 sketch) of min_sites the line's distinct sites are counted exactly.
    """
    base = docs.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    lines = base.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _line_hash))).alias("line_hash"))
    lines = lines.where(F.col("line_hash") != _line_hash(F.lit("")))
    sketched = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", log2_k).alias("sketch"))
    estimate = sketched.select("line_hash", F.hll_sketch_estimate("sketch").alias("sites"))
    # Lines of fewer sites than the margin allows, nearly all, are dropped before anything is kept.
    known = written(estimate.where(F.col("sites") >= min_sites * (1 - margin)), "sites")
    near = known.where(F.col("sites") <= min_sites * (1 + margin)).select("line_hash")
    exact = (
        lines.join(small_or_not(near), "line_hash", "left_semi").groupBy("line_hash", "site").agg(F.lit(1).alias("one"))
        .groupBy("line_hash").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    return known.where(F.col("sites") > min_sites * (1 + margin)).unionByName(exact)


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """docs with boilerplate lines taken out of the text, plus n_lines and n_removed (long).

    A line is compared without leading and trailing ASCII white space; it is boilerplate if it occurs
    on min_sites or more distinct sites.  All its occurrences go, the rest of the text stays as it is.
    Blank lines are never boilerplate.

    Only line hashes are exploded and shuffled, never lines; each text is then filtered in place against
    the boilerplate hashes that it holds itself.

    Defined cases: a null text stays null with 0 lines; an empty one has one (blank) line.  A null site
    counts as no site.  Rows that repeat an id, and null ids, are told apart by their texts.  Other columns,
    whatever their names, are returned as they are; those named n_lines or n_removed are replaced.  Texts of any
    length are cut whole.  Empty in, empty out.
    """
    found = written(boilerplate_lines(docs, text_col, site_col, min_sites).select("line_hash"), "boilerplate")
    hashes = F.array_distinct(F.transform(F.split(F.col(text_col), "\n"), _line_hash))
    # A text's key is a hash of its id and itself: null or repeated ids never gather under one key.
    row, key = F.xxhash64(F.col(id_col), F.col(text_col)), F.col("_id")
    own = docs.select(row.alias("_id"), F.explode(hashes).alias("line_hash")).join(small_or_not(found), "line_hash", "left_semi")
    own = written(own.groupBy(key).agg(F.collect_set("line_hash").alias("_drop")), "own")
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    key, drop, kept = unused(docs.columns, "_id", "_drop", "_kept")
    # The same join at every size: a text is shuffled once, to its own few hashes.
    joined = docs.select(*(F.col(f"`{c}`") for c in names), row.alias(key)).join(own.toDF(key, drop).hint("merge"), key, "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.filter(lines, lambda line: ~F.array_contains(F.col(drop), _line_hash(line)))
    joined = joined.withColumn(kept, F.when(F.col(drop).isNull(), lines).otherwise(left))
    n_lines, n_kept = (F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)).cast("long") for x in (lines, F.col(kept)))
    text = F.when(n_lines == n_kept, F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    shown = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return joined.select(*shown, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_removed"))
