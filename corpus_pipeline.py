"""A corpus pipeline: quality, boilerplate lines, near duplicates, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lines import remove_boilerplate
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.packing import best_fit
from tidemark.llm.quality import with_quality
from tidemark.llm.queries import VOCABULARY, WEIGHTS, with_domain
from tidemark.llm.tokens import read_ranks, with_token_counts
from tidemark.llm.work import small_or_not, unused, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality scores 0.5 or more, each by its own text.

    Null ids and repeated rows are scored like others; a null or empty text takes the model's prior.  Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (score,) = unused(docs.columns, "score")
    return with_quality(docs, labels, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on ten or more sources are taken out of every text; n_chars follows the text.  No row goes.

    A null text stays null, and so does its n_chars.  Null ids and repeated rows are treated each by its own text.
    """
    (lines,) = unused(docs.columns, "n_lines_before")
    kind = docs.schema["n_chars"].dataType
    kept = docs.withColumnsRenamed({"n_lines": lines})
    (removed,) = unused(kept.columns, "n_removed_before")
    out = remove_boilerplate(kept.withColumnsRenamed({"n_removed": removed}), min_sites=10).withColumn("n_chars", F.length("text").cast(kind))
    own = {"n_lines": lines, "n_removed": removed}
    return out.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of those with the least doc_id (nulls last) the first; repeated and null ids are rows of their own.

    Null and wordless texts are in no group and all stay.
    """
    (row,) = unused(docs.columns, "_row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, row, shingle=5).select(F.col(row).alias("_row"), "component_id")
    placed = written(rows.select(F.col(row).alias("_row"), "doc_id").join(found, "_row"), "placed")
    stays = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")).select("least._row")
    gone = written(placed.join(stays, "_row", "left_anti").select(F.col("_row").alias(row)), "duplicates")
    return rows.join(small_or_not(gone), row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, by target weights; no row twice, the last of a source whole.

    Null and wordless texts have no tokens; they are taken if they come before the end of their source's prefix.
    """
    domain, tokens, epoch, taken = unused(docs.columns, "domain", "n_tokens", "epoch_before", "n_taken_before")
    own = {"epoch": epoch, "n_taken": taken}
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = with_domain(docs.withColumnsRenamed(own), domain).withColumn(tokens, words)
    out = mix(rows, WEIGHTS, share=0.9, max_epochs=1, levels=(domain, "lang", "source"), tokens_col=tokens)
    return out.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in a training sequence; a document without tokens has no bin.

    Repeated rows are packed each; null ids stay null.
    """
    return best_fit(with_token_counts(docs, read_ranks(VOCABULARY)).select("doc_id", "n_tokens"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_dedup", minhash_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned scores and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
