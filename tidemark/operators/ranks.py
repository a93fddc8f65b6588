"""Places of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.storage import small_or_not, stored


def numbered(rows: DataFrame, part: str, order: list[str], tree: str = "tree", pos: str = "pos", n: str = "n") -> DataFrame:
    """rows with `tree` (a number for each value of part, ascending with it), `pos` (a row's place in its part, from 0) and `n` (the part's rows).

    Rows are dealt by ranges of part and order, so a part of any size is spread; only the counts of each range are added up.
    Rows alike in all of these are told apart by a salt, so they can be spread too.  Nulls come first and are one part.
    """
    keys = [part, *order, "_salt"]
    salted = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    dealt = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "ordered").withColumn("_run", F.shiftrightunsigned("_at", 33))
    runs = dealt.groupBy(F.col(part).alias("_part"), F.col("_run").alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    own = Window.partitionBy("_part")
    before = own.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_part", "_of", "_first", F.min("_first").over(own).alias(tree), F.sum("_size").over(own).alias(n),
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    placed = dealt.join(small_or_not(stored(runs, "runs")), F.col(part).eqNullSafe(F.col("_part")) & (F.col("_run") == F.col("_of")))
    return placed.withColumn(pos, F.col("_start") + F.col("_at") - F.col("_first")).drop("_part", "_of", "_run", "_at", "_first", "_start")
