"""Mixing of sources to target weights by budgets that flow down a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.work import small_or_not, unused, written

#: Hex digits of a document's seeded hash by which a leaf is cut into buckets, and then its last bucket again, as long as that has more rows.
DIGITS = 2
BUCKET_ROWS = 2_000


def _filled(children: DataFrame, parent: list[str]) -> DataFrame:
    """Children with their budget b: the parent's B by weight, what a child can't take going to its siblings.

    Sorted by capacity a weight, the children that are full come first: one is full if its capacity is
    no more than its share of what those before it have left.  All in whole numbers.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight"))
    before = Window.partitionBy(*parent).orderBy(ratio.asc_nulls_last(), "name").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    d = lambda c: c.cast("decimal(19,0)")
    out = children.withColumn("gone", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    out = out.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("full", (F.col("weight") > 0) & (d(F.col("cap")) * d(F.col("rest")) <= d(F.col("weight")) * d(F.col("B") - F.col("gone"))))
    out = out.withColumn("taken", F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0)))
    out = out.withColumn("open", F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole), F.lit(0)))
    share = (d(F.col("weight")) * d(F.col("B") - F.col("taken"))).cast("decimal(38,0)")
    part = F.call_function("div", share, F.greatest(d(F.col("open")), F.lit(1).cast("decimal(19,0)")))
    return out.withColumn("b", F.when(F.col("full"), F.col("cap")).otherwise(part.cast("long"))).drop("gone", "rest", "full", "taken", "open")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: DataFrame, budget: Column, max_epochs: int) -> DataFrame:
    """leaves (levels, avail) with their budget b.  weights: path array<string>, weight long; a node not named has weight 1."""
    caps = leaves.withColumn("cap", F.col("avail") * max_epochs)
    level_budgets = caps.agg(F.sum("avail").alias("avail"), F.sum("cap").alias("cap")).select(F.least(budget.cast("long"), F.col("cap")).alias("B"))
    parent: list[str] = []
    for k, level in enumerate(levels):
        path = levels[: k + 1]
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("path", F.array(*path)).withColumn("name", F.col(level))
        nodes = nodes.join(weights, "path", "left").withColumn("weight", F.coalesce("weight", F.lit(1).cast("long"))).drop("path")
        nodes = nodes.crossJoin(F.broadcast(level_budgets)) if not parent else nodes.join(level_budgets, parent)  # a single row
        level_budgets = _filled(nodes, parent).select(*path, F.col("b").alias("B"))
        parent = path
    return leaves.join(level_budgets.withColumnRenamed("B", "b"), levels)


def mix(
    docs: DataFrame, weights: dict[tuple[str, ...], int], share: float = 1.0, max_epochs: int = 2, seed: int = 1,
    levels: tuple[str, ...] = ("domain", "lang", "source"), id_col: str = "doc_id", tokens_col: str = "n_tokens",
) -> DataFrame:
    """The rows of docs that a mixture takes, with epoch (1, 2, ...) and n_taken (long; columns of those names are replaced).

    The budget, `share` of all tokens, flows down the tree of `levels`: each node splits what it gets
    among its children by weight (whole numbers, 1 unless given for the path).  A leaf can give its tokens max_epochs times;
    what a child can't use goes to its siblings by weight, and only when all of them are full to those
    of its parent.  A leaf takes whole epochs while its budget lasts, then a prefix of one more: documents in the order of a
    hash seeded with the epoch, until the budget is met; n_taken tells how many tokens
    of the last one are within it.

    Budgets are computed on one row a leaf.  The prefix needs no sort of a leaf: token sums by hash
    bucket (256 a leaf) find the one bucket in which it ends; as long as such a bucket has more than
    BUCKET_ROWS rows it is cut into 256 again.  Only the last bucket's rows are ordered.

    Defined cases: a null level value is the value ''.  Null or negative token counts are zero.  Rows
    that repeat an id are all counted and taken each by its place; having one hash they are ordered together.
    A weight of 0 takes nothing.  Shares round down, so a node may lose a token a child.  Other columns, whatever
    their names, are returned as they are.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("epoch", "n_taken")]
    keys = [f"_k{k}" for k in range(len(levels))]
    tokens = F.greatest(F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    own = {**{k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, levels, strict=True)}, "_n": tokens, "_id": F.col(id_col)}
    narrow = written(docs.select(*(v.alias(k) for k, v in own.items())), "mix-rows")
    leaves = narrow.groupBy(*keys).agg(F.sum("_n").alias("avail"))
    total = int(leaves.agg(F.sum("avail")).first()[0] or 0)
    given = spark.createDataFrame([(list(k), v) for k, v in weights.items()], "path array<string>, weight long")
    leaves = leaf_budgets(leaves, keys, F.broadcast(given), F.lit(int(total * share)), max_epochs)  # as many rows as weights are passed
    fulls = F.expr("if(avail > 0, b div avail, 0)").alias("fulls")
    leaves = written(leaves.select(*keys, fulls, F.expr("if(avail > 0, b % avail, 0)").alias("left")), "mix-leaves")
    leaves = small_or_not(leaves, limit=100_000)

    def seeded(fulls: Column, ident: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), fulls + 1, F.coalesce(ident.cast("string"), F.lit(""))))

    hashed = written(narrow.join(leaves, keys).where("left > 0").select(*keys, "left", "_n", seeded(F.col("fulls"), F.col("_id")).alias("h")), "mix-hashes")
    cuts, digits = None, 0
    while True:
        inside = hashed.withColumn("gone", F.lit(0).cast("long")) if cuts is None else hashed.join(cuts, keys).where(F.substring("h", 1, digits) == F.col("cut"))
        digits += DIGITS
        sums = inside.groupBy(*keys, "left", "gone", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("_n").alias("t"), F.count("*").alias("c"))
        sums = written(sums, "mix-sums")  # added up by bucket before a leaf's few hundred sums meet in one task
        upto = F.col("gone") + F.sum("t").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("upto", upto).where("upto >= left").groupBy(*keys).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("t")).alias("gone"), "c")).alias("x"))
        found = written(found.select(*keys, F.col("x.bucket").alias("cut"), F.col("x.gone").alias("gone"), F.col("x.c").alias("c")), "mix-cuts")
        cuts = small_or_not(found.select(*keys, "cut", "gone"), limit=100_000)
        if digits >= 32 or (found.agg(F.max("c")).first()[0] or 0) <= BUCKET_ROWS:
            break

    # The documents' own columns keep their names; what is joined to them takes names that they don't use.
    hidden = dict(zip([*own, "fulls", "left", "cut", "gone", "h", "at"], unused(docs.columns, *own, "fulls", "left", "cut", "gone", "h", "at"), strict=True))
    h = {k: F.col(v) for k, v in hidden.items()}
    at_keys, shown = [hidden[k] for k in keys], [F.col(f"`{c}`") for c in names]
    rows = docs.select(*shown, *(v.alias(hidden[k]) for k, v in own.items()))
    rows = rows.join(leaves.withColumnsRenamed(hidden), at_keys).join(cuts.withColumnsRenamed(hidden), at_keys, "left").withColumn(hidden["h"], seeded(h["fulls"], h["_id"]))
    bucket = F.substring(hidden["h"], 1, digits)
    epochs = h["fulls"].cast("int") + F.when(h["cut"].isNotNull() & (bucket < h["cut"]), 1).otherwise(0)
    many = F.when(epochs > 0, F.sequence(F.lit(1), epochs)).otherwise(F.array().cast("array<int>"))
    taken = rows.select(*shown, F.explode(many).alias("epoch"), h["_n"].alias("n_taken"))
    last = rows.where(bucket == h["cut"])
    before = F.sum(hidden["_n"]).over(Window.partitionBy(*at_keys).orderBy(hidden["h"], hidden["_n"]).rowsBetween(Window.unboundedPreceding, -1))
    last = last.withColumn(hidden["at"], h["gone"] + F.coalesce(before, F.lit(0))).where(h["at"] < h["left"])
    last = last.select(*shown, (h["fulls"] + 1).cast("int").alias("epoch"), F.least(h["_n"], h["left"] - h["at"]).alias("n_taken"))
    return taken.unionByName(last)
