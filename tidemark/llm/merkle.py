"""A Merkle manifest of a dataset: levels built bottom-up, proofs pushed top-down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.work import small_or_not, written
from tidemark.operators.ranks import numbered

#: The first byte of a step of a proof: no sibling, sibling to the left, sibling to the right.
NONE, LEFT, RIGHT = b"\x00", b"\x01", b"\x02"


def field(value: Column) -> Column:
    """A value as a part of a leaf: - if null, else its bytes' count, a colon, itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """SHA-256 of the values' fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hexed(h: Column | str) -> Column:
    return F.lower(F.hex(h))


def siblings(proof: Column) -> Column:
    """The hex digests of a proof from leaf to root, joined."""
    return F.array_join(F.transform(proof, lambda step: F.substring(hexed(step), 3, 64)), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root, in hex, that a leaf's 32 bytes and its proof lead to."""

    def step(node: Column, part: Column) -> Column:
        side, other = F.substring(hexed(part), 1, 2), F.substring(hexed(part), 3, 64)
        joined = F.when(side == LEFT.hex(), F.concat(other, node)).when(side == RIGHT.hex(), F.concat(node, other)).otherwise(node)
        return F.sha2(joined, 256)

    return F.aggregate(proof, hexed(leaf), step)


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, pos, n, h) and all levels above, each written with its children's hashes, up to those where every tree has one node."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        odd = F.col("pos") % 2 == 1
        pairs = levels[-1].where("n > 1").groupBy("tree", F.shiftright("pos", 1).alias("pos"), F.shiftright(F.col("n") + 1, 1).alias("n"))
        up = pairs.agg(F.max(F.when(~odd, F.col("h"))).alias("left"), F.max(F.when(odd, F.col("h"))).alias("right"))
        both = F.concat(hexed("left"), F.coalesce(hexed("right"), F.lit("")))
        levels.append(written(up.withColumn("h", F.unhex(F.sha2(both, 256))), "level"))
        most = (most + 1) // 2
    return levels


def _pushed(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest level with proof and the columns of ends (tree, proof, ...), which holds those of each tree's last node.

    From the top down every node takes its parent's proof and puts its own step before it.
    """
    carried = [c for c in ends.columns if c not in ("tree", "proof")]
    ends = small_or_not(ends)
    above: DataFrame | None = None
    for k in reversed(range(len(levels))):
        own = levels[k].columns
        out = levels[k].where("n = 1").join(ends, "tree").select(*own, "proof", *carried)
        if above is not None:
            parents = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("up"), F.col("left").alias("l"), F.col("right").alias("r"), "proof", *carried)
            joined = levels[k].where("n > 1").join(parents, (F.col("tree") == F.col("_tree")) & (F.shiftright("pos", 1) == F.col("up")))
            step = F.when(F.col("pos") % 2 == 1, F.concat(F.lit(LEFT), F.col("l"))).otherwise(F.coalesce(F.concat(F.lit(RIGHT), F.col("r")), F.lit(NONE)))
            out = out.unionByName(joined.withColumn("proof", F.concat(F.array(step), F.col("proof"))).select(*own, "proof", *carried))
        above = written(out, "proofs") if k else out
    return above


def merkle_manifest(
    docs: DataFrame, leaf_cols: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    part_col: str = "lang", id_col: str = "doc_id", also: dict[str, Column] | None = None,
) -> DataFrame:
    """One row for each row of docs: id, leaf, subroot, root (32 bytes each), proof, and the columns of `also`, worked out from docs.

    A leaf is the hash of its row's fields.  Within each value of part_col leaves ascend by id, and every two nodes that
    follow one another (at the end perhaps one) become the hash of their hex digests, until one is left: the
    subroot.  Subroots, ascending by the part, make the root in the same way.  A proof holds one step a level, of the leaf's
    tree and then of the subroots': a byte for the sibling's side and the sibling, or the byte alone; `folded` leads from a leaf
    and its proof to the root.

    Leaves are written and dealt by ranges, so a part of any size is spread, and places follow from the counts of the ranges.
    Each level is an aggregation by pairs, half as large as the last, and is written; then every level, from the top down, is joined to
    its parents' proofs.  Only the root and the depth come to the driver.

    Defined cases: nulls are fields of their own and the null part is the first tree; null ids come first in their tree.  Rows of one id
    follow their leaves' bytes; equal rows have proofs of their own places.  One row alone is leaf, subroot and root, with an empty
    proof.  Other columns are ignored, whatever their names.  Texts are hashed whole.  Empty in, empty out.
    """
    also = also or {}
    own = {f"also{k}": value for k, value in enumerate(also.values())}
    leaves = docs.select(
        F.col(f"`{part_col}`").cast("string").alias("part"), F.col(f"`{id_col}`").alias("id"),
        leaf_of(*(F.col(f"`{c}`") for c in leaf_cols)).alias("h"), *(value.alias(name) for name, value in own.items()),
    )
    levels = _levels(numbered(written(leaves, "leaves"), "part", ["id", "h"]))
    subroots = [level.where("n = 1").select(F.lit(0).alias("part"), F.col("tree").alias("id"), "h") for level in levels]
    for other in subroots[1:]:
        subroots[0] = subroots[0].unionByName(other)
    tops = _levels(numbered(written(subroots[0], "subroots"), "part", ["id"]))
    root = tops[-1].where("n = 1").select("tree", F.array().cast("array<binary>").alias("proof"), F.col("h").alias("root"))
    ends = _pushed(tops, root).select(F.col("id").alias("tree"), "proof", F.col("h").alias("subroot"), "root")
    out = _pushed(levels, written(ends, "tops"))
    return out.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", "proof", *(F.col(k).alias(v) for k, v in zip(own, also, strict=True)))
