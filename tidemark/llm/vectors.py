"""Near-duplicate vectors by randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import connected_components
from tidemark.llm.work import small_or_not, whole_groups, written

#: Pairs of rows that are compared at a time inside a task.
PAIRS = 1 << 16


@cache
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix for vectors of dim places, zero-padded to whole 64-bit words of code."""
    size = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return (q * np.sign(np.diag(r)))[:, :dim]


@cache
def _planes(dim: int, count: int, seed: int) -> np.ndarray:
    """Hyperplanes of the buckets; drawn apart from the rotation, so that buckets don't bias the estimates."""
    return np.random.default_rng(seed + 1).standard_normal((count, dim))


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest component is taken out first, so nothing over- or underflows."""
    v = np.asarray(values, dtype=np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def encode(units: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated vectors as packed bits, and each one's correction factor: its product with its own code."""
    turned = units @ rotation(units.shape[1], seed).T
    return np.packbits(turned >= 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, deviations: float) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of inner products of coded and rotated query vectors, row by row, and their confidence half-widths."""
    size = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * np.float32(2) - np.float32(1)
    raw = np.einsum("ij,ij->i", signs, queries) / np.sqrt(size)
    wide = np.sqrt(np.maximum(1 - factors**2, 0)) / factors
    return raw / factors, deviations * wide / np.sqrt(max(size - 1, 1))


def _matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _describe(bands: int, bits: int, seed: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                v = unit(_matrix(part.column("vec")))
                codes, factors = encode(v, seed)
                sides = (v @ _planes(int(dim), bands * bits, seed).T >= 0).reshape(len(v), bands, bits)
                keys = (sides * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k) for k in ("id", "label", "dim", "n", "vec")),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1))),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(factors),
                    ],
                    names=["id", "label", "dim", "n", "vec", "keys", "code", "factor"],
                )

    return describe


def _links_of(cosine: float, deviations: float, seed: int):
    """Rows sorted by block to partial link counts and to one edge a row, to the least id linked within what is at hand."""
    block = ["label", "dim", "band", "key", "lo", "hi"]

    def compare(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        ends = np.append(starts[1:], n)
        end_of = np.repeat(ends, ends - starts)
        dims = rows["dim"].to_numpy()
        col = lambda name: rows[name].to_numpy()
        ids, weight, band, chunk, same = col("id"), col("n"), col("band"), col("chunk"), col("lo") == col("hi")
        keys, factors = _matrix(_one(rows["keys"])), col("factor")
        for dim in np.unique(dims):
            where = np.flatnonzero(dims == dim)
            place = np.zeros(n, dtype=np.int64)
            place[where] = np.arange(len(where))
            part = rows.take(pa.array(where))
            v = unit(_matrix(_one(part["vec"])))
            turned = (v @ rotation(int(dim), seed).T).astype(np.float32)
            codes = np.frombuffer(b"".join(part["code"].to_pylist()), dtype=np.uint8).reshape(len(where), -1)
            left = end_of[where] - where - 1
            total = np.concatenate([[0], np.cumsum(left)])
            links, root = np.zeros(n, dtype=np.int64), np.arange(n)
            pairs_u, pairs_v = [], []
            first = 0
            while first < len(where):
                past = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, side="right")) - 1)
                a = np.repeat(where[first:past], left[first:past])
                b = a + 1 + np.arange(len(a)) - np.repeat(total[first:past] - total[first], left[first:past])
                first = past
                ok = same[a] | (chunk[a] != chunk[b])
                a, b = a[ok], b[ok]
                guess, wide = estimates(codes[place[a]], factors[a], turned[place[b]], deviations)
                ok = guess + wide >= cosine
                a, b = a[ok], b[ok]
                ok = np.einsum("ij,ij->i", v[place[a]], v[place[b]]) >= cosine
                a, b = a[ok], b[ok]
                # A pair that shares several bands counts in the first of them.
                earlier = (keys[a] == keys[b]) & (np.arange(keys.shape[1]) < band[a][:, None])
                ok = ~earlier.any(axis=1)
                a, b = a[ok], b[ok]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                pairs_u.append(a)
                pairs_v.append(b)
            u, w = np.concatenate(pairs_u), np.concatenate(pairs_v)
            while len(u):
                before = root.copy()
                least = np.minimum(root[u], root[w])
                np.minimum.at(root, u, least)
                np.minimum.at(root, w, least)
                root = root[root]
                if (root == before).all():
                    break
            hit = np.flatnonzero((links > 0) & (dims == dim))
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit]), pa.array(ids[root[hit]])], names=["id", "links", "other"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, block):
            yield from compare(rows, starts)

    return found


def bands_for(cosine: float, bits: int, missed: float) -> int:
    """Bands of which a pair at the cosine shares at least one but for the probability `missed`."""
    same = (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits
    return 1 if same >= 1 else max(1, math.ceil(math.log(missed) / math.log1p(-same)))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98,
    bands: int | None = None, bits: int | None = None, block: int = 512, deviations: float = 5.0, seed: int = 17, missed: float = 4e-8,
) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Vectors of equal label and length are linked if their cosine, in double precision, reaches
    `cosine`; n_links counts the other rows linked directly, component_id is the smallest id
    reachable, kept marks id = component_id.

    Equal vectors are first gathered to one representative with a count.  Sign bits against random
    hyperplanes give `bands` bucket keys of `bits` bits.  Unless given, bits grow with the logarithm of the counted
    representatives (16 to 30), so that buckets of unlike vectors stay small, and bands follow from them: a pair at
    the threshold shares none with a probability of at most `missed` (40 bands of 16 bits at 0.98).  Within a bucket the pairs are screened by codes: the signs of the randomly
    rotated vector and its stored correction factor give an unbiased estimate of the inner product
    with a confidence bound, and only pairs whose upper bound reaches the threshold are recomputed
    exactly (a bound of five deviations).  Buckets of more than `block` rows are dealt to chunks and
    compared chunk by chunk, so no task holds a whole bucket; what leaves a task is a link count and
    one edge for each row, never the pairs.  A pair counts in the first band that it shares.

    Defined cases: a vector that is null, empty, zero or holds null or non-finite components, and one
    whose label or id is null, is linked with nothing and has itself as component.  Rows that repeat an
    id are one node, but each counts as a row.  Extra columns are ignored.  Empty in, empty out.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    keyed = base.withColumn("usable", usable).withColumn("g1", F.xxhash64(F.lit(1), "vec")).withColumn("g2", F.xxhash64(F.lit(2), "vec"))
    group = ["label", "g1", "g2"]
    firsts = keyed.where("usable").groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    firsts = firsts.withColumn("dim", F.size("vec")).withColumn("node", F.monotonically_increasing_id())
    firsts = written(firsts, "vector-groups")
    bits = bits or min(30, max(16, (firsts.count() // 4).bit_length()))
    bands = bands or bands_for(cosine, bits, missed)
    schema = f"id long, label long, dim int, n long, vec {firsts.schema['vec'].dataType.simpleString()}, keys array<int>, code binary, factor double"
    coded = firsts.select(F.col("node").alias("id"), "label", "dim", "n", "vec").mapInArrow(_describe(bands, bits, seed), schema)
    coded = written(coded, "vector-codes")

    bucket = ["label", "dim", "band", "key"]
    placed = coded.select("id", "label", "dim", F.posexplode("keys").alias("band", "key"))
    shared = written(placed.groupBy(*bucket).agg(F.count("*").alias("c")).where("c > 1"), "vector-buckets")
    parts = placed.join(small_or_not(shared), bucket).withColumn("parts", F.ceil(F.col("c") / block).cast("int"))
    parts = parts.withColumn("chunk", F.expr("cast(pmod(xxhash64(id, 3), parts) as int)"))
    parts = parts.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = parts.select("id", "band", "key", "chunk", F.least("chunk", "partner").alias("lo"), F.greatest("chunk", "partner").alias("hi"))
    blocks = parts.join(coded, "id")
    order = [*bucket, "lo", "hi"]
    blocks = blocks.repartition(*order).sortWithinPartitions(*order)
    found = written(blocks.mapInArrow(_links_of(cosine, deviations, seed), "id long, links long, other long"), "vector-links")

    names = firsts.select(F.col("node").alias("id"), "rep")
    edges = found.where("id != other").select("id", "other").distinct()
    edges = edges.join(names, "id").select(F.col("rep").alias("u"), F.col("other").alias("id")).join(names, "id").select("u", F.col("rep").alias("v"))
    # An id that stands for several vectors ties their groups together.
    several = keyed.where("usable").groupBy("id").agg(F.min(F.struct(*group)).alias("lo"), F.max(F.struct(*group)).alias("hi")).where("lo != hi")
    tied = keyed.where("usable").join(several, "id", "left_semi").join(firsts.select(*group, "rep"), group)
    edges = edges.unionByName(tied.select(F.col("id").alias("u"), F.col("rep").alias("v")))
    parts_of = connected_components(edges)
    sums = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    groups = firsts.select(*group, "rep", "n", "node").join(sums, "node", "left")
    groups = groups.join(parts_of.withColumnRenamed("node", "rep"), "rep", "left")
    groups = groups.select(*group, F.coalesce("component", "rep").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    groups = groups.withColumn("usable", F.lit(True))
    out = keyed.select("id", "usable", *group).join(groups, [*group, "usable"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, component.isNull()).alias("kept"),
    )
