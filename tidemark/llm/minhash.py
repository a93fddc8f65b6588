"""Near-duplicate texts by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.graph import connected_components
from tidemark.llm.work import small_or_not, whole_groups, written

#: Places of the universe that the two permutations act on.
PLACES = 1 << 20
#: A pair at Jaccard 0.8 shows a differing sign bit in a tenth of the coordinates; this many
#: standard deviations above that a pair is no candidate (about one in 10**9 true pairs).
SIGMAS = 6.0
#: Members of a split bucket are paired in Spark up to this size of bucket, so a row for at most so many; larger buckets are compared in blocks.
SMALL = 8
#: Rows and shingles of a block.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 2_000_000


@cache
def _second_permutation(seed: int, width: int) -> np.ndarray:
    """Row x is pi[x], pi[x+1], ... pi[x+width-1]: all circular shifts of one permutation at x."""
    pi = np.random.default_rng(seed).permutation(PLACES).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:width]]), width)


def signature(shingles: np.ndarray, width: int, seed: int = 11) -> np.ndarray:
    """All coordinates of a set of 64-bit shingle hashes.

    The first permutation is a bijective mix of the hash, whose top bits give a place; coordinate
    k is the least value of the second permutation, shifted by k, over the places.
    """
    table = _second_permutation(seed, width)
    places = (tx.mix(shingles ^ np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    out = np.full(width, PLACES, dtype=np.int32)
    for i in range(0, len(places), 1024):
        np.minimum(out, table[places[i : i + 1024]].min(axis=0), out=out)
    return out


def shingle_sets(w: tx.Words, h: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct n-word shingle hashes; the whole sequence as one if it is shorter."""
    rolled = tx.rolling_hashes(h, n)
    whole, _ = tx.sequence_hashes(h, w.bounds)
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        yield np.unique(rolled[a : b - n + 1]) if b - a >= n else whole[i : i + (b > a)]


def _describe(shingle: int, bands: int, rows: int):
    width = bands * rows
    schema = "id long, f1 long, f2 long, n_shingles long, b1 long, b2 long, b3 long, bands array<long>"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, data, offsets in tx.blocks(batch.column(1)):
                w = tx.split_words(data, offsets, lower=True)
                h = tx.word_hashes(w)
                one, two = tx.sequence_hashes(h, w.bounds)
                sets = list(shingle_sets(w, h, shingle))
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                sig = np.array([signature(s, width) if len(s) else np.zeros(width, np.int32) for s in sets])
                mixed = tx.mix(sig.astype(np.uint64) + np.arange(width, dtype=np.uint64) * np.uint64(PLACES))
                bits = np.zeros((len(sets), 192), dtype=np.uint8)
                bits[:, :width] = ((mixed >> np.uint64(17)) & np.uint64(1))[:, :192]
                words = np.packbits(bits, axis=1).view(np.int64)
                keys = (mixed.reshape(len(sets), bands, rows) * tx.powers(0x9E3779B97F4A7C15, rows + 1)[1:]).sum(axis=2, dtype=np.uint64)
                keys = tx.mix(keys + np.arange(bands, dtype=np.uint64)).view(np.int64)
                kept = np.repeat(sizes > 0, bands)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, past - first).cast(pa.int64()),
                        pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sizes),
                        *(pa.array(words[:, k]) for k in range(3)),
                        tx.list_array(keys.reshape(-1)[kept], ends),
                    ],
                    names=["id", "f1", "f2", "n_shingles", "b1", "b2", "b3", "bands"],
                )

    return describe, schema


def _sets(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, data, offsets in tx.blocks(batch.column(1)):
                w = tx.split_words(data, offsets, lower=True)
                found = list(shingle_sets(w, tx.word_hashes(w), shingle))
                ends = np.concatenate([[0], np.cumsum([len(s) for s in found])])
                values = np.concatenate(found) if found else np.zeros(0, np.uint64)
                ids = batch.column(0).slice(first, past - first).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, tx.list_array(values.view(np.int64), ends)], names=["id", "shingles"])

    return sets


def _compare(rows: pa.Table, percent: int, most: int) -> list[tuple[int, int]]:
    """Links between rows of one block that tie together components not yet tied; each is confirmed on the full sets."""
    col = lambda name: rows[name].to_numpy()
    ids, turn = col("id"), rows["turn"].to_numpy()
    bits = np.stack([col(f"b{k}").view(np.uint64) for k in (1, 2, 3)], axis=1)
    sets = rows["shingles"].combine_chunks()
    n = sets.value_lengths().to_numpy().astype(np.int64)
    flat, ends = sets.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(n)])
    _, label = np.unique(col("component"), return_inverse=True)
    sizes = np.bincount(label)
    turns = np.flatnonzero(turn)
    found = []
    for a in turns[np.argsort(sizes[label[turns]], kind="stable")]:
        near = (label != label[a]) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
        near &= np.bitwise_count(bits ^ bits[a]).sum(axis=1) <= most
        left, own = np.flatnonzero(near), flat[ends[a] : ends[a + 1]]
        while len(left):
            now, left = left[:64], left[64:]
            others = np.concatenate([flat[ends[b] : ends[b + 1]] for b in now])
            hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(n[now])[:-1]]), dtype=np.int64)
            for b in now[100 * common >= percent * (n[a] + n[now] - common)]:
                if label[b] != label[a]:
                    found.append((int(ids[a]), int(ids[b])))
                    label[label == label[b]] = label[a]
            left = left[label[left] != label[a]]
    return found


def _blocks(percent: int, most: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["key", "chunk", "block"]):
            for a, b in zip(starts, [*starts[1:], rows.num_rows], strict=True):
                found = _compare(rows.slice(a, b - a), percent, most)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return links


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5
) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id, kept.

    Texts are lower-cased in A-Z and cut into words; the distinct `shingle`-word shingles are the
    set (the whole sequence as one if shorter).  Texts with 100 * |A and B| >= percent * |A or B|
    are linked; component_id is the smallest id reachable, kept marks id = component_id.

    Equal texts are first gathered to one representative, so a group of copies is one row from
    then on.  Band buckets are linked in two exact steps: every member is compared with its
    bucket's smallest id; then, only in buckets whose members are still in several components,
    members of different components are compared: in small buckets as pairs, in larger ones block by block inside tasks
    that give out only the links that tie components together.  Blocks hold the members outside a bucket's largest component, by chunks,
    against all: a bucket of c members of which m are outside costs c rows for each 512 of the m.
    Every pair that shares a bucket is thus compared or already known to be connected, without
    emitting all pairs of a bucket.  With 32 bands of 5 a pair at 0.8 shares none with
    probability 3e-6.  Each candidate is confirmed on the full sets.

    Defined cases: a null or wordless text has n_shingles 0, is linked with nothing, and has
    itself as component.  Rows that repeat an id are one node.  A row whose id is null takes the
    component of an equal text, else null, and is kept only where that is null.  Extra columns
    are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    describe, schema = _describe(shingle, bands, rows)
    described = written(base.mapInArrow(describe, schema), "signatures")
    firsts = written(described.where("n_shingles > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep")), "firsts")
    # The representatives alone keep their bands.  Equal texts have equal sets, so any row will do.
    reps = described.where("id is not null and n_shingles > 0").join(firsts.withColumnRenamed("rep", "id"), ["f1", "f2", "id"], "left_semi")
    reps = reps.dropDuplicates(["id", "f1", "f2"])
    buckets = reps.select("id", "n_shingles", "b1", "b2", "b3", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("held"), F.min("id").alias("hub")).where("c > 1")
    # Counts are written before they are joined, here and below, so that the adaptive skew join can split a hot bucket.
    members = written(buckets.join(small_or_not(written(shared, "buckets")), "key"), "members")

    width = min(192, bands * rows)
    share = percent / 100
    most = int(width * (1 - share) / 2 + SIGMAS * (width * (1 - share) / 2 * (1 + share) / 2) ** 0.5)
    alike = (
        f"100 * least(a.n_shingles, b.n_shingles) >= {percent} * greatest(a.n_shingles, b.n_shingles) and "
        f"bit_count(a.b1 ^ b.b1) + bit_count(a.b2 ^ b.b2) + bit_count(a.b3 ^ b.b3) <= {most}"
    )
    sketch = reps.select("id", "n_shingles", "b1", "b2", "b3")
    stars = members.where("id != hub").select("id", "n_shingles", "b1", "b2", "b3", "hub").distinct()
    stars = stars.alias("a").join(sketch.alias("b"), F.expr("a.hub = b.id")).where(alike).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    links = _verified(base, stars, shingle, percent)
    found = connected_components(links)

    placed = written(members.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    # The largest component of each bucket that is still split.
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    split = sizes.groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("n", "component", "s")).alias("most")).where("components > 1")
    split = written(split.select("key", F.col("most.component").alias("largest"), F.col("most.n").alias("its_n"), F.col("most.s").alias("its_s")), "split-buckets")
    placed = written(placed.join(small_or_not(split), "key"), "split")
    few = placed.where(F.col("c") <= SMALL).select("key", "id", "hub", "component", "n_shingles", "b1", "b2", "b3")
    rest = (
        few.alias("a").join(few.alias("b"), F.expr(f"a.key = b.key and a.id < b.id and a.component != b.component and a.id != a.hub and b.id != b.hub and {alike}"))
        .select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()
    )
    more = _verified(base, rest, shingle, percent)
    # Of two rows of different components one is not in the largest.  Those few are dealt to chunks; each chunk meets all rows of the bucket once.
    many = placed.where(F.col("c") > SMALL).withColumn("minor", F.col("component") != F.col("largest"))
    parts = F.greatest(F.ceil((F.col("c") - F.col("its_n")) / BLOCK_ROWS), F.ceil((F.col("held") - F.col("its_s")) / BLOCK_SHINGLES))
    many = many.withColumn("parts", F.greatest(parts, F.lit(1)).cast("int"))
    many = many.withColumn("own", F.when(F.col("minor"), F.expr("cast(pmod(xxhash64(id, 5), parts) as int)")))
    many = many.withColumn("wide", F.greatest(F.ceil(F.col("c") / BLOCK_ROWS), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int"))
    many = many.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("strip", F.expr("cast(pmod(xxhash64(id, 7), wide) as int)"))
    # A chunk's own rows go to every strip of the bucket, the others to the one that they fall into.
    strips = F.when(F.col("own") == F.col("chunk"), F.sequence(F.lit(0), F.col("wide") - 1)).otherwise(F.array("strip"))
    many = many.withColumn("block", F.explode(strips)).withColumn("turn", F.coalesce(F.col("own") == F.col("chunk"), F.lit(False)))
    many = many.select("key", "id", "component", "b1", "b2", "b3", "n_shingles", "chunk", "block", "turn")
    many = many.join(_sets_of(base, many.select("id"), shingle), "id").repartition("key", "chunk", "block").sortWithinPartitions("key", "chunk", "block")
    more = more.unionByName(written(many.mapInArrow(_blocks(percent, most), "u long, v long"), "block-links"))
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))

    roots = firsts.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("root"))
    out = described.select("id", "n_shingles", "f1", "f2").join(roots, ["f1", "f2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept")
    )


def _verified(base: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the similarity."""
    pairs = written(pairs, "pairs")
    sets = _sets_of(base, pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))), shingle)
    both = (
        pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("s")), "u")
        .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("t")), "v")
        .withColumn("common", F.size(F.array_intersect("s", "t")).cast("long"))
    )
    # No distinct here: it would be dealt by v alone and keep the adaptive join from splitting a v with very many pairs.
    enough = both.where(f"100 * common >= {percent} * (size(s) + size(t) - common)").select("u", "v")
    return written(enough, "links")


def _sets_of(base: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Shingle sets of the texts of some ids, one row each."""
    ids = written(ids.distinct(), "ids")
    texts = base.join(small_or_not(ids), "id", "left_semi").distinct()
    return written(texts.mapInArrow(_sets(shingle), "id long, shingles array<long>"), "sets")
