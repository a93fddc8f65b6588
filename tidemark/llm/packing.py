"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.work import written

#: A shard, packed by one task, holds about so many pieces and tokens at most.
SHARD_PIECES = 100_000
SHARD_TOKENS = 200_000_000
#: Equal rows, and pieces of one document, are counted out in two steps of at most so many.
STEP = 10_000


def pack_lengths(lengths: np.ndarray, capacities: list[int], overhead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (none over the largest capacity), and each bin's final size.

    Longest first, each goes to the open bin that it fills best.  If none has room, the capacity is
    opened that is expected to cost least a token: its downsized length plus overhead, over the tokens it
    will hold if the shorter lengths still to come fill it as far as they can.  At the end each bin
    shrinks to the smallest capacity that holds its contents.
    """
    sizes = sorted(capacities)
    order = np.argsort(-lengths, kind="stable")
    down = lengths[order]
    to_come = np.concatenate([np.cumsum(down[::-1])[::-1], [0]]).tolist()
    below = -down
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    room: list[int] = []  # the distinct rooms of open bins, ascending
    at_room: dict[int, list[int]] = {}
    used: list[int] = []
    opened: list[int] = []
    for i, (k, n) in enumerate(zip(order.tolist(), down.tolist(), strict=True)):
        j = bisect_left(room, n)
        if j < len(room):
            r = room[j]
            b = at_room[r].pop()
            if not at_room[r]:
                del at_room[r], room[j]
        else:
            best, r, b = None, 0, len(used)
            for size in sizes:
                if size < n:
                    continue
                fitting = max(i + 1, int(np.searchsorted(below, n - size)))
                full = n + min(size - n, to_come[min(fitting, len(down))])
                cost = (sizes[bisect_left(sizes, full)] + overhead) / max(full, 1)
                if best is None or cost < best:
                    best, r = cost, size
            used.append(0)
            opened.append(r)
        bins[k], offsets[k] = b, used[b]
        used[b] += n
        r -= n
        if r:
            if r not in at_room:
                at_room[r] = []
                insort(room, r)
            at_room[r].append(b)
    final = np.array([sizes[bisect_left(sizes, u)] for u in used], dtype=np.int64)
    return bins, offsets, final


def _pack(capacities: list[int], overhead: int):
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n", "descending"), ("id", "ascending"), ("copy", "ascending"), ("piece", "ascending")])
        lengths = rows["n"].to_numpy()
        bins, offsets, final = pack_lengths(lengths, capacities, overhead)
        held = np.bincount(bins, weights=lengths, minlength=len(final)).astype(np.int64)
        first = key[0].as_py() << 32
        return pa.table({
            "id": rows["id"], "copy": rows["copy"], "piece": rows["piece"], "start": rows["start"], "n_tokens": rows["n"],
            "bin_id": first + bins, "offset": offsets, "bin_size": final[bins], "bin_used": held[bins],
        })

    return pack


def _counted_out(df: DataFrame, name: str, count: Column) -> DataFrame:
    """df with each row once for every number from 0 to count - 1, in column `name`; no array holds more than STEP numbers or steps of them."""
    long = lambda x: F.lit(x).cast("long")
    df = df.withColumn("_count", count.cast("long")).where("_count > 0")
    df = df.withColumn("_step", F.explode(F.sequence(long(0), F.floor((F.col("_count") - 1) / STEP))))
    first = F.col("_step") * STEP
    return df.withColumn(name, F.explode(F.sequence(first, F.least(F.col("_count"), first + STEP) - 1))).drop("_count", "_step")


def best_fit(
    docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: tuple[int, ...] = (512, 1024, 2048, 4096, 8192), overhead: int = 64,
    shard_pieces: int = SHARD_PIECES, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row for each piece of a document: id, copy, piece, start, n_tokens, bin_id, offset, bin_size, bin_used.

    A document longer than the largest capacity is cut into pieces of that length and a rest, so no
    token is lost; start counts from the document's begin, offset from the bin's.  Pieces are dealt by hash to
    shards of about shard_pieces pieces and shard_tokens tokens, and each shard is packed alone by
    `pack_lengths`; a shard loses at most a few part-filled bins, so larger data cost more shards, never
    larger tasks.  The result doesn't depend on how the input is partitioned.

    Defined cases: a document of zero or null length gives one row, piece 0 with no bin.  Repeated
    rows are packed each, with copy 0, 1, ...; they are dealt apart, and counted out in steps of STEP.  Null ids
    are packed alike.  Negative lengths count as zero.
    Extra columns are ignored.  An empty table gives an empty result.
    """
    largest = max(capacities)
    lengths = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(length_col).cast("long"), F.lit(0)).alias("total"))
    lengths = written(lengths.groupBy("id", "total").agg(F.count("*").alias("copies")), "lengths")
    cut = F.floor((F.greatest("total", F.lit(1)) - 1) / largest)
    size = lengths.agg(F.sum(F.col("copies") * (cut + 1)), F.sum(F.col("copies").cast("double") * F.col("total"))).first()
    shards = max(1, -(-(size[0] or 0) // shard_pieces), int(-(-(size[1] or 0) // shard_tokens)))
    items = _counted_out(_counted_out(lengths, "copy", F.col("copies")), "piece", cut + 1)
    items = items.withColumn("start", F.col("piece") * largest).withColumn("n", F.least(F.lit(largest).cast("long"), F.col("total") - F.col("start")))
    full = items.where("n > 0").withColumn("shard", F.pmod(F.xxhash64("id", "copy", "piece"), F.lit(shards)))
    schema = "id long, copy long, piece long, start long, n_tokens long, bin_id long, offset long, bin_size long, bin_used long"
    packed = full.select("shard", "id", "copy", "piece", "start", "n").groupBy("shard").applyInArrow(_pack(list(capacities), overhead), schema)
    none = F.lit(None).cast("long")
    empty = items.where("n <= 0").select("id", "copy", "piece", "start", F.lit(0).cast("long").alias("n_tokens"), none.alias("bin_id"), none.alias("offset"), none.alias("bin_size"), none.alias("bin_used"))
    return packed.unionByName(empty).withColumnRenamed("id", id_col)
