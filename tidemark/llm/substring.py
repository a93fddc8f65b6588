"""Removal of word windows that occur more than once, by Rabin-Karp hashes counted in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.work import small_or_not, written

#: The filter over repeated anchors has about so many bits for each of them, between 2**20 and 2**27 (16 MB) in all.
ANCHOR_BITS = 16
LEAST_FILTER, MOST_FILTER = 20, 27


def _leftmost_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value in each run of `width` values, by doubling."""
    value, place, done = h, np.arange(len(h)), 1
    while done < width:
        step = min(done, width - done)
        n = len(value) - step
        later = value[step:] < value[:n]
        value = np.where(later, value[step:], value[:n])
        place = np.where(later, place[step:], place[:n])
        done += step
    return place


def _windows(w: tx.Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all n-word windows, the position of each one's anchor, and the hashes of all anchors.

    A window's anchor is its run of n // 2 + 1 words with the least hash.  Equal windows have equal
    anchors at equal offsets, so a window can only be repeated if its anchor is.
    """
    length = n // 2 + 1
    anchors = tx.rolling_hashes(h, length)
    if len(h) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), anchors
    places = _leftmost_minima(anchors, n - length + 1)
    starts = np.flatnonzero(tx.inside(w.bounds, n, len(h)))
    return starts, places[starts], anchors


def _anchors(n: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tx.blocks(batch.column(0)):
                w = tx.split_words(data, offsets)
                starts, places, hashes = _windows(w, tx.word_hashes(w), n)
                # Windows of different texts never share a place, as anchors lie within one text.
                yield pa.RecordBatch.from_arrays([pa.array(hashes[np.unique(places)].view(np.int64))], names=["g"])

    return anchors


def _candidates(n: int, size: int, repeated):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = repeated.value
        for batch in batches:
            for first, past, data, offsets in tx.blocks(batch.column(2)):
                w = tx.split_words(data, offsets)
                h = tx.word_hashes(w)
                starts, places, hashes = _windows(w, h, n)
                at = hashes[places] >> np.uint64(64 - size)
                starts = starts[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
                of = np.searchsorted(w.bounds, starts, side="right") - 1
                rolled = tx.rolling_hashes(h, n, tx.WORD_BASE_2)[starts]
                again = tx.rolling_hashes(tx.mix(h ^ np.uint64(tx.WORD_BASE)), n)[starts]
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rolled.view(np.int64)),
                        pa.array((again >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        batch.column(0).slice(first, past - first).take(rows),
                        batch.column(1).slice(first, past - first).take(rows),
                        pa.array((starts - w.bounds[of]).astype(np.int32)),
                    ],
                    names=["h", "g", "k", "t", "pos"],
                )

    return candidates


def _cut(n: int):
    schema = "id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"

    def covered(w: tx.Words, found: pa.Array, copied: np.ndarray) -> np.ndarray:
        """Which words of a block lie in a window to remove."""
        counts, at = w.counts(), np.zeros(len(w.starts) + 1, dtype=np.int64)
        lengths = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = found.flatten().to_numpy().astype(np.int64) + np.repeat(w.bounds[:-1], lengths)
        np.add.at(at, starts, 1)
        np.add.at(at, starts + n, -1)
        return (np.cumsum(at[:-1]) > 0) | np.repeat(copied & (counts >= n), counts)

    def joined(w: tx.Words, kept: np.ndarray) -> pa.Array:
        """The kept words of each text with one space between."""
        starts, sizes = w.starts[kept], (w.ends - w.starts)[kept] + 1
        ends = np.cumsum(sizes)
        data = w.data[np.minimum(np.arange(sizes.sum()) + np.repeat(starts - (ends - sizes), sizes), max(0, len(w.data) - 1))]
        data[ends - 1] = 32
        words = np.concatenate([[0], np.cumsum(kept)])[w.bounds]
        last = np.concatenate([[0], ends])[words[1:]][np.diff(words) > 0] - 1  # the spaces behind each text's last word
        solid = np.ones(len(data), dtype=bool)
        solid[last] = False
        at = np.concatenate([[0], np.cumsum(solid)])[np.concatenate([[0], ends])[words]]
        return pa.LargeStringArray.from_buffers(len(words) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[solid])).cast(pa.string())

    def spans(w: tx.Words, gone: np.ndarray) -> pa.Array:
        before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
        firsts, lasts = np.zeros(len(gone) + 1, dtype=bool), np.zeros(len(gone) + 1, dtype=bool)
        firsts[w.bounds[:-1]] = True
        lasts[w.bounds[1:]] = True
        starts = np.flatnonzero(gone & (~before | firsts[:-1]))
        ends = np.flatnonzero(gone & (~after | lasts[1:])) + 1
        base = w.bounds[np.searchsorted(w.bounds, starts, side="right") - 1]
        pairs = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, w.bounds).astype(np.int32)), pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, data, offsets in tx.blocks(batch.column(1)):
                w, size = tx.split_words(data, offsets), past - first
                copied = batch.column(2).slice(first, size).to_numpy(zero_copy_only=False)
                gone = covered(w, batch.column(3).slice(first, size), copied)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.bounds])
                columns = [batch.column(0).slice(first, size), pa.array(w.counts().astype(np.int64)), pa.array(removed.astype(np.int64)), spans(w, gone), joined(w, ~gone)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "n_removed", "spans", "kept_text"])

    return cut, schema


def _repeated_filter(anchors: DataFrame) -> tuple[int, np.ndarray]:
    """The filter's size as a power of two, and its bits: set for anchors that occur at least twice."""
    repeated = written(anchors.groupBy("g").count().where("count > 1").select("g"), "anchors")
    size = min(MOST_FILTER, max(LEAST_FILTER, (repeated.count() * ANCHOR_BITS).bit_length()))
    place: Column = F.shiftrightunsigned("g", 64 - size) + 1
    rows = repeated.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(1 << (size - 3), dtype=np.uint8)
    for row in rows.toLocalIterator():
        part = np.frombuffer(bytes(row.bits), dtype=np.uint8)[: len(out) - (row.b - 1) * 4096]
        out[(row.b - 1) * 4096 :][: len(part)] = part
    return size, out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row for each row of docs: id, n_words, n_removed, spans (word positions), kept_text.

    Every word covered by a `window`-word window that also starts anywhere else, in the same text
    or another, is removed; windows are judged on the input.  Overlapping repeated windows merge
    to maximal spans.  Kept words are joined by one space.

    All windows are hashed.  To shuffle only those that can be repeated, the windows' anchors (about
    a tenth as many) are counted first, and a bitmap tells which anchors repeat; what
    passes it by chance is settled by the exact count, so the filter decides nothing.  It has 16 bits a repeated anchor
    up to 16 MB; from some ten million repeated anchors on it fills, and more windows are sent that turn out single.  A window is
    told by two hashes, 96 bits in all, made with different bases over different word hashes.  Of texts equal byte for byte one sends its windows, the copies are known to
    repeat as a whole.  Counts combine map-side and are written, so that the join of windows with the repeated ones reads two tables and
    the adaptive skew join can split a hot window; only a text's own positions are gathered together.

    Defined cases: a null or wordless text has no words and keeps an empty text.  Every row is a
    document, so a repeated row is a copy and loses all words if it has `window` of them.  A null
    id is kept as such.  A text of any length is read whole, in memory in proportion to the longest one.  Extra columns are
    ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # A text goes by (k, t): its id, or a hash of it for a null id, and another hash; rows may repeat an id.
    keyed = base.withColumn("k", F.coalesce("id", F.xxhash64("text"))).withColumn("t", F.hash("text"))
    light = keyed.select("id", "k", "t", F.unhex(F.md5("text")).alias("m")).where("m is not null")
    groups = written(light.groupBy("m").agg(F.count("*").alias("c"), F.min("id").alias("first")).where("c > 1"), "copied-texts")
    copies = light.join(small_or_not(groups), "m").groupBy("k", "t").agg(F.bool_and(F.expr("id <=> first")).alias("sends"))
    copies = written(copies, "copies")
    silent = copies.where("not sends").select("k", "t")
    speaking = keyed.join(small_or_not(silent), ["k", "t"], "left_anti")
    size, bits = _repeated_filter(speaking.select("text").mapInArrow(_anchors(window), "g long"))
    schema = "h long, g int, k long, t int, pos int"
    repeated = spark.sparkContext.broadcast(bits)
    sent = written(speaking.select("k", "t", "text").mapInArrow(_candidates(window, size, repeated), schema), "windows")
    repeated.destroy()
    again = written(sent.groupBy("h", "g").count().where("count > 1").select("h", "g"), "repeated-windows")
    marks = sent.join(small_or_not(again), ["h", "g"]).select("k", "t", "pos", F.lit(False).alias("copied"))
    marks = marks.unionByName(copies.select("k", "t", F.lit(None).cast("int").alias("pos"), F.lit(True).alias("copied")))
    marks = written(marks.groupBy("k", "t").agg(F.max("copied").alias("copied"), F.collect_list("pos").alias("found")), "marks")
    cut, schema = _cut(window)
    joined = keyed.join(marks, ["k", "t"], "left")
    out = joined.select("id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "found").mapInArrow(cut, schema)
    return out.withColumnRenamed("id", id_col)
