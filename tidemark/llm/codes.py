"""Vectors as codes of nearest codebook entries, found by segment-mean lower bounds and exact integer distances."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.work import small_or_not, written

#: Components are whole numbers of 1/SCALE, at most LARGEST of them either way; vectors have at most LONGEST components.
SCALE, LARGEST, LONGEST = 256, 1 << 24, 8192
#: Vectors compared at a time inside a task.
BLOCK = 4096


def whole(vec: Column) -> Column:
    """floor(SCALE * x) of each component."""
    return F.transform(vec, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * SCALE))).cast("int"))


def usable(vec: Column) -> Column:
    """Not null, and without null and non-finite components."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _widths(length: int) -> list[int]:
    """Segment widths from coarse to fine; segments of one component would be the distance itself."""
    out, width = [], length
    while width >= 2:
        out.append(width)
        width = (width + 1) // 2
    return out


def _segments(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means times the root of the width, and residual norms, of each row's segments; both from exact whole numbers."""
    starts = np.arange(0, rows.shape[1], width)
    size = np.diff(np.append(starts, rows.shape[1]))
    total = np.add.reduceat(rows, starts, axis=1)
    rest = size * np.add.reduceat(rows * rows, starts, axis=1) - total * total
    root = np.sqrt(size)
    return total / root, np.sqrt(rest) / root


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of the book (lower ones first) for each row of whole numbers, and the squared distance.

    A distance is never less than the distance of the segments' means and of the norms of what the means leave: the bound.
    At each width, from coarse to fine, rows with several entries left get their bounds, as one product of matrices; the entry of the
    least bound gets its exact distance, and entries whose bound exceeds the least exact distance so far are out.  What survives all
    widths gets its exact distance.  Bounds are lowered by far more than rounding can add, so no nearest entry is lost.  Where
    sums of squares would leave 63 bits, all entries survive.
    """
    n, length = rows.shape
    if not n or not length or len(book) == 1:
        d = rows - book[0]
        return np.zeros(n, dtype=np.int64), np.einsum("ij,ij->i", d, d)
    most = int(max(np.abs(rows).max(), np.abs(book).max(), 1))
    bounded = length * length * most * most < 1 << 62
    alive, least, open_ = np.ones((n, len(book)), dtype=bool), np.full(n, np.iinfo(np.int64).max), np.arange(n)
    for width in _widths(length) if bounded else []:
        x, c = (np.hstack(_segments(v, width)) for v in (rows[open_], book))
        x2, c2 = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", c, c)
        bound = x @ (-2 * c.T) + c2  # less x2, the same for all entries of a row
        bound[~alive[open_]] = np.inf
        d = rows[open_] - book[bound.argmin(axis=1)]
        least[open_] = np.minimum(least[open_], np.einsum("ij,ij->i", d, d))
        slack = 1e-11 * (x2 + c2.max()) + 1
        alive[open_] = kept = bound <= (least[open_] - x2 + slack)[:, None]
        open_ = open_[np.count_nonzero(kept, axis=1) > 1]
        if not len(open_):
            break
    at, entry = np.nonzero(alive)
    d = rows[at] - book[entry]
    exact = np.einsum("ij,ij->i", d, d)
    starts = np.searchsorted(at, np.arange(n))
    least = np.minimum.reduceat(exact, starts)
    first = np.minimum.reduceat(np.where(exact == least[at], entry, len(book)), starts)
    return first, least


def _matrix(lists: pa.Array, length: int) -> np.ndarray:
    """Lists of whole numbers as rows of `length`, zeros behind shorter ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == length).all():
        return flat.reshape(len(lists), length)
    out = np.zeros((len(lists), length), dtype=np.int64)
    out[np.arange(length) < sizes[:, None]] = flat
    return out


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows, their vectors by part, the nearest entries and the squared distances."""
    parts, _, length = books.shape
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            vectors = _matrix(rows.column("vec"), parts * length).reshape(-1, parts, length)
            found = [nearest(np.ascontiguousarray(vectors[:, p]), books[p]) for p in range(parts)]
            yield rows, vectors, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(books: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, length = books.shape
        total, count = np.zeros((parts * entries, length), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for _, vectors, index, _ in _assigned(batches, books):
            slots = index + np.arange(parts) * entries
            np.add.at(total, slots.reshape(-1), vectors.reshape(-1, length))
            count += np.bincount(slots.reshape(-1), minlength=len(count))
        used = np.flatnonzero(count)
        slot, place = np.repeat(used, length), np.tile(np.arange(length), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, place, total[slot, place], count[slot])], names=["slot", "place", "total", "n"])

    return sums


def _encoded(books: np.ndarray):
    digits = np.array([f"{k:02x}" for k in range(256)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, index, distance in _assigned(batches, books):
            codes = ["".join(x) for x in digits[index]]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], names=["id", "label", "code", "error"])

    return encode


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label and whole-number vec of the usable rows, written once."""
    vec = F.col(f"`{vec_col}`")
    rows = vectors.where(usable(vec)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), whole(vec).alias("vec"))
    return written(rows, "whole-vectors")


def fit_codebooks(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray:
    """Codebooks of prepared rows, an array by part, entry and place; entries are at most 256.

    They start as the parts of the rows of the least ids (then least vectors; null ids last), of all rows if these are fewer.
    In each round every row's parts are assigned, and an entry becomes the floor of its parts' mean; an unused one stays.
    Sums are added up inside tasks; entries * dim numbers come to the driver.
    """
    if entries > 256:
        raise ValueError("codes have two hex digits a part: at most 256 entries")
    longest = rows.agg(F.max(F.size("vec"))).first()[0] or 0
    if longest > LONGEST:
        raise ValueError(f"vectors of {longest} components; at most {LONGEST}")
    length = -(-longest // parts)
    firsts = rows.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).collect()
    start = np.zeros((len(firsts), parts * length), dtype=np.int64)
    for k, row in enumerate(firsts):
        start[k, : len(row.vec)] = row.vec
    books = start.reshape(len(firsts), parts, length).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(firsts) and length else 0):
        sums = rows.select("vec").mapInArrow(_sums(books), "slot long, place long, total long, n long").groupBy("slot", "place")
        for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            books[r.slot // len(firsts), r.slot % len(firsts), r.place] = int(r.total) // r.n
    return books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers of the codebooks by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distances, added up) of prepared rows."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    if not books.size:
        return rows.select("id", "label", F.lit("00" * books.shape[0]).alias("code"), F.lit(0).cast("long").alias("error"))
    return rows.mapInArrow(_encoded(books), f"id {types['id']}, label {types['label']}, code string, error long")


def decoded(codes: DataFrame, books: np.ndarray, code_col: str = "code", name: str = "vec") -> DataFrame:
    """codes with `name`: the vector that each code stands for, in units of the input; a null code gives null."""
    parts = F.from_json(F.lit(json.dumps((books / SCALE).tolist())), "array<array<array<double>>>")
    at = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.conv(F.substring(F.col(code_col), 2 * p + 1, F.lit(2)), 16, 10).cast("int"))
    return codes.withColumn(name, F.when(F.col(code_col).isNotNull(), F.flatten(F.zip_with(parts, at, lambda book, k: F.element_at(book, k + 1)))))


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2
) -> DataFrame:
    """id, code, error, label_error (long) and codebooks_sha256 of each usable row of vectors.

    Components become floor(256 * x) and vectors are cut into equal parts, each with a codebook of its own (fit_codebooks).
    A code names the nearest entry of each part, error adds up their squared distances, label_error the errors of all rows of a label.

    The whole-number vectors are written once; every round is one pass over them without a shuffle of rows.  In a task,
    entries are sorted out by bounds (nearest).  Codebooks are entries * dim numbers, dim at most 8,192, and go with the tasks.

    Defined cases: vectors that are null or hold null or non-finite components are dropped.  Vectors shorter than the
    longest, and all if its length isn't a multiple of `parts`, end in zeros; vectors of no component have code 00... and error 0.
    Components beyond 65,536 either way count as that.  Rows of one id start codebooks in the order of their vectors; null ids do so last and
    are returned.  Null labels are one label.  Extra columns are ignored, whatever their names.  Empty in, empty out.
    """
    rows = prepared(vectors, id_col, vec_col, label_col)
    books = fit_codebooks(rows, parts, entries, rounds)
    out = written(encoded(rows, books), "vector-codes")
    sums = written(out.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    out = out.join(small_or_not(sums), F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
