"""A quality classifier on supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx

#: Hash slots of words and word pairs, and as many again of character n-grams.
SLOTS = 1 << 17
GRAMS = (3, 4)
#: At most so many labelled rows, those with the least hashes of their id, train a model.
TRAIN_ROWS = 6000
DIM = 16
EPOCHS = 8


def feature_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of a block of texts, and the text of each: words, word pairs and character n-grams.

    A word that repeats the one before gives one common pair feature, whatever the word.  Character
    n-grams may begin or end with white space but hold none inside; all white space counts as one.
    """
    w = tx.split_words(data, offsets)
    h = tx.word_hashes(w)
    of_word = np.repeat(np.arange(len(offsets) - 1), w.counts())
    ids, of = [(h % np.uint64(SLOTS)).astype(np.int32)], [of_word]
    if len(h) > 1:
        same_text = of_word[1:] == of_word[:-1]
        pair = np.where(h[1:] == h[:-1], np.uint64(1), tx.mix(h[:-1] * np.uint64(3) + h[1:]))
        ids.append((pair % np.uint64(SLOTS)).astype(np.int32)[same_text])
        of.append(of_word[1:][same_text])
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    firsts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    of_char = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    chars = np.where(space, np.uint32(32), chars)
    for n in GRAMS:
        count = len(chars) - n + 1
        if count <= 0:
            continue
        ok = of_char[:count] == of_char[n - 1 :]
        for j in range(1, n - 1):
            ok &= ~space[j : j + count]
        g = np.full(count, 0x811C9DC5 + n, dtype=np.uint32)
        for j in range(n):
            g = (g ^ chars[j : j + count]) * np.uint32(0x01000193)
        g ^= g >> np.uint32(15)
        ids.append((SLOTS + (g[ok] % np.uint32(SLOTS))).astype(np.int32))
        of.append(of_char[:count][ok])
    return np.concatenate(ids), np.concatenate(of)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct slots and their counts for each text, as bytes: slots of four bytes, counts of the least width that holds them."""
    for batch in batches:
        for first, past, data, offsets in tx.blocks(batch.column(2)):
            ids, of = feature_ids(data, offsets)
            key, counts = np.unique(of.astype(np.int64) * (2 * SLOTS) + ids, return_counts=True)
            ends = np.searchsorted(key, np.arange(past - first + 1, dtype=np.int64) * (2 * SLOTS))
            slots, spans = (key % (2 * SLOTS)).astype(np.uint32), list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            widths = [np.min_scalar_type(int(counts[a:b].max(initial=0))) for a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, past - first),
                    batch.column(1).slice(first, past - first),
                    pa.array([slots[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([counts[a:b].astype(t).tobytes() for (a, b), t in zip(spans, widths, strict=True)], pa.binary()),
                ],
                names=["id", "label", "ids", "counts"],
            )


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and biases for two classes from (label, slots, counts) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2 * SLOTS, DIM)).astype(np.float32)
    weights, bias = np.zeros((2, DIM), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            label, ids, counts = rows[k]
            share = (counts / max(1, counts.sum(dtype=np.int64))).astype(np.float32)
            mean = share @ vectors[ids] if len(ids) else np.zeros(DIM, dtype=np.float32)
            out = weights @ mean + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1
            step = rate * (1 - done / steps)
            back = weights.T @ p
            weights -= step * np.outer(p, mean)
            bias -= step * 0.1 * p
            if len(ids):
                vectors[ids] -= (step * share)[:, None] * back
            done += 1
    return vectors, weights, bias


@dataclass
class QualityModel:
    """Softmax of a linear map of a mean of vectors: each slot's own log-odds can be summed up beforehand."""

    slot_odds: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for first, past, data, offsets in tx.blocks(texts):
            ids, of = feature_ids(data, offsets)
            n = np.bincount(of, minlength=past - first)
            total = np.bincount(of, weights=self.slot_odds[ids], minlength=past - first)
            out[first:past] = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Train on at most `rows` labelled documents, those whose ids have the least hashes.

    Labels other than 0 and 1, and null ids, are left out; an id labelled twice takes the larger
    label, an id with several texts is learned by the least of them.  Without labelled documents the model gives 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = joined.mapInArrow(_features, "id long, label int, ids binary, counts binary")
    # The bounded sample is trained on in one task, so that the driver only sees the model.
    fitted = rows.repartition(1).sortWithinPartitions("id").mapInArrow(_fit, "odds binary, bias double").first()
    if fitted is None:
        return QualityModel(np.zeros(2 * SLOTS, dtype=np.float32), 0.0)
    return QualityModel(np.frombuffer(bytes(fitted.odds), dtype=np.float32), fitted.bias)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = []
    for batch in batches:
        # Views of the batch's own memory, five bytes or so a slot.
        for y, ids, counts in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            slots, values = np.frombuffer(ids.as_buffer() or b"", dtype=np.uint32), counts.as_buffer() or b""
            found.append((y, slots, np.frombuffer(values, dtype=f"u{len(values) // max(1, len(slots))}") if len(slots) else np.zeros(0, np.uint8)))
    if found:
        vectors, weights, bias = train(found)
        odds = (vectors @ (weights[1] - weights[0])).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0])])], names=["odds", "bias"])


def scorer(docs: DataFrame, model: QualityModel):
    """A column function: text to the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts))

    return score


def with_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_where: Column | None = None, score_col: str = "score", rows: int = TRAIN_ROWS
) -> DataFrame:
    """docs with a column score_col (0 to 1, higher: better quality; any of that name is replaced).

    Words, word pairs and character n-grams are hashed to slots with learned vectors, a document is
    their mean, a softmax gives its class.  Scoring reads whole texts, block by block.  train_where limits the
    labelled rows to learn from, of which at most `rows` are taken (see fit).

    Defined cases: a null or empty text takes the prior.  Rows that repeat an id are scored each by its own text.
    A null id is scored and never learned from.  A text of any length is scored whole, in memory in proportion to the longest one.
    Other columns are returned as they are.  An empty table gives an empty result; without labels all score 0.5.
    """
    usable = labels if train_where is None else labels.where(train_where)
    model = fit(docs, usable, id_col, text_col, rows=rows)
    return docs.withColumn(score_col, scorer(docs, model)(F.col(text_col).cast("string")))
