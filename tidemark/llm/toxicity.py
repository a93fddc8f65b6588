"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.work import unused, written

#: Insults, by strength; a parameter of the operator.
LEXICON = {
    "strong": ["idiot", "moron", "scum", "loser", "pathetic", "worthless", "disgusting", "stupid", "trash", "filth", "vermin", "imbecile", "bastard", "whore", "slut", "retard"],
    "mild": ["clown", "fool", "dumb", "ugly", "garbage", "liar", "coward", "creep", "freak", "jerk", "lazy", "useless", "hate", "crap", "damn", "shut", "kill", "die", "sucks", "shame"],
}
SECOND_PERSON = ["you", "your", "yours", "youre", "yourself", "u", "ur", "tu", "toi", "vous", "du", "dich", "dir", "dein", "usted", "ustedes", "ti"]
#: Characters that stand for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
NEAR = 5
#: At most so many labelled rows, those with the least hashes of their id, train the trees and the calibration.
TRAIN_ROWS = 12_000
#: A run of so many bytes of a word in boundary marks (a shorter word whole) is learned as toxic if at least this share of the
#: toxic texts that it is learned on have it, and their words have it so many times as often a text as those of the others.
GRAM = 6
GRAM_SHARE = 0.02
GRAM_ODDS = 20.0
FEATURES = [
    "learned", "learned_hits", "strong", "mild", "strong_hits", "any_hits", "disguised", "near_second_person", "second_person", "capital_letters", "capital_words",
    "exclamations", "questions", "other_punctuation", "punctuation_runs", "digits", "log_words", "mean_word",
]


def _hashes(words: list[str]) -> np.ndarray:
    joined = pa.array(words)
    out = []
    for _, _, data, offsets in tx.blocks(joined):
        out.append(tx.word_hashes(tx.split_words(data, offsets, lower=True)))
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Byte maps: letters in lower case with all else as a space; the same with disguises as letters."""
    plain = np.full(256, 32, dtype=np.uint8)
    plain[128:] = np.arange(128, 256)
    plain[97:123] = np.arange(97, 123)
    plain[65:91] = np.arange(97, 123)
    masked = plain.copy()
    for a, b in DISGUISES.items():
        masked[ord(a)] = ord(b)
    return plain, masked


def gram_hashes(w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of GRAM bytes of each word between boundary marks, a shorter word as one run; and each run's word."""
    sizes = w.ends - w.starts + 2
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    of = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(bounds[-1]) - bounds[of] - 1
    marked = np.where((at < 0) | (at == sizes[of] - 2), np.uint8(32), w.data[np.clip(w.starts[of] + at, 0, max(0, len(w.data) - 1))]) if len(of) else np.zeros(0, np.uint8)
    runs = np.maximum(sizes - GRAM + 1, 1)
    word = np.repeat(np.arange(len(sizes)), runs)
    first = bounds[word] + np.arange(len(word)) - np.repeat(np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) if len(runs) else np.zeros(0, np.int64)
    out = np.zeros(len(word), dtype=np.uint64)
    for k in range(GRAM):
        # Six bytes and a mark of length fit into 64 bits.
        inside = k < sizes[word]
        out = out << np.uint64(8) | np.where(inside, marked[np.minimum(first + k, max(0, len(marked) - 1))], 0).astype(np.uint64) if len(marked) else out
    return tx.mix(out), word


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    plain, _ = _tables()
    for batch in batches:
        labels = batch.column(0).to_numpy()
        for first, past, data, offsets in tx.blocks(batch.column(1)):
            w = tx.split_words(plain[data], offsets)
            h, word = gram_hashes(w)
            of = np.repeat(np.arange(past - first), w.counts())[word].astype(np.uint64)
            order = np.lexsort((h, of))
            h, of = h[order], of[order]
            starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
            n = np.diff(np.append(starts, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(labels[first + of[starts].astype(np.int64)]), pa.array(h[starts].view(np.int64)), pa.array(n)], names=["label", "gram", "n"])


def learned_grams(train: DataFrame) -> np.ndarray:
    """Hashes of runs of letters that mark toxic training texts.  The training rows are bounded, so these are too."""
    sizes = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    counted = train.select("label", "text").mapInArrow(_grams, "label double, gram long, n long").groupBy("gram")
    counted = counted.agg(F.sum("label").alias("texts"), F.sum(F.col("label") * F.col("n")).alias("t"), F.sum((F.lit(1.0) - F.col("label")) * F.col("n")).alias("c"))
    marks = counted.where((F.col("texts") >= max(3.0, GRAM_SHARE * toxic)) & (F.col("t") * clean >= GRAM_ODDS * toxic * (F.col("c") + 0.5)))
    return np.sort(np.array([r.gram for r in marks.select("gram").collect()], dtype=np.int64).view(np.uint64))


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted table."""
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h if len(table) else np.zeros(len(h), dtype=bool)


class TextFeatures:
    """Dense features of texts, by whole blocks of bytes."""

    def __init__(self, lexicon: dict[str, list[str]], learned: np.ndarray):
        self.learned = learned
        self.strong, self.mild, self.second = _hashes(lexicon["strong"]), _hashes(lexicon["mild"]), _hashes(SECOND_PERSON)
        self.any = np.sort(np.concatenate([self.strong, self.mild]))
        self.plain, self.masked = _tables()

    def __call__(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(FEATURES)))
        for first, past, data, offsets in tx.blocks(texts):
            out[first:past] = self._block(data, offsets)
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

        w = tx.split_words(self.plain[data], offsets)
        h = tx.word_hashes(w)
        words = w.counts().astype(float)
        n = np.maximum(words, 1)
        strong, listed, second = np.isin(h, self.strong), np.isin(h, self.any), np.isin(h, self.second)
        grams, word = gram_hashes(w)
        learned = np.bincount(word[_among(grams, self.learned)], minlength=len(h)) > 0
        any_hit = listed | learned
        said = np.concatenate([[0], np.cumsum(second)])
        at = np.flatnonzero(any_hit)
        of = np.searchsorted(w.bounds, at, side="right") - 1
        near = np.zeros(len(h), dtype=bool)
        near[at] = said[np.minimum(at + NEAR + 1, w.bounds[of + 1])] > said[np.maximum(at - NEAR, w.bounds[of])]
        m = tx.split_words(self.masked[data], offsets)
        hidden = np.isin(tx.word_hashes(m), self.any)
        strong_n, any_n, learned_n = per_text(strong, w.bounds), per_text(listed, w.bounds), per_text(learned, w.bounds)
        disguised = np.maximum(per_text(hidden, m.bounds) - any_n, 0)
        upper = (data >= 65) & (data <= 90)
        letters = self.plain[data] != 32
        size = np.maximum(np.diff(offsets), 1).astype(float)
        mark, ask = data == 33, data == 63
        punct = (~letters) & (data > 32) & ~((data >= 48) & (data <= 57))
        run = np.zeros(len(data), dtype=bool)
        if len(data) > 1:
            run[1:] = punct[1:] & punct[:-1]
        ups = np.concatenate([[0], np.cumsum(upper)])
        length = w.ends - w.starts
        shouted = (ups[w.ends] - ups[w.starts] == length) & (length > 1)
        letter_n = np.maximum(per_text(letters, offsets), 1)
        columns = [
            learned_n / n, learned_n, strong_n / n, (any_n - strong_n) / n, strong_n, any_n, disguised / n, per_text(near, w.bounds), per_text(second, w.bounds) / n,
            per_text(upper, offsets) / letter_n, per_text(shouted, w.bounds) / n, per_text(mark, offsets) / size, per_text(ask, offsets) / size,
            per_text(punct & ~mark & ~ask, offsets) / size, per_text(run, offsets) / size, per_text((data >= 48) & (data <= 57), offsets) / size,
            np.log1p(words), letter_n / n,
        ]
        return np.stack(columns, axis=1)


def feature_column(docs: DataFrame, lexicon: dict[str, list[str]], learned: np.ndarray):
    """A column function: text to its array of FEATURES."""
    shared = docs.sparkSession.sparkContext.broadcast(TextFeatures(lexicon, learned))

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        values = shared.value(texts)
        return pa.FixedSizeListArray.from_arrays(pa.array(values.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float64()))

    return features


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, lexicon: dict[str, list[str]]
) -> tuple[PipelineModel, np.ndarray] | None:
    """From at most `rows` labelled documents, dealt by a hash of their id: two fifths give the learned lexicon, two the trees, one the calibration.

    The lexicon is thus never learned on rows that grow the trees, which would trust it too much.  None where a class is missing.
    An id with several texts is learned by the least of them.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    part = F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(5))
    found = written(found.select("id", "label", "text", part.alias("part")), "toxicity-sample")
    learned = learned_grams(found.where("part > 2"))
    found = found.where("part <= 2").select("id", "label", "part", feature_column(docs, lexicon, learned)(F.col("text")).alias("values"))
    found = written(found.coalesce(4), "toxicity-features").withColumn("features", array_to_vector("values"))
    train, rest = found.where("part > 0"), found.where("part = 0")
    if train.select("label").distinct().count() < 2 or rest.isEmpty():
        return None
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.3, seed=3, maxBins=32).fit(train)
    scored = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("raw"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(scored)
    return PipelineModel([trees, isotonic]), learned


def with_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    train_where: Column | None = None, rows: int = TRAIN_ROWS, lexicon: dict[str, list[str]] | None = None, score_col: str = "score",
) -> DataFrame:
    """docs with a column score_col (0 to 1, higher: toxic likelier; any of that name is replaced).

    Features of whole texts: densities of two given lexicons, plain and in disguised spelling, and of
    words with a run of letters that marks toxic texts in the training rows (insults of any language), hits within
    five words of a second-person word, capitals and punctuation.  A thousandth of the score comes
    from the trees' own probability, so that texts of one isotonic step keep their order.  At most `rows`
    labelled rows are learned from.

    Defined cases: a null or empty text has zero features and is scored like any other.  Where labels hold but one
    class, the score is 0.5.  Rows that repeat an id are scored each by its own text.  A null id is scored and never
    learned from.  A text of any length is read whole, in memory in proportion to the longest one.  Other columns, whatever
    their names, are returned as they are.  An empty table gives an empty result.
    """
    usable = labels if train_where is None else labels.where(train_where)
    fitted = fit(docs, usable, id_col, text_col, label_col, rows, lexicon := lexicon or LEXICON)
    shown = [F.col(f"`{c}`") for c in docs.columns if c.lower() != score_col.lower()]
    if fitted is None:
        return docs.select(*shown, F.lit(0.5).alias(score_col))
    (trees, isotonic), learned = (x.copy() for x in fitted[0].stages), fitted[1]
    values, features, raw, chance, guess, one, calibrated = unused(docs.columns, "values", "features", "rawPrediction", "probability", "prediction", "raw", "calibrated")
    trees.setFeaturesCol(features).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol(guess)
    isotonic.setFeaturesCol(one).setPredictionCol(calibrated)
    out = docs.withColumn(values, feature_column(docs, lexicon, learned)(F.col(text_col).cast("string")))
    out = trees.transform(out.withColumn(features, array_to_vector(values))).withColumn(one, vector_to_array(chance)[1])
    return isotonic.transform(out).select(*shown, (F.lit(0.999) * F.col(calibrated) + F.lit(0.001) * F.col(one)).alias(score_col))
