"""Quality rules: repetition and symbol counts, and perplexity bands of a modified Kneser-Ney model per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx
from tidemark.llm.wordpairs import discounts, doc_key, word_bits
from tidemark.llm.work import small_or_not, written
from tidemark.operators.counts import quantiles

#: Characters fold to 64 symbols and n-grams have four, so a language has at most 64**4 of them, whatever the data.
BITS = 6
ORDER = 4
_MASK = (1 << BITS) - 1
#: Entries of the models that one scoring pass broadcasts: no fewer than one language can have.
PASS_ENTRIES = sum(1 << (BITS * k) for k in range(1, ORDER + 1)) * 2
#: Rows that a counting task holds before it sends them on.
HELD = 2_000_000
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _fold_table() -> np.ndarray:
    """Symbols of ASCII: 0 white space, 1-26 letters, 27 digits, 28-43 other marks."""
    out = np.zeros(128, dtype=np.int32)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    for k, c in enumerate(marks):
        out[c] = 28 + k // 2
    for c in range(128):
        if chr(c).isdigit():
            out[c] = 27
        elif chr(c).isalpha():
            out[c] = ord(chr(c).lower()) - 96
        elif c < 32 and not 9 <= c <= 13 or c == 127:
            out[c] = 43
    return out


_FOLD = _fold_table()


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block and each text's bounds among them."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    return chars, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def _is_space(chars: np.ndarray) -> np.ndarray:
    return (chars == 32) | ((chars >= 9) & (chars <= 13))


def ngrams(chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of each text, white space runs as one symbol and both ends marked; and their bounds.  A text of white space has none."""
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds))
    space = _is_space(chars)
    keep = np.ones(len(chars), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1] & (of[1:] == of[:-1]))
    solid = np.bincount(of[~space], minlength=n) > 0
    keep &= solid[of]
    low = chars < 128
    s = np.where(low, _FOLD[np.where(low, chars, 0)], 44 + (chars % 20).astype(np.int32))[keep]
    of = of[keep]
    sizes = np.bincount(of, minlength=n) + np.where(solid, ORDER, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.zeros(ends[-1], dtype=np.int32)
    own = np.arange(len(s)) - np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])[of]
    padded[ends[of] + ORDER - 1 + own] = s
    codes = np.zeros(len(padded), dtype=np.int32)
    for k in range(ORDER):
        codes[ORDER - 1 :] |= padded[ORDER - 1 - k : len(padded) - k] << (BITS * k)
    predicted = np.arange(len(padded)) - np.repeat(ends[:-1], sizes) >= ORDER - 1
    return codes[predicted], np.concatenate([[0], np.cumsum(np.where(solid, sizes - ORDER + 1, 0))])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language's n-grams, added up within the task."""
    places: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys, kind="stable")
        counts = np.concatenate([c for _, c in held])[order]
        keys, starts = np.unique(keys[order], return_index=True)
        return keys, np.add.reduceat(counts, starts) if len(keys) else counts

    def sent(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(places), pa.string())
        for i in range(0, len(keys), 1 << 18):
            k = keys[i : i + (1 << 18)]
            columns = [names.take(pa.array(k >> 24)), pa.array((k & 0xFFFFFF).astype(np.int32)), pa.array(counts[i : i + (1 << 18)])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "code", "n"])

    rows = 0
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for first, past, data, offsets in tx.blocks(batch.column(0)):
            codes, ends = ngrams(*code_points(data, offsets))
            of = np.array([places.setdefault(x, len(places)) for x in langs[first:past]], dtype=np.int64)
            keys, counts = np.unique((np.repeat(of, np.diff(ends)) << 24) | codes, return_counts=True)
            held.append((keys, counts))
            rows += len(keys)
            if rows > HELD:
                held = [added()]
                rows = len(held[0][0])
                if rows > HELD // 2:
                    yield from sent(*held[0])
                    held, rows = [], 0
    if held:
        yield from sent(*added())


def _key(codes: np.ndarray, level: int) -> np.ndarray:
    return tx.mix(codes.astype(np.uint64) | np.uint64(level << 40))


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Hashes and values of an interpolated model: `seen` the discounted shares, `back` the weights of the lower order by context."""
    seen, back = [], []
    for level in range(ORDER, 0, -1):
        d = discounts(counts)[np.minimum(counts, 3)]
        contexts, at = np.unique(codes >> BITS, return_inverse=True)
        total = np.bincount(at, weights=counts)
        seen.append((_key(codes, level), (counts - d) / total[at]))
        back.append((_key(contexts, level), np.bincount(at, weights=d) / total))
        codes, counts = np.unique(codes & ((1 << (BITS * (level - 1))) - 1), return_counts=True)
    out = {}
    for name, parts in (("seen", seen), ("back", back)):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys)
        out[name] = (keys[order], np.concatenate([v for _, v in parts]).astype(np.float32)[order])
    return out


@dataclass
class Model:
    """One language's sorted hash arrays."""

    seen: tuple[np.ndarray, np.ndarray]
    back: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(table[0]):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at].astype(float), missing)

    def log2(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1.0 / (1 << BITS))
        for level in range(1, ORDER + 1):
            own = codes & ((1 << (BITS * level)) - 1)
            p = self._look(self.seen, _key(own, level), 0.0) + self._look(self.back, _key(own >> BITS, level), 1.0) * p
        return np.log2(p)


def _fit(key: tuple, group: pa.Table) -> pa.Table:
    codes, counts = group["code"].to_numpy().astype(np.int64), group["n"].to_numpy()
    order = np.argsort(codes)
    parts = []
    for name, (keys, values) in kneser_ney(codes[order], counts[order]).items():
        parts.append(pa.table({"lang": pa.array([key[0].as_py()] * len(keys), pa.string()), "part": [name] * len(keys), "key": keys.view(np.int64), "value": values}))
    return pa.concat_tables(parts)


def word_repeats(w: tx.Words, h: np.ndarray) -> np.ndarray:
    """For each text the words within 3-word windows that it holds twice or more."""
    n = len(w.bounds) - 1
    if len(h) < 3:
        return np.zeros(n, dtype=np.int64)
    of = np.repeat(np.arange(n), w.counts())
    starts = np.flatnonzero(of[2:] == of[:-2])
    keys = tx.mix(tx.rolling_hashes(h, 3)[starts] + tx.mix(of[starts].astype(np.uint64) + np.uint64(1)))
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = starts[counts[at] > 1]
    covered = np.zeros(len(h), dtype=bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(of[covered], minlength=n)


def duplicate_lines(text: Column) -> Column:
    """Lines of a text that hold a word and equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(F.size(lines) - F.size(F.array_distinct(lines)), F.lit(0)).cast("long")


def _doc_keys(langs: list[str], sequences: np.ndarray) -> np.ndarray:
    out = sequences.copy()
    names = np.array(langs, dtype=object)
    for lang in dict.fromkeys(langs):
        out[names == lang] = doc_key(lang, sequences[names == lang])
    return out


def _score(models):
    marks = np.array([ord(c) for c in SYMBOLS], dtype=np.uint32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, past, data, offsets in tx.blocks(batch.column(2)):
                size = past - first
                chars, bounds = code_points(data, offsets)
                of = np.repeat(np.arange(size), np.diff(bounds))
                codes, ends = ngrams(chars, bounds)
                langs = batch.column(1).slice(first, size).to_pylist()
                bits = np.zeros(size)
                places = np.array([list(dict.fromkeys(langs)).index(x) for x in langs])
                near = np.repeat(places, np.diff(ends))
                of_code = np.repeat(np.arange(size), np.diff(ends))
                for k, lang in enumerate(dict.fromkeys(langs)):
                    mine = np.flatnonzero(near == k)
                    if len(mine) and lang in models.value:
                        distinct, at = np.unique(codes[mine], return_inverse=True)
                        bits -= np.bincount(of_code[mine], weights=models.value[lang].log2(distinct)[at], minlength=size)
                w = tx.split_words(data, offsets)
                h = tx.word_hashes(w)
                n = np.diff(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, size), batch.column(1).slice(first, size), pa.array(w.counts().astype(np.int64)),
                        pa.array(np.bincount(of[~_is_space(chars)], minlength=size).astype(np.int64)),
                        pa.array(np.bincount(of[np.isin(chars, marks)], minlength=size).astype(np.int64)),
                        batch.column(3).slice(first, size),
                        pa.array(word_repeats(w, h).astype(np.int64)),
                        pa.array(bits / np.maximum(n, 1), mask=n == 0),
                        pa.array(_doc_keys(langs, tx.sequence_hashes(h, w.bounds)[0]).view(np.int64)),
                    ],
                    names=["id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "bits", "doc"],
                )

    return score


def _passes(sizes: list[tuple[str, int]]) -> list[list[str]]:
    """Languages by scoring pass, each within PASS_ENTRIES."""
    out: list[list[str]] = []
    room = 0
    for lang, size in sorted(sizes):
        if not out or size > room:
            out.append([])
            room = PASS_ENTRIES
        out[-1].append(lang)
        room -= size
    return out


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_words: int = 50, max_repeat_percent: int = 50, below: float = 4.0, above: float = 4.0, words_below: float = 16.0,
) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, bits.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in 3-word
    windows that recur in the text.  Of the rest, kept are those whose log2 perplexities (bits: per symbol, word_bits: per
    word, in its order) both lie within their language's bands.  A band reaches from the lower quartile less `below`
    quartile distances to the upper one plus `above`, over all documents that pass the base rules.  For word_bits it reaches down by
    `words_below`: a text that has copies or shares passages is well foretold by the others and isn't bad for it.

    The model of words is that of wordpairs.word_bits: pairs of words with modified Kneser-Ney discounts, in hash arrays that are dealt by
    context and grow with the corpus.  Each text is scored by the counts of all others.  The other is a modified Kneser-Ney of 4-grams over characters folded to 64 symbols: lower-case
    letters, digits, ASCII marks in pairs, other code points in twenty classes, white space runs as one.  All n-grams
    of all texts are counted, added up in each task and then in Spark; the lower orders follow from
    them.  A language has at most 64**4 n-grams however large the corpus, so its arrays, sorted by hash, can be
    fitted in one group and broadcast; languages beyond PASS_ENTRIES entries take a further pass.

    Defined cases: a null or wordless text has zero counts, no perplexity (null bits) and fails the
    base rules.  A null language counts as the language ''.  Every row is a document, repeated ids
    and null ids included.  Where all documents of a language have the same bits, they are kept.
    Extra columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text.alias("text"), duplicate_lines(text).alias("lines"))
    counted = base.select("text", "lang").mapInArrow(_count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    model = written(counted.groupBy("lang").applyInArrow(_fit, "lang string, part string, key long, value float"), "perplexity-model")
    sizes = [(r["lang"], r["count"]) for r in model.groupBy("lang").count().toLocalIterator()]
    found = []
    passes = _passes(sizes) or [[]]
    for langs in passes:
        models = spark.sparkContext.broadcast(_loaded(model.where(F.col("lang").isin(langs))) if langs else {})
        mine = base if len(passes) == 1 else base.where(F.col("lang").isin(langs))
        schema = "id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double, doc long"
        found.append(mine.mapInArrow(_score(models), schema))
    if len(passes) > 1:  # languages whose texts are all blank have no model
        found.append(base.where(~F.col("lang").isin([x for x, _ in sizes])).mapInArrow(_score(spark.sparkContext.broadcast({})), schema))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = written(out.withColumn("base_failed", failed), "perplexity-scores")
    per_word = word_bits(base, int(out.agg(F.sum("n_words")).first()[0] or 0)).select("doc", F.col("bits").alias("all_bits"))
    out = out.join(per_word, "doc", "left").withColumn("word_bits", F.when(F.col("n_words") > 0, F.col("all_bits") / F.col("n_words")))
    out = written(out.drop("all_bits", "doc"), "perplexity-word-scores")
    passed, inside = out.where("not base_failed"), F.lit(True)
    # Exact quartiles, so that no verdict hangs on how the rows are dealt.
    bits, of_words = (quantiles(passed, x, [0.25, 0.75], "lang").withColumnRenamed("quantiles", f"q_{x}") for x in ("bits", "word_bits"))
    bands = small_or_not(written(bits.join(of_words, "lang"), "perplexity-bands"))
    for x, below in (("bits", below), ("word_bits", words_below)):
        least, most = F.col(f"q_{x}")[0], F.col(f"q_{x}")[1]
        inside &= F.coalesce(F.col(x).between(least - below * (most - least), most + above * (most - least)), F.lit(False))
    return out.join(bands, "lang", "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "bits", "word_bits"
    )


def _loaded(rows: DataFrame) -> dict[str, Model]:
    """Models of one pass; its entries are bounded by PASS_ENTRIES."""
    table = rows.toArrow()
    out = {}
    langs, parts, keys, values = (table[c].combine_chunks() for c in ("lang", "part", "key", "value"))
    names, of = np.unique(langs.to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if len(langs) else ([], np.zeros(0, int))
    seen = parts.to_numpy(zero_copy_only=False) == "seen"
    keys, values = keys.to_numpy().view(np.uint64), values.to_numpy()
    for k, name in enumerate(names):
        both = []
        for kind in (True, False):
            at = np.flatnonzero((of == k) & (seen == kind))
            at = at[np.argsort(keys[at])]
            both.append((keys[at], values[at]))
        out[str(name)] = Model(*both)
    return out
