import re
from collections import Counter

import numpy as np

from tidemark.llm import wordpairs
from tidemark.llm.perplexity import BITS, Model, _passes, kneser_ney, quality_rules

SCHEMA = "doc_id long, text string, lang string, n_words string, bits string"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
        len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def texts():
    rng = np.random.default_rng(3)
    stems = ["lo", "ma", "ti", "ren", "só", "über", "ka", "日本", "o", "x#"]
    out = [None, "", " \t\n\x0b ", "word", "a b c a b c", "a a a a a", "x\n x\nx\n\n\nx", "  one two", "# * $ %\n&|<>"]
    out += [" ".join("".join(rng.choice(stems, 3)) for _ in range(rng.integers(1, 200))) for _ in range(80)]
    out += [out[-1] + "\n" + out[-1], " ".join(["same"] * 100), "long" * 50_000 + " end"]
    return out


def test_base_counts(spark):
    rows = [(i, t, ["en", "de", None][i % 3], "x", "y") for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), (i, t)
        assert not (r.kept and r.base_failed)
        assert (r.bits is None) == (r.n_words == 0)


def test_model_is_a_distribution():
    rng = np.random.default_rng(4)
    sequence = rng.choice([0, 1, 2, 3, 9], 3000, p=[0.3, 0.3, 0.2, 0.1, 0.1])
    codes = sum(sequence[3 - k : len(sequence) - k].astype(np.int64) << (BITS * k) for k in range(4))
    keys, counts = np.unique(codes, return_counts=True)
    model = Model(**kneser_ney(keys, counts))
    for context in (keys[0] >> BITS, keys[-1] >> BITS, 7 << 12 | 5 << 6 | 3):
        p = 2 ** model.log2((np.int64(context) << BITS) | np.arange(1 << BITS, dtype=np.int64))
        assert abs(p.sum() - 1) < 1e-4


def test_bands_reject_foreign_text(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeiou"), 4)) for _ in range(300)]
    odd = " ".join("".join(rng.choice(list("zxqjkw#|9"), 6)) for _ in range(120))
    rows = [(i, " ".join(rng.choice(plain, 120)), "en", "x", "y") for i in range(200)] + [(999, odd, "en", "x", "y")]
    got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got.pop(999)
    assert sum(got.values()) >= 198


def test_empty_and_passes(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert _passes([("a", 30_000_000), ("b", 30_000_000), ("c", 1), ("d", 2)]) == [["a"], ["b", "c", "d"]]


def test_bands_reject_word_salad(spark):
    rng = np.random.default_rng(6)
    after = rng.integers(0, 300, (300, 3))  # prose of three possible next words
    words = ["aaa" + "".join(rng.choice(list("aeiounrst"), 4)) + "aaa" for _ in range(300)]  # four characters over an end tell nothing

    def prose():
        at = [int(rng.integers(300))]
        while len(at) < 120:
            at.append(int(after[at[-1], rng.integers(3)]))
        return [words[k] for k in at]

    rows = [(i, " ".join(prose()), "en", "x", "y") for i in range(200)] + [(900 + i, " ".join(rng.permutation(prose())), "en", "x", "y") for i in range(5)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i].kept for i in got if i >= 900)
    assert sum(r.kept for i, r in got.items() if i < 900) >= 198


def test_word_model_against_plain_python(spark, monkeypatch):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(list("abcde"), 40, p=[0.5, 0.3, 0.1, 0.07, 0.03])) for _ in range(6)] + ["only here and nowhere else"]
    own = [Counter(zip(["", *t.split()], t.split())) for t in texts]
    pairs = sum(own, Counter())
    n = [sum(v == k for v in pairs.values()) for k in range(1, 5)]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0 for k in range(3)]
    d = [0] + [x if 0 < x < k + 1 else 0.5 * (k + 1) for k, x in enumerate(d)]
    total, freed = Counter(), Counter()
    for (c, _), k in pairs.items():
        total[c] += k
    for (c, w), k in pairs.items():
        freed[c] += d[min(k, 3)]
    want = []
    for t, mine in zip(texts, own, strict=True):
        used, bits = Counter(), 0.0
        for (c, _), k in mine.items():
            used[c] += k
        for (c, w), k in mine.items():
            left, others = pairs[c, w] - k, total[c] - used[c]
            p = max(left - d[min(left, 3)], 0) / others + min(freed[c] / total[c], 1) / 2**20 if others else 1 / 2**20
            bits -= k * np.log2(p)
        want.append(bits / len(t.split()))
    rows = [(i, t, "en", "x", "y") for i, t in enumerate(texts)] + [(50, " \n", "en", "x", "y"), (51, None, None, "x", "y")]
    got = {r.doc_id: r.word_bits for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(abs(got[i] - x) < 1e-5 for i, x in enumerate(want)) and got[50] is None and got[51] is None
    # Many shards estimate discounts each on its own, but lose no pair: each text keeps at least as much as its words are foretold by chance.
    monkeypatch.setattr(wordpairs, "SHARD_WORDS", 10)
    many = {r.doc_id: r.word_bits for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(abs(many[i] - x) < 0.35 * x for i, x in enumerate(want)) and abs(many[6] - 20) < 0.5


def test_languages_are_models_of_their_own(spark):
    text = "one two three four five six"
    rows = [(0, text, "en", "x", "y"), (1, text, "de", "x", "y"), (2, text + " seven", "en", "x", "y")]
    got = {r.doc_id: r.word_bits for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert abs(got[1] - 20) < 0.5 and got[0] < 10


def test_packed_entries_come_back():
    rng = np.random.default_rng(8)
    for size, top in ((1, 1), (3000, 1 << 40)):
        context, word, doc = rng.integers(0, top, size, dtype=np.uint64) // (top // 40 + 1), rng.integers(0, 1 << 32, size, dtype=np.uint64) >> np.uint64(27), rng.integers(0, 1 << 16, size)
        order = np.lexsort((doc, word, context))
        n = rng.integers(1, 1 << 20, size)
        sent = (context[order], word[order], doc[order], n)
        assert all((x == y).all() for x, y in zip(wordpairs.unpacked(memoryview(wordpairs.packed(*sent))), sent, strict=True))
