"""Many terms in one pass, against searches one by one."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.matching import Trie
from tidemark.operators import lexicon


def plain(text, terms, most):
    """Counts of padded terms by plain text search, nothing counted twice."""
    return {k: min(n, most) for k, t in enumerate(terms) if (n := f" {text} ".count(f" {' '.join(t)} "))}


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_those_of_text_search(seed):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "c", "dd", "é"][: 2 + seed % 4]
    terms = tuple({tuple(rng.choice(words, rng.integers(1, 5))) for _ in range(30)}) + (("zz",), ("a", "zz"), ())
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 40, 60)] + ["", None]
    text, term, n = Trie(terms).counted(pa.array(texts).slice(1), 3)
    got = {}
    for t, k, c in zip(text.tolist(), term.tolist(), n.tolist(), strict=True):
        got.setdefault(t, {})[k] = c
    for at, value in enumerate(texts[1:]):
        assert got.get(at, {}) == {k: c for k, c in plain(value or "", terms, 3).items() if terms[k]}, value


def test_terms_of_equal_words_all_count():
    trie = Trie((("sign", "on"), ("sign", "on"), ("on",)))
    assert [x.tolist() for x in trie.counted(pa.array(["sign on on"]), 9)] == [[0, 0, 0], [0, 1, 2], [1, 1, 1]]


def test_a_lexicon_of_four_hundred_terms(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(300)]
    terms = {" ".join(rng.choice(words, rng.integers(1, 4))): float(k % 7) for k in range(400)}
    texts = [(" ".join(rng.choice(words, 6)), " ".join(rng.choice(words, rng.integers(0, 400)))) for _ in range(40)]
    frame = spark.createDataFrame([(k, f" {t} ", f" {b} ".replace("  ", " ")) for k, (t, b) in enumerate(texts)], "k int, t string, b string")
    score, hits = lexicon.axis(terms, F.col("t"), F.col("b"))
    for r in frame.select("k", score.alias("score"), hits.alias("hits")).collect():
        title, body = (f" {x} " for x in texts[r.k])
        want = sum(w * 2.5 * (f" {t} " in title) + w * min(body.count(f" {t} "), 3) for t, w in terms.items())
        assert abs(r.score - want) < 1e-9 and r.hits == [t for t in terms if f" {t} " in title or f" {t} " in body]


def test_no_terms_and_empty_tables(spark):
    frame = spark.createDataFrame([(" a ", None)], "t string, b string")
    score, hits = lexicon.axis({}, F.col("t"), F.col("b"))
    assert frame.select(score, hits).first() == (0.0, []) and frame.limit(0).select(score, hits).count() == 0
