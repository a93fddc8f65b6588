import os
import re

import numpy as np
import pytest

from tidemark.llm.tokens import build, read_ranks, with_token_counts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def greedy(word, pieces, longest):
    word, n, i = b" " + word, 0, 0
    while i < len(word):
        k = next((k for k in range(min(longest, len(word) - i), 0, -1) if word[i : i + k] in pieces), 0)
        if not k:
            return 1
        n, i = n + 1, i + k
    return n


def check(spark, texts, pieces):
    known, longest = set(pieces), max(map(len, pieces), default=0)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in with_token_counts(rows, pieces).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (got[i].n_words, got[i].n_tokens) == (len(words), sum(greedy(w.encode(), known, longest) for w in words)), t


def test_small_vocabularies(spark):
    rng = np.random.default_rng(6)
    for _ in range(4):
        pieces = [b" "] + [bytes(rng.choice(list(b" abcd"), rng.integers(1, 7))) for _ in range(40)]
        texts = ["".join(rng.choice(list("abcde "), 60, p=[0.25, 0.25, 0.2, 0.1, 0.02, 0.18])) for _ in range(60)]
        check(spark, [None, "", " \n\t", "a" * 30_000, *texts], pieces)


def test_failures_pop_several_pieces():
    a = build([b"a", b"abcdx", b"b", b"c", b"cdy"])
    data = np.frombuffer(b"abcdyabcdxabcd", dtype=np.uint8)
    assert a.lengths(data, np.array([0, 5, 10]), np.array([5, 10, 14])).tolist() == [3, 1, 1]


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary file")
def test_public_vocabulary(spark):
    texts = ["The quick brown fox", "Unzählige größte Wörter, naïve façade", "日本語 テスト", "x" * 500, "don't stop... now!!", "a b"]
    check(spark, texts, read_ranks(RANKS))


def test_empty(spark):
    check(spark, ["a b", None], [])
    assert with_token_counts(spark.createDataFrame([], "text string"), [b"a"]).count() == 0
