import re

import numpy as np
import pyarrow as pa

from tidemark.llm import minhash
from tidemark.llm import text as tx
from tidemark.llm.minhash import near_duplicates, signature

SCHEMA = "doc_id long, text string, kept string, component_id string"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute(rows, n):
    sets = [shingles(t, n) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b, x, y = sets[i], sets[j], rows[i][0], rows[j][0]
            if a and b and x is not None and y is not None and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(x), top(y)))
                parent[y] = x
    return sorted((i, len(s), top(i), top(i) == i) for (i, _), s in zip(rows, sets) if i is not None)


def got(spark, rows, n):
    out = near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), shingle=n).collect()
    assert len(out) == len(rows)
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None)


def groups(rng, sizes, words=60, edits=14):
    vocabulary = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(400)]
    rows = []
    for size in sizes:
        text = list(rng.choice(vocabulary, words))
        for _ in range(size):
            copy = list(text)
            for _ in range(rng.integers(0, edits)):
                at = rng.integers(0, len(copy))
                if rng.random() < 0.5:
                    copy[at] = str(rng.choice(vocabulary))
                else:
                    del copy[at]
            rows.append(" ".join(copy))
    return rows


def test_groups_of_near_copies(spark):
    texts = groups(np.random.default_rng(12), [60, 25, 5, 2, 2, 1, 1] + [2] * 10)
    texts += [texts[0].upper(), texts[3], texts[3] + " \n", texts[3].replace(" ", "\t ")]
    rows = [(int(i), t) for i, t in zip(np.random.default_rng(13).permutation(len(texts)), texts)]
    assert got(spark, rows, 4) == brute(rows, 4)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    rows = list(enumerate(groups(np.random.default_rng(14), [50, 20, 3], edits=20)))
    assert got(spark, rows, 5) == brute(rows, 5)


def chained(names, spans):
    """Components by _compare of one block of sets of numbers: a span of the line, or its own numbers."""
    sets = {x: np.arange(2 * spans[x], 2 * spans[x] + 20) if x in spans else np.arange(20) + 1000 * (k + 1) for k, x in enumerate(names)}
    n, zero = len(names), pa.array([0] * len(names), pa.int64())
    held = pa.array([sets[x].tolist() for x in names], pa.list_(pa.int64()))
    rows = pa.table({"id": range(n), "component": range(n), "b1": zero, "b2": zero, "b3": zero, "turn": [k > 0 for k in range(n)], "shingles": held})
    top = list(range(n))
    for u, v in minhash._compare(rows, 80, 192):
        top = [top[u] if t == top[v] else t for t in top]
    return [{x for x, t in zip(names, top) if t == k} for k in dict.fromkeys(top)]


def test_chains_within_a_block():
    line = {"x1": 0, "x2": 1, "y2": 2, "y1": 3, "y3": 4}  # each is linked with the next alone
    assert set(line) in chained(["h", "x1", "x2", "y1", "y2", "y3", "f1", "f2", "f3"], line)
    rng = np.random.default_rng(16)
    for _ in range(200):
        spans = {f"x{k}": k for k in range(rng.integers(2, 12))}
        names = [str(x) for x in rng.permutation([*spans, "h", *(f"f{k}" for k in range(8))])]
        assert sorted(map(len, chained(names, spans))) == [1] * 9 + [len(spans)]


def test_chains_in_large_buckets(spark):
    words = [f"w{k}" for k in range(2400)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    hashes = tx.rolling_hashes(tx.word_hashes(tx.split_words(data, np.array([0, len(data)]), lower=True)), 1)
    texts = []
    for k in range(0, 2400, 200):
        own = words[k : k + 200]
        # A bucket for each 200 words: the word with the least place is in all of its texts, eight in a chain and six strangers, and there is one band of one row.
        least = own.pop(int(np.argmin([signature(hashes[j : j + 1], 1)[0] for j in range(k, k + 200)])))
        texts += [" ".join([least, *own[j : j + 19]]) for j in [*range(0, 16, 2), *range(60, 180, 20)]]
    rows = [(int(i), t) for i, t in zip(np.random.default_rng(17).permutation(len(texts)), texts)]
    out = near_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA), shingle=1, bands=1, rows=1).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == brute(rows, 1)


def test_odd_rows(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (6, "one"), (5, "One"), (4, "one two three"), (3, "one two three four five"), (2, "ONE two three four five"), (2, "ONE two three four five"), (1, "a b c d " * 30_000), (0, "a b c d " * 29_000)]
    assert got(spark, rows, 4) == brute(rows, 4)
    out = near_duplicates(spark.createDataFrame([(None, "a b c d e", "", ""), (3, "a b c d e", "", ""), (None, "z y", "", ""), (None, None, "", "")], SCHEMA)).collect()
    assert sorted(((r.component_id, r.kept) for r in out), key=str) == [(3, False), (3, True), (None, True), (None, True)]
    assert got(spark, [], 4) == []


def test_coordinates_agree_as_often_as_jaccard_says():
    rng = np.random.default_rng(15)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = signature(pool[:1000], 1000), signature(pool[500:], 1000)
    assert abs((a == b).mean() - 1 / 3) < 0.08
