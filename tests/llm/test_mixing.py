import hashlib
from collections import defaultdict
from fractions import Fraction

import numpy as np

from tidemark.llm import mixing
from tidemark.llm.mixing import mix

SCHEMA = "doc_id long, domain string, lang string, source string, n_tokens long, epoch string"


def filled(children, budget):
    """Integer shares by repeated filling: {name: (cap, weight)}."""
    got, open_, left = dict.fromkeys(children, 0), {c for c, (_, w) in children.items() if w > 0}, budget
    while open_:
        weight = sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] <= Fraction(children[c][1] * left, weight)}
        if not full:
            for c in open_:
                got[c] = children[c][1] * left // weight
            break
        for c in full:
            got[c] = children[c][0]
            left -= children[c][0]
        open_ -= full
    return got


def brute(rows, weights, share, epochs, seed):
    leaf = defaultdict(list)
    for r in rows:
        leaf[tuple(x or "" for x in r[1:4])].append((r[0], max(r[4] or 0, 0)))
    total = sum(n for v in leaf.values() for _, n in v)
    cap = {k: epochs * sum(n for _, n in v) for k, v in leaf.items()}
    budgets = {(): min(int(total * share), sum(cap.values()))}
    for k in range(1, 4):
        below = {}
        for parent, b in budgets.items():
            kids = {p[:k] for p in cap if p[: k - 1] == parent}
            below |= filled({c: (sum(v for p, v in cap.items() if p[:k] == c), weights.get(c, 1)) for c in kids}, b)
        budgets = below
    out = []
    for k, docs in leaf.items():
        avail = cap[k] // epochs
        whole, left = divmod(budgets[k], avail) if avail else (0, 0)
        out += [(d, e, n) for e in range(1, whole + 1) for d, n in docs]
        order = sorted(docs, key=lambda x: (hashlib.md5(f"{seed}:{whole + 1}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[1]))
        for d, n in order:
            if left > 0:
                out.append((d, whole + 1, min(n, left)))
                left -= n
    return sorted(out, key=str)


def got(spark, rows, *args):
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = mix(frame, *args)
    assert out.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "epoch", "n_taken"]
    return sorted(((r.doc_id, r.epoch, r.n_taken) for r in out.collect()), key=str)


def some_rows():
    rng = np.random.default_rng(8)
    rows = [(i, str(rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1])), str(rng.choice(["en", "de"])), f"s{rng.choice(4)}", int(rng.integers(1, 50))) for i in range(600)]
    return rows + [(600, None, None, None, 9), (601, "a", "en", "s0", None), (602, "a", "en", "s0", -4), (None, "a", "en", "s0", 7), (5, "a", "en", "s0", 7), (5, "a", "en", "s0", 7), (700, "zero", "en", "s0", 0)]


def test_matches_brute_force(spark):
    weights = {("a",): 1, ("b",): 4, ("c",): 5, ("a", "en"): 3, ("a", "de", "s1"): 0}
    for share, epochs in ((0.3, 1), (1.0, 2), (2.5, 3), (9.0, 2)):
        assert got(spark, some_rows(), weights, share, epochs, 7) == brute(some_rows(), weights, share, epochs, 7)


def test_one_bucket_for_all(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DIGITS", 1)
    assert got(spark, some_rows(), {}, 0.5, 1, 3) == brute(some_rows(), {}, 0.5, 1, 3)


def test_empty(spark):
    assert got(spark, [], {("a",): 2}, 1.0, 2, 1) == []
