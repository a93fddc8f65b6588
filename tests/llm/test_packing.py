from collections import defaultdict

import numpy as np

from tidemark.llm.packing import best_fit, pack_lengths

SIZES = (16, 32, 64)


def naive(lengths, sizes, overhead):
    """The same rule by plain search over all open bins."""
    todo = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    bins = []
    for i, k in enumerate(todo):
        n = lengths[k]
        fits = [b for b in bins if b[0] - b[1] >= n]
        if not fits:
            costs = []
            for size in (s for s in sizes if s >= n):
                fill = min(size - n, sum(lengths[j] for j in todo[i + 1 :] if lengths[j] <= size - n))
                costs.append(((min(s for s in sizes if s >= n + fill) + overhead) / (n + fill), size))
            bins.append([min(costs)[1], 0])
            fits = [bins[-1]]
        min(fits, key=lambda b: b[0] - b[1])[1] += n
    return sorted(min(s for s in sizes if s >= b[1]) for b in bins)


def test_rule_matches_naive_search():
    rng = np.random.default_rng(9)
    for _ in range(20):
        lengths = rng.integers(1, 65, 60)
        bins, offsets, final = pack_lengths(lengths, list(SIZES), 4)
        assert sorted(final.tolist()) == naive(lengths.tolist(), SIZES, 4)
        for b in range(len(final)):
            spans = sorted((o, o + n) for o, n, x in zip(offsets, lengths, bins) if x == b)
            assert spans[0][0] == 0 and all(p[1] == q[0] for p, q in zip(spans, spans[1:])) and spans[-1][1] <= final[b]


def test_whole_documents_come_back(spark):
    rng = np.random.default_rng(10)
    rows = [(int(i), int(n), "x") for i, n in enumerate(rng.integers(0, 200, 300))] + [(7, 50, "x")] * 40 + [(None, 9, "x"), (1000, None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin_id string")
    out = best_fit(frame, capacities=SIZES, overhead=4, shard_pieces=100).collect()
    total, bins = defaultdict(int), defaultdict(list)
    for r in out:
        total[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
            assert r.start == r.piece * 64 and 0 < r.n_tokens <= 64
        else:
            assert r.n_tokens == 0
    want = defaultdict(int)
    for i, n, _ in rows:
        want[i] += n or 0
    assert total == want
    for rs in bins.values():
        used = sum(r.n_tokens for r in rs)
        assert {(r.bin_size, r.bin_used) for r in rs} == {(min(s for s in SIZES if s >= used), used)}
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
    again = best_fit(frame.repartition(7), capacities=SIZES, overhead=4, shard_pieces=100).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_empty(spark):
    assert best_fit(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0
