"""Exact duplicates, Merkle manifest and vector codes against plain Python; summaries, bounds, round trips and odd tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes, exact, merkle, queries

ASCII = {k: k + 32 for k in range(65, 91)}


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(ASCII)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, keep[n := (t or "").translate(ASCII)], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("counters", [3, 1024])
def test_exact_duplicates(spark, counters):
    rng = np.random.default_rng(1)
    rows = [(k, f"Text {rng.integers(0, 60)}") for k in range(400)] + [(k, "Hot PASSAGE É") for k in range(400, 700)] + [(k, "hot passage É") for k in range(700, 720)]
    rows += [(None, "hot passage É"), (None, "alone"), (None, "alone"), (5, None), (6, ""), (9000, "hot passage é"), (719, "hot passage É"), (8, "x" * 300_000)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, kept int, row int").repartition(7)
    out = exact.exact_duplicates(frame, counters=counters)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = out.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(rows)
    stays = Counter(r.text_sha256 for r in got if r.kept)
    assert set(stays.values()) == {1} and len(stays) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in got if r.kept)
    left = exact.without_duplicates(frame, counters=counters)
    assert left.columns == frame.columns and Counter(hashlib.sha256((r.text or "").translate(ASCII).encode()).hexdigest() for r in left.collect()) == stays


def test_frequent_digests_keep_every_heavy_one(spark):
    rng = np.random.default_rng(2)
    values = [int(min(rng.zipf(1.3), 500)) for _ in range(6000)]
    frame = spark.createDataFrame([(bytes([v % 256, v // 256]),) for v in values], "digest binary").repartition(90)
    found = {r.digest: r.n for r in exact.frequent_digests(frame, counters=20).collect()}
    count = Counter(bytes([v % 256, v // 256]) for v in values)
    assert len(found) <= 20 and all(d in found for d, n in count.items() if n > 6000 / 21) and all(n <= count[d] for d, n in found.items())


def test_reduced_takes_the_next_largest_off():
    rows = pa.table({"digest": [b"a", b"b", b"a", b"c", b"d"], "n": [4, 2, 1, 2, 1]})
    assert dict(zip(*exact.reduced(rows, 2).to_pydict().values(), strict=True)) == {b"a": 3}
    assert exact.reduced(rows, 4).num_rows == 4


def test_summaries_of_many_batches():
    kinds = pa.schema([pa.field("digest", pa.binary()), pa.field("n", pa.int64(), nullable=False)])
    batches = [pa.RecordBatch.from_arrays([pa.array([bytes([k]), b"hot"] * 3), pa.array([1] * 6)], schema=kinds) for k in range(50)]
    (out,) = exact._summaries(4)(iter(batches))
    assert dict(zip(*out.to_pydict().values(), strict=True))[b"hot"] >= 150 - 300 // 5 and out.num_rows <= 4


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, proof of each node as (side, sibling) a level)"""
    proofs, at, levels = [[] for _ in nodes], list(range(len(nodes))), [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for k, p in enumerate(at):
            other = p ^ 1
            proofs[k].append(None if other >= len(now) else (p % 2, now[other]))
            at[k] = p // 2
        levels.append([H(*now[k : k + 2]) for k in range(0, len(now), 2)])
    return levels[-1][0] if nodes else None, proofs


def brute_merkle(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append(r)
    names = sorted(parts, key=lambda v: (v is not None, (v or "").encode()))
    made = {v: sorted(parts[v], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for v in names}
    trees = {v: tree([leaf(r) for r in made[v]]) for v in names}
    root, tops = tree([trees[v][0] for v in names])
    out = []
    for v, top in zip(names, tops, strict=True):
        for r, low in zip(made[v], trees[v][1], strict=True):
            proof, node = [s for s in low + top], leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = leaf((*r[:3], r[3] + 1, r[4]))
            for s in proof:
                node = H(node) if s is None else H(s[1], node) if s[0] else H(node, s[1])
            out.append((r[0], leaf(r), trees[v][0], root, H(*(s[1] for s in proof if s)), node, node == root))
    return sorted(out, key=str)


def _tables(spark, path, rows):
    spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, H string").repartition(5).write.parquet(f"{path}/documents.parquet")
    return [tuple(r) for r in queries.QUERIES["op13_merkle_manifest"](spark, str(path)).collect()]


@pytest.mark.parametrize("sizes", [{}, {"en": 1}, {"en": 2, None: 1}, {"en": 37, "de": 16, "": 5, None: 3, "zß": 1}])
def test_merkle_manifest(spark, tmp_path, sizes):
    rows = [(100 * k + i, None if i % 5 == 0 else f"src{i % 3}", part, None if i % 4 == 1 else i * 7, ["", None, "größe\n", "t" * 5000][i % 4]) for k, (part, n) in enumerate(sizes.items()) for i in range(n)]
    assert sorted(_tables(spark, tmp_path, rows), key=str) == brute_merkle(rows)


def test_merkle_manifest_with_repeats_and_null_ids(spark, tmp_path):
    rows = [(None, "s", "en", 1, "a"), (None, "s", "en", 1, "b"), (7, "s", "en", 2, "c"), (7, "s", "en", 2, "c"), (7, "s", "en", 3, "d"), (2**63 - 1, "s", "en", 2**63 - 2, "e")]
    got = _tables(spark, tmp_path, rows)
    assert sorted(got, key=str) == brute_merkle(rows)


def test_any_change_breaks_the_proof(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).alias("n_chars"), F.col("id").cast("string").alias("text"))
    other = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.concat("text", F.lit("!")))
    out = merkle.merkle_manifest(docs, also={"other": other})
    root = merkle.hexed("root")
    good, bad = (merkle.folded(F.col(c), F.col("proof")) == root for c in ("leaf", "other"))
    assert out.agg(F.min(good), F.max(bad)).first() == (True, False)


def brute_codes(rows, parts=16, entries=64):
    kept = [(i, label, v) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    whole = np.array([[int(np.floor(256 * float(np.float32(x)))) for x in r[2]] for r in kept], dtype=np.int64)
    cut = whole.reshape(len(kept), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(2):
        at, _d = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = cut[at[:, p] == e, p]
                if len(own):
                    books[p, e] = [sum(map(int, c)) // len(own) for c in own.T]
    at, d = assign()
    errors = d.sum(axis=1)
    labels = Counter()
    for (_, label, _v), e in zip(kept, errors, strict=True):
        labels[label] += int(e)
    digest = hashlib.sha256(",".join(str(x) for x in books.reshape(-1)).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k in a), int(e), labels[label], digest) for (i, label, _v), a, e in zip(kept, at, errors, strict=True)), key=str)


@pytest.mark.parametrize("n, dim", [(300, 48), (20, 16)])
def test_codes(spark, tmp_path, n, dim):
    rng = np.random.default_rng(n)
    values = [(i, [float(np.float32(x)) for x in rng.standard_normal(dim) * rng.choice([0.01, 0.3, 40])], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n).tolist()]
    values += [(n, None, 1), (n + 1, [1.0] * (dim - 1) + [None], 1), (n + 2, [float("nan")] * dim, 2), (n + 3, [float("-inf")] * dim, 2), (n + 4, values[3][1], 0), (None, values[4][1], 1)]
    frame = spark.createDataFrame([(*v, 5, "x") for v in values], "vec_id long, embedding array<float>, label int, error int, code string").repartition(4)
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.QUERIES["op11_code_compression"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out), key=str) == brute_codes(values)


def test_bounds_lose_no_nearest_entry():
    rng = np.random.default_rng(4)
    for length, scale in [(1, 9), (2, 3), (7, 40), (8, 300), (16, 1 << 24), (64, 1 << 24)]:
        rows, book = rng.integers(-scale, scale + 1, (200, length)), rng.integers(-scale, scale + 1, (64, length))
        book[9], book[40], rows[:30] = book[3], book[3], book[rng.integers(0, 64, 30)] + rng.integers(-1, 2, (30, length))
        d = ((rows[:, None] - book) ** 2).sum(axis=2)
        index, least = codes.nearest(rows, book)
        assert (index == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_odd_vectors_and_the_way_back(spark):
    frame = spark.createDataFrame([(1, [0.5, 1.0, 2.0], 1), (2, [0.5], 1), (3, [], None), (4, [1e30] * 3, 2)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in codes.compressed(frame, parts=2, entries=4, rounds=1).collect()}
    assert {k: (r.code, r.error) for k, r in got.items()} == {1: ("0000", 0), 2: ("0101", 0), 3: ("0201", 0), 4: ("0303", 0)}
    rows = codes.prepared(frame)
    books = codes.fit_codebooks(rows, parts=2, entries=4, rounds=1)
    back = {r.id: r.vec for r in codes.decoded(codes.encoded(rows, books), books).collect()}
    assert back[1] == [0.5, 1.0, 2.0, 0.0] and back[3] == [0.0] * 4 and back[4][0] == 65536.0
    assert codes.compressed(frame.limit(0)).collect() == [] and {r.code for r in codes.compressed(frame.where("vec_id = 3")).collect()} == {"00" * 16}
