"""Streams with keyed state against their batch twins: many batches, restarts between them, late rows, repeats of a batch."""

import random

from tests.test_core import first_come
from tidemark.operators import history
from tidemark.streaming import state

KINDS = "seq long, content string, key string, identity string, fingerprint string"


def rows_of(n, keys=9):
    rng = random.Random(n)
    pick = lambda p, k: rng.choice([None, *(f"{p}{x}" for x in range(k))])
    return [(k, rng.choice(["a", "b", None]), pick("k", keys), pick("i", n // 5), pick("f", n // 5)) for k in range(n)]


def land(spark, path, rows):
    spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, path):
    return spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).parquet(path)


def test_revisions_over_batches_and_restarts(spark, tmp_path):
    rows, path, out = rows_of(240), f"{tmp_path}/in", None
    for run in range(3):  # a restart between the runs of four batches
        for k in range(80 * run, 80 * run + 80, 20):
            part = rows[k : k + 20]
            random.Random(k).shuffle(part)
            land(spark, path, part)
        out = state.run_to(state.revised(streamed(spark, path), "key", "seq", "content", buckets=5), f"{tmp_path}/out", f"{tmp_path}/c")
    want = history.revisions(spark.createDataFrame(rows, KINDS), "key", "seq", "content")
    assert sorted(r.seq for r in out.collect()) == sorted(r.seq for r in want.collect())


def test_late_rows_are_no_revisions(spark, tmp_path):
    for part in ([(5, "a", "k", None, None)], [(3, "z", "k", None, None), (6, "a", "k", None, None)], [(7, "b", "k", None, None), (7, "b", "k", None, None)]):
        land(spark, f"{tmp_path}/in", part)
    out = state.run_to(state.revised(streamed(spark, f"{tmp_path}/in"), "key", "seq", "content"), f"{tmp_path}/out", f"{tmp_path}/c")
    assert [tuple(r) for r in out.orderBy("seq").collect()] == [("k", 5, "a"), ("k", 7, "b")]


def test_take_new_over_batches_and_restarts(spark, tmp_path):
    rows, path, out = rows_of(200), f"{tmp_path}/in", None
    for run in range(2):
        for k in range(100 * run, 100 * run + 100, 20):
            land(spark, path, rows[k : k + 20])
        out = state.take_new(streamed(spark, path), "identity", "fingerprint", "seq", f"{tmp_path}/new", f"{tmp_path}/c", buckets=4)
    want = first_come([(r[0], r[3], r[4]) for r in rows], [])
    assert sorted(r.seq for r in out.collect()) == want and 20 < len(want) < 180


def test_take_new_goes_by_batch_before_seq(spark, tmp_path):
    """A late row comes after what earlier batches took; a row that was turned down blocks nothing."""
    for part in ([(9, None, None, "i1", "f1")], [(1, None, None, "i1", "f2"), (2, None, None, None, "f2"), (3, None, None, None, None)], [(4, None, None, "i1", "f9"), (5, None, None, "i2", "f9")]):
        land(spark, f"{tmp_path}/in", part)
    out = state.take_new(streamed(spark, f"{tmp_path}/in"), "identity", "fingerprint", "seq", f"{tmp_path}/new", f"{tmp_path}/c")
    assert sorted(r.seq for r in out.collect()) == [2, 3, 5, 9]


def test_states_whose_entries_expire(spark, tmp_path):
    for k in (1, 2):
        land(spark, f"{tmp_path}/in", [(k, "a", "k", "i", "f")])
    stream = streamed(spark, f"{tmp_path}/in")
    out = state.run_to(state.revised(stream, "key", "seq", "content", max_age_days=30), f"{tmp_path}/o", f"{tmp_path}/c")
    assert [r.seq for r in out.collect()] == [1]
    out = state.take_new(stream, "identity", "fingerprint", "seq", f"{tmp_path}/n", f"{tmp_path}/d", max_age_days=30)
    assert [r.seq for r in out.collect()] == [1]
