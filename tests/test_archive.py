"""Archives of JSON lines and exact quantiles."""

import json
import random

from pyspark.sql import functions as F

from tidemark.operators import counts, history
from tidemark.sources import archive


def test_sequence_is_that_of_writing_however_files_are_split(spark, tmp_path):
    for part in range(3):
        rows = [json.dumps({"id": f"k{n % 5}", "n": part * 400 + n, "c": "x" * (n % 30)}) for n in range(400)]
        (tmp_path / f"part-{part}.jsonl").write_text("\n".join([*rows[:200], "", "  ", *rows[200:]]) + "\n")
    want, before = list(range(1200)), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("2k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            rows = archive.read(spark, str(tmp_path), "n long")
            assert [(r.seq, r.n) for r in rows.orderBy("seq").collect()] == list(zip(want, want, strict=True))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_broken_lines_and_shapes(spark, tmp_path):
    rows = [{"id": "a", "c": 1}, {"id": "a", "c": {"x": [1, 2]}, "more": 5}, {"id": "b"}, {"id": "b", "c": None}, {"id": 7, "c": "é"}]
    text = [json.dumps(r, ensure_ascii=False) for r in rows]
    (tmp_path / "one.jsonl").write_text("\n".join([text[0], '{"id": "a", "c": ', text[1], "[1, 2]", "null", text[2]]) + "\n")
    (tmp_path / "two.jsonl").write_text("\n".join([text[3], text[4], text[4][:-4]]))
    got = archive.read(spark, str(tmp_path), "id string, c string").orderBy("seq").collect()
    assert [(r.seq, r.id, r.c) for r in got] == [(0, "a", "1"), (2, "a", '{"x":[1,2]}'), (5, "b", None), (6, "b", None), (7, "7", "é")]
    assert [(r.file[-9:], r.lines, r.broken, r.cut_off) for r in archive.faults(spark, str(tmp_path)).orderBy("file").collect()] == [("one.jsonl", 6, 3, False), ("two.jsonl", 3, 1, True)]
    log = history.revisions(archive.read(spark, str(tmp_path), "id string, c string"), "id", "seq", "c")
    assert sorted(r.seq for r in log.collect()) == [0, 2, 5, 7]


def test_empty_archive(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("\n\n")
    assert archive.read(spark, str(tmp_path), "id string").collect() == [] and archive.faults(spark, str(tmp_path)).collect() == []


def test_quantiles_are_exact(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, float("-0.0"), rng.gauss(0, 9), 5.0])) for g in ("hot", "hot", "hot", "few", None) for _ in range(rng.randrange(1, 300))] + [("one", 3.5), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: r.quantiles for r in counts.quantiles(frame, "v", shares, "g").collect()}
    want = {r.g: r.q for r in frame.where("v is not null").groupBy("g").agg(F.percentile("v", shares).alias("q")).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for g in want for a, b in zip(got[g], want[g], strict=True))
    (total,) = counts.quantiles(frame, "v", [0.5]).collect()
    assert abs(total.quantiles[0] - frame.agg(F.percentile("v", 0.5)).first()[0]) < 1e-9
    assert counts.quantiles(frame.limit(0), "v", [0.5], "g").collect() == []
