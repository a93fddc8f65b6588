"""Landed pages in batch and stream, and files written one a row."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import boards, landed


def land(folder, name, ids):
    (folder / name).write_text(json.dumps({"jobs": [{"id": k, "absolute_url": f"u{k}", "title": f"T{k}", "content": "<p>é</p>"} for k in ids]}))


def test_pages_give_what_parse_gives(spark, tmp_path):
    land(tmp_path, "p1", [1, 2])
    land(tmp_path, "p2", [3])
    (tmp_path / "p3").write_bytes(b'{"jobs": [\xff')
    (tmp_path / "_done").write_text("x")
    got = landed.postings(spark, str(tmp_path), "greenhouse", "greenhouse:x", "E")
    texts = [(p.read_bytes().decode("utf-8", "replace"), "greenhouse:x", "E") for p in sorted(tmp_path.glob("p*"))]
    want = boards.parse(spark.createDataFrame(texts, "payload string, source string, employer string"), "greenhouse")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
    pages = spark.read.format("landed").option("path", str(tmp_path)).load()
    assert pages.rdd.getNumPartitions() == 3 and [(r.seq, r.page) for r in pages.orderBy("seq").collect()] == [(0, "p1"), (1, "p2"), (2, "p3")]
    assert landed.postings(spark, f"{tmp_path}/none", "greenhouse", "s", "E").collect() == []


def test_pages_as_a_stream(spark, tmp_path):
    landed.register(spark)
    (tmp_path / "in").mkdir()
    seen = []
    for k in range(3):
        land(tmp_path / "in", f"2024-01-0{k + 1}", [k])
        pages = spark.readStream.format("landed").options(path=f"{tmp_path}/in", source="s", employer="E").load()
        sink = pages.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
        sink.trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(r.page for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert seen == [[f"2024-01-0{j + 1}" for j in range(k + 1)] for k in range(3)]


def test_one_file_a_row(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{k % 2}/f{k}.md", f"é{k}" if k else None) for k in range(7)], "name string, content string").repartition(3)
    landed.write_files(rows, f"{tmp_path}/out")
    got = {os.path.relpath(os.path.join(d, f), tmp_path / "out"): open(os.path.join(d, f), encoding="utf-8").read() for d, _, fs in os.walk(tmp_path / "out") for f in fs}
    assert got == {f"d{k % 2}/f{k}.md": f"é{k}" if k else "" for k in range(7)}
    with pytest.raises(Exception, match="FileExistsError|out"):
        landed.write_files(rows.limit(1), f"{tmp_path}/out")
    landed.write_files(rows.where("name = 'd1/f1.md'"), f"{tmp_path}/out", overwrite=True)
    assert os.listdir(tmp_path / "out") == ["d1"] and os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("names", [["a", "A"], ["../x"], ["a/../b"], ["/x"], [None], [""], [".hidden"]])
def test_bad_names_fail_before_the_write(spark, tmp_path, names):
    with pytest.raises(ValueError):
        landed.write_files(spark.createDataFrame([(n, "x") for n in names], "name string, content string"), f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        landed.write_files(rows, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []
