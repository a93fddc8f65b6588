"""Operators that no query runs: the posting pipeline, look-ups and filters, awards, feeds and site maps."""

import gzip
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import awards, counts, search
from tidemark.plans import postings
from tidemark.sources import captures, sinks


def test_the_posting_pipeline(spark):
    now = datetime(2024, 5, 1)
    rules = postings.Rules({"bread": 6.0, "oven": 3.0}, {"baker": 4.0, "bakers": 1.0}, ["night shift"], 30)
    rows = [
        (1, "a", "1", "u1", "Baker", "Mill", "Reno", "bread", now), (2, "b", "9", "u2", "BAKER", "Mill", "Reno", "bread and more bread", now),  # one job on two boards
        (3, "a", "3", "u3", "Baker", "Mill", "Ely", "oven", now), (4, "a", "4", "u4", "Baker of bread", "Mill", "Ely", "night shift", now), (5, "a", "5", "", "Baker of bread", "Mill", "Orono", "", now),
        (6, "a", "6", "u6", "Baker of bread", "Mill", "Waco", "", now - timedelta(days=31)), (7, "a", "7", "u7", "Baker of bread", "Mill", "Bonn", "", None), (8, "a", "8", "u8", "Baker", "Known", "Reno", "bread", now),
    ]
    frame = spark.createDataFrame(rows, "seq long, source string, source_id string, url string, title string, employer string, location string, description string, posted_at timestamp")
    known = frame.where("seq = 8").select(text.identity("source", "source_id").alias("identity"), text.fingerprint("employer", "title", "location").alias("fingerprint"), F.lit(now).alias("first_seen"), F.lit(now).alias("last_seen"), F.lit("publish").alias("status"))
    out = postings.run(frame, known, rules, now)
    seqs = {k: sorted(r.seq for r in out[k].collect()) for k in ("scored", "approved", "review")}
    assert seqs == {"scored": [1, 2, 3, 7, 8], "approved": [1, 7], "review": [3]}
    assert out["state"].count() == 4
    held = postings.run(frame, known, rules, now, auto_publish=False)
    assert held["approved"].count() == 0 and sorted(r.seq for r in held["review"].collect()) == [1, 3, 7]
    assert sorted(r.seq for r in postings.ingest(frame, postings.Rules({}, {}, [], 0), now).collect()) == [1, 2, 3, 4, 6, 7, 8]


def test_look_ups_and_filters(spark):
    rows = spark.createDataFrame([(2, "b", "Oven"), (1, "a", "OVEN"), (3, "oven", "x"), (4, None, None)], "k int, slug string, name string")
    assert search.lookup(rows, "Oven", "slug", "name", "k").first().k == 1 and search.lookup(rows, "oven", "slug", "name", "k").first().k == 1
    assert search.lookup(rows, "none", "slug", "name", "k").collect() == []
    facet = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "unknown"), (4, None)], "k int, f string")
    assert sorted(r.k for r in search.facet_filter(facet, "f", ["yes"]).collect()) == [1, 3, 4]


def test_awards_and_bands(spark):
    rows = [(1, "A1", "x", "2024", "d"), (2, "A1", "y", "2024", "d"), (3, None, "x", "2024", "z" * 90), (4, "", "x", "2024", "z" * 80 + "other"), (5, None, None, None, None)]
    frame = spark.createDataFrame(rows, "seq int, award_id string, recipient string, start_date string, description string")
    assert sorted(r.seq for r in awards.distinct_awards(frame).collect()) == [1, 3, 5]
    stats = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 5.0, 4.0, 6.0), ("c", 7.0, 8.0, 9.0)], "g string, p25 double, median double, p75 double")
    assert [r.g for r in counts.pay_bands(stats).collect()] == ["c", "a"]


def test_content_hashes_tell_null_from_empty(spark):
    rows = spark.createDataFrame([("", "b"), (None, "b"), ("", "b"), ("b", "")], "x string, y string")
    hashes = [r[0] for r in rows.select(text.content_hash("x", "y")).collect()]
    assert hashes[0] == hashes[2] and len(set(hashes)) == 3 and hashes == [r[0] for r in rows.select(text.content_hash("y", "x")).collect()]


def test_feeds_and_site_maps(spark, tmp_path):
    for name in ("rss", "atom", "map"):
        (tmp_path / name).mkdir()
    (tmp_path / "rss" / "a.xml").write_text("<rss><channel><title>c</title><item><title>A &amp; B</title><guid>g1</guid><pubDate>Tue, 7 May 2024 10:00:00 GMT</pubDate><description>d</description></item><item><title>C</title><link>l2</link></item></channel></rss>")
    (tmp_path / "atom" / "a.xml").write_text('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:title>T</a:title><a:link href="h"/><a:id>i</a:id><a:updated>2024</a:updated><a:content>c</a:content></a:entry></a:feed>')
    rss = captures.feed(spark, f"{tmp_path}/rss").orderBy("title").collect()
    assert [tuple(r) for r in rss] == [("A & B", "g1", "Tue, 7 May 2024 10:00:00 GMT", "d"), ("C", "l2", None, None)]
    assert [tuple(r) for r in captures.feed(spark, f"{tmp_path}/atom", "atom").collect()] == [("T", "h", "2024", "c")]
    urls = "<urlset>" + "".join(f"<url><loc>u{k}</loc></url>" for k in range(3)) + "</urlset>"
    with gzip.open(tmp_path / "map" / "a.xml.gz", "wt") as f:
        f.write(urls)
    (tmp_path / "map" / "b.xml").write_text("<urlset><url><loc>u9</loc><lastmod>2024-01-02</lastmod></url></urlset>")
    assert sorted((r.loc, r.lastmod) for r in captures.sitemap(spark, f"{tmp_path}/map").collect()) == [("u0", None), ("u1", None), ("u2", None), ("u9", "2024-01-02")]


def test_public_columns(spark):
    frame = spark.createDataFrame([(1, 2.345, ["b", "a", "b"], "w " * 600)], "id int, score double, tags array<string>, description string")
    row = sinks.public(frame).first()
    assert (row.score, row.tags, row.description[-1]) in ((2.35, ["a", "b"], "…"), (2.34, ["a", "b"], "…")) and len(row.description) <= sinks.EXCERPT + 1
