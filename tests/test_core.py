"""Core operators against hand-made rows; the registered queries against DuckDB."""

import glob
import os
import random
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions import money, text
from tidemark.operators import catalogue, counts, facets, history, lexicon
from tidemark.sources import boards, captures, sinks
from tidemark.streaming import events as streams

DATA = "/root/testdata/sf0.001"


def values(spark, rows, *columns):
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, a string, b string"[: 15 if not isinstance(rows[0], tuple) else None])
    return [tuple(r) if len(columns) > 1 else r[0] for r in frame.orderBy("i").select(*columns).collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, DATA).toArrow(), con.sql(queries.SQL[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    rows = lambda t: sorted(str([r[n] for n in names]) for r in t.to_pylist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= 0


def test_texts(spark):
    assert values(spark, ["Sr. S&C Coach", "  MGR -- Ops", None, "é&b"], text.canonical("a")) == ["senior s and c coach", "manager ops", "", "and b"]
    assert values(spark, [" x x x "], text.term_count(F.col("a"), F.lit(" x "))) == [2]
    assert values(spark, ["a  b", "one two three four", None], text.excerpt("a", 9)) == ["a b", "one two…", ""]
    assert values(spark, ["https://x.org/jobs/head-coach_fort-12?x=1", "https://x.org/"], text.deslugify("a")) == ["Head Coach Fort", None]
    html = ["<p>a&amp;b</p><script>x<y</script><b>c</b>", "caf&eacute;&#8211;&#x2019;&rsquo;&nbsp;x &unknown; &#150; R&D; AT&T", "&lt;b&gt;bold&lt;/b&gt;", None]
    assert values(spark, html, text.html_to_text("a")) == ["a&b\nc", "café–’’ x &unknown; – R&D; AT&T", "bold", ""]
    assert values(spark, ["https://x.org/jobs/" + "a" * 3000], F.length(text.deslugify("a"))) == [3000]


def test_money(spark):
    said = ["$1,234.50", "-5", "(250)", "12.5.3", "1.5e6", "n/a", None, "€ 7"]
    assert values(spark, [".5"], money.parse_amount(F.col("a"))) == [5.0]
    labels = [("1000", x) for x in ("Every two weeks", "twice per month", "fortnightly", "per diem", "annualised", "2weeks", "hr.")]
    assert values(spark, labels, money.annual_pay(F.col("a").cast("double"), F.lit(None).cast("double"), F.col("b"))) == [26000.0, 24000.0, 26000.0, 260000.0, None, None, None]
    assert values(spark, said, money.parse_amount(F.col("a"))) == [1234.5, -5.0, None, None, 1.5e6, None, None, 7.0]
    pay = money.annual_pay(F.col("a").cast("double"), F.lit(None).cast("double"), F.col("b"))
    assert values(spark, [("50", "salary per hour"), ("1000", "Bi-Weekly"), ("60000", ""), ("40", None), ("1", "year")], pay) == [104000.0, 26000.0, 60000.0, 83200.0, None]
    assert values(spark, ["no", "1", None, "False", "x"], money.tolerant_bool(F.col("a"))) == [False, True, None, False, True]
    times = values(spark, ["2024-01-02T03:04:05Z", "1700000000", "1700000000000", "2024/02/03", "2024-05-06 nonsense", "Tue, 7 May 2024 10:00:00 GMT", "bad", None], money.tolerant_time(F.col("a")).cast("string"))
    assert times == ["2024-01-02 03:04:05", "2023-11-14 22:13:20", "2023-11-14 22:13:20", "2024-02-03 00:00:00", "2024-05-06 00:00:00", "2024-05-07 10:00:00", None, None]


def test_lexicon(spark):
    rows = spark.createDataFrame([(1, "Human Performance Coach", "soldier soldier soldier soldier army", "x"), (2, "Coach", "army sales engineer", "x"), (3, "Cook", "army", "x")], "id int, t string, b string, e string")
    out = lexicon.classify(rows, "t", "b", "e", {"soldier": 2.0, "army": 1.0}, {"human performance": 4.0, "coach": 1.0}, ["sales engineer"]).orderBy("id").collect()
    # Matches share no space, so four in a row count as two.
    assert [(r.score, r.verdict, r.excluded_by) for r in out] == [(4.0 + 1.0 + 12.5, "publish", []), (0.0, "reject", ["sales engineer"]), (1.0, "reject", [])]
    award = lexicon.score_awards(spark.createDataFrame([("H2F HOLISTIC HEALTH AND FITNESS athletic training services army navy",), ("army",)], "d string"), "d",
        {"h2f": 6.0, "holistic health and fitness": 6.0}, {"athletic training": 3.0, "athletic training services": 4.0}, {"army": 1.0, "navy": 1.0}, [{"h2f", "holistic health and fitness"}])
    assert [r.award_score for r in award.collect()] == [11.5, 0.0]


def first_come(rows, seen):
    used, taken = [{x[k] for x in seen} - {None} for k in (0, 1)], []
    for s, *keys in sorted(rows):
        if not any(x in u for x, u in zip(keys, used, strict=True) if x is not None):
            taken.append(s)
            for x, u in zip(keys, used, strict=True):
                u.add(x)
    return taken


@pytest.mark.parametrize("block_rows", [4, 40, 100_000])
def test_greedy_matches_brute_force(spark, block_rows):
    rng = random.Random(3)
    rows = [(s, rng.choice([None, *(f"i{k}" for k in range(60))]), rng.choice([None, *(f"f{k}" for k in range(60))])) for s in range(200)]
    seen = [("i1", "f1"), ("i2", None), (None, "f9")]
    kinds = "identity string, fingerprint string"
    out = history.filter_new(spark.createDataFrame(rows, "seq long, " + kinds), spark.createDataFrame(seen, kinds), block_rows=block_rows)
    assert sorted(r.seq for r in out.collect()) == first_come(rows, seen)


def test_greedy_settles_long_chains(spark):
    rows = [(k, f"i{k // 2}", f"f{(k + 1) // 2}") for k in range(5000)]
    kinds = "identity string, fingerprint string"
    for block_rows in (100_000, 900):
        out = history.filter_new(spark.createDataFrame(rows, "seq long, " + kinds), spark.createDataFrame([], kinds), block_rows=block_rows)
        assert sorted(r.seq for r in out.collect()) == list(range(0, 5000, 2))


@pytest.mark.parametrize("block_rows, length", [(50, 30), (20, 60)])
def test_greedy_walks_many_chains_by_component(spark, block_rows, length):
    """Chains of 30 rows fit a block and are walked each; chains of 60 go over blocks of 20."""
    rows = [(k * 1000 + c, f"i{c}-{k // 2}", f"f{c}-{(k + 1) // 2}") for c in range(20) for k in range(length)]
    random.Random(1).shuffle(rows)
    kinds = "identity string, fingerprint string"
    out = history.filter_new(spark.createDataFrame(rows, "seq long, " + kinds), spark.createDataFrame([], kinds), block_rows=block_rows)
    assert sorted(r.seq for r in out.collect()) == first_come(rows, [])


def test_filter_new_query_matches_brute_force(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    keys = e.select("event_id", F.concat("event_type", F.pmod(F.xxhash64("event_id"), F.lit(2000))), F.concat(F.lit("u"), "user_id")).collect()
    want = first_come([tuple(r) for r in keys if r[0] % 100 > 0], [tuple(r)[1:] for r in keys if r[0] % 100 == 0])
    assert sorted(r.seq for r in queries.QUERIES["filter_new"](spark, DATA).collect()) == want


def test_greedy_takes_rows_that_only_dropped_rows_block(spark):
    new = spark.createDataFrame([(1, "i1", "X"), (2, "i2", "X"), (3, "i2", "Y"), (4, "i9", "Z"), (5, None, None), (6, None, None)], "seq long, identity string, fingerprint string")
    seen = spark.createDataFrame([("i9", "Q")], "identity string, fingerprint string")
    assert sorted(r.seq for r in history.filter_new(new, seen).collect()) == [1, 3, 5, 6]


def test_revisions_and_state(spark):
    log = spark.createDataFrame([(1, "k", "A"), (2, "k", "A"), (3, "k", "B"), (4, "k", "A"), (5, "m", None)], "seq long, id string, c string")
    assert sorted(r.seq for r in history.revisions(log, "id", "seq", "c").collect()) == [1, 3, 4, 5]
    t = datetime(2024, 1, 1)
    state = spark.createDataFrame([("a", t, t, "old"), ("b", t, t, "old")], "identity string, first_seen timestamp, last_seen timestamp, status string")
    batch = spark.createDataFrame([("a", t + timedelta(days=9), "new"), ("c", t, "new")], "identity string, seen_at timestamp, status string")
    out = {r.identity: (r.first_seen, r.last_seen, r.status) for r in history.mark(state, batch).collect()}
    assert out == {"a": (t, t + timedelta(days=9), "new"), "b": (t, t, "old"), "c": (t, t, "new")}
    assert history.prune(state, t + timedelta(days=91), 30).count() == 0


def test_empty_reports(spark):
    none = spark.createDataFrame([], "v string, w timestamp, tags array<string>, x double")
    for out in (counts.tally(none, "v", "w"), counts.facet_share(none, "tags", "x"), counts.timeline(none, "w"), counts.growth(none, "v", "w")):
        assert out.count() == 0


def test_facets(spark):
    assert values(spark, ["Sr. Coach", "coach", None], facets.is_lead(F.col("a"))) == [True, False, False]
    where = facets.location_classes(F.col("a"), F.lit(False), r"\b(?:Japan|Guam)\b", r",\s*[A-Z]{2}\b")
    assert values(spark, ["Reno, NV", "Remote, Japan", "not remote", None], where) == [["conus"], ["oconus", "remote"], [], []]
    told = facets.contingency(F.col("a"), r"talent pool", r"\bcontingen(?:t|cy)\b", r"\baward", r"\bdrug\b", r"fully funded")
    assert values(spark, ["contingent upon award", "contingent upon a drug test and award", "fully funded", "x", "Talent pool"], told) == ["contingent", "unknown", "funded", "unknown", "contingent"]
    assert values(spark, ["The Marsh & Co., Inc."], facets.loose_key(F.col("a"))) == ["marsh and"]


def test_boards(spark):
    body = '{"jobs": [{"id": 7, "absolute_url": "u", "title": "Coach", "location": {"name": "Remote"}, "departments": [{"name": "D"}], "content": "<p>Hi</p>", "updated_at": "2024-01-02"}, {"id": 8, "title": "no url"}]}'
    lever = '[{"id": "a", "hostedUrl": "v", "text": "T", "categories": {"location": "Reno", "team": "X"}, "description": "d", "lists": [{"content": "<li>e</li>"}, {"content": "f"}], "createdAt": 1700000000000}]'
    frame = spark.createDataFrame([(body, "greenhouse:x", "E"), ("{broken", "greenhouse:x", "E"), (None, "greenhouse:x", "E")], "payload string, source string, employer string")
    (row,) = boards.parse(frame, "greenhouse").collect()
    assert (row.source_id, row.location, row.department, row.remote, row.description) == ("7", "Remote", "D", True, "Hi")
    (row,) = boards.parse(spark.createDataFrame([(lever, "lever:x", "E")], "payload string, source string, employer string"), "lever").collect()
    assert (row.url, row.title, row.department, row.remote, row.description.split()) == ("v", "T", "X", False, ["d", "e", "f"])


def test_captures(spark):
    results = "Title: Coach at Fort\nURL: https://a.org/jobs/coach-fort#x\nHighlights: one\ntwo\n...\nTitle: Again\nURL: https://a.org/jobs/coach-fort#y\nTitle: Top 10 jobs\nURL: https://b.org/jobs/some-job\n"
    early = "Title: Best 5 ways\nURL: https://a.org/jobs/coach-fort\n"
    out = captures.search_results(spark.createDataFrame([(1, early + results), (2, results)], "k int, t string"), "k", "t").orderBy("k", "at").collect()
    editorial = "editorial or announcement, not a posting"
    assert [(r.k, r.title, r.highlights, r.reason) for r in out] == [
        (1, "Best 5 ways", "", editorial), (1, "Coach at Fort", "one\ntwo", None), (1, "Top 10 jobs", "", editorial), (2, "Top 10 jobs", "", editorial),
    ]
    page = "SOURCE_URL: https://a.org\nRETRIEVED: 2024-01-10\n---\n## Coach\n\nAcme Reno, NV Full-Time ● Posted 3 days ago\n## Cook\n## Chef\n"
    out = captures.captured_listings(spark.createDataFrame([(1, page)], "k int, t string"), "k", "t").orderBy("at").collect()
    assert [(r.title, r.state, r.employment_type, str(r.posted_at)) for r in out][0] == ("Coach", "NV", "Full-Time", "2024-01-07 00:00:00")
    assert [r.meta for r in out][1:] == [None, None]
    page = "SOURCE_URL: https://a.org\nRETRIEVED: 2024-01-10\n---\n## A\nFounded 3 years ago, Reno, NV Contract $50,000 - $60,000 / year ● Posted 2 weeks ago\n## B\nwon 5 days ago\n"
    out = captures.captured_listings(spark.createDataFrame([(1, page)], "k int, t string"), "k", "t").orderBy("at").collect()
    assert [(r.title, r.state, r.employment_type, r.pay, r.posted_at and str(r.posted_at)) for r in out] == [("A", "NV", "Contract", "$50,000 - $60,000 / year", "2023-12-27 00:00:00"), ("B", None, None, None, None)]
    html = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "T", "identifier": {"value": "9"}}]}</script><script type="application/ld+json">{bad</script>'
    (row,) = captures.json_ld_postings(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").collect()
    assert (row.source_id, row.title) == ("9", "T")


def test_catalogue(spark):
    good = "---\nname: A\ndescription: 'x'\ncolor: teal\n---\n## Identity\nme\n## Core Mission\n## Critical Rules\n" + "word " * 60
    rows = spark.createDataFrame([(1, good), (2, good.replace("\n", "\r\n")), (3, "no fence"), (4, good.replace("color: teal\n", ""))], "k int, t string")
    assert sorted((r.k, r.rule) for r in catalogue.lint(rows, "k", "t").collect()) == [(2, "crlf"), (3, "fence"), (4, "missing color")]
    assert [(r.title, r.part) for r in catalogue.sections(rows.where("k = 1"), "k", "t").orderBy("at").collect()] == [("Identity", "soul"), ("Core Mission", "agents"), ("Critical Rules", "soul")]
    assert values(spark, ["teal", "#abc", "123456", "nope"], catalogue.normal_colour(F.col("a"))) == ["#008080", "#6B7280", "#123456", "#6B7280"]


def test_sinks(spark):
    board = spark.createDataFrame([("1", "A<b", "u", "greenhouse:x", None, None, 1.0, datetime(2024, 1, 1), "d", "e")], "id string, title string, url string, source string, state string, validity string, score double, listed_at timestamp, description string, employer string")
    assert sinks.confidence(board).first().confidence == "listed"
    said = [("live", None, "x", "1"), (None, "High Confidence", "workday:x", None), (None, "odd", "workday:x", None), (None, "verified", "workday:x", "1"), ("dead", None, "WorkdayX", "1"), (None, None, None, None)]
    marked = sinks.confidence(spark.createDataFrame([(k, *r) for k, r in enumerate(said)], "k int, state string, validity string, source string, id string"))
    assert [r.confidence for r in marked.orderBy("k").collect()] == ["verified", "listed", "aggregator", "listed", "listed", "aggregator"]
    assert "<title>A&lt;b</title>" in sinks.rss(board).first().item
    assert sinks.review_queue(board).first().line == "- [ ] **A<b** (e) 1.0 u"


def test_long_white_space_is_no_trap(spark):
    began = time.time()
    values(spark, [" " * 40_000 + "x", "contingent " * 5_000], text.excerpt("a"), facets.contingency(F.col("a"), "zz", r"\bcontingen(?:t|cy)\b", r"\baward", r"\bdrug", "zz"), text.html_to_text("a"))
    assert time.time() - began < 20
