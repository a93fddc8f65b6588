"""Record helpers, linked data, selections and the briefing."""

import json

from pyspark.sql import functions as F

from tidemark import posting_queries, queries
from tidemark.functions import records
from tidemark.operators import catalogue, counts
from tidemark.plans import briefing
from tidemark.sources import captures

DATA = "/root/testdata/sf0.001"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "a string").select(column.alias("x")).first().x


def test_fields_and_envelopes(spark):
    record = json.dumps({"Job_Title": "", "jobTitle": "no", "position": {"label": "", "Name": "Coach"}, "tags": [{"name": "a"}, "b", None], "flag": True, "n": 5})
    a = F.col("a")
    got = {k: one(spark, record, records.pick_field(a, *k)) for k in (("job-title", "POSITION"), ("tags",), ("flag", "n"), ("nope",))}
    assert got == {("job-title", "POSITION"): "Coach", ("tags",): "a, b", ("flag", "n"): "5", ("nope",): ""}
    for payload, want in (([1], 1), ({"results": [], "Jobs": [1, 2]}, 2), ({"x": {"data": {"listings": [1, 2, 3]}}}, 3), ({"facets": [1]}, 0), ("s", 0)):
        assert len(one(spark, json.dumps(payload), records.envelope(a))) == want, payload
    assert one(spark, "{broken", records.envelope(a)) == [] and one(spark, None, records.pick_field(a, "x")) == ""


def test_listing_titles(spark):
    cases = {
        "Head Pastry Cook - Reno Hotels - Reno, NV": ("Head Pastry Cook", "Reno Hotels", "Reno, NV"),
        "Night Nurse at Salem Police Department (Salem, OR)": ("Night Nurse", "Salem Police Department", "Salem, OR"),
        "Lake County Fire Department: Fitness Trainer (Ely, MN)": ("Fitness Trainer", "Lake County Fire Department", "Ely, MN"),
        "University of Maine at Orono: Team Dietitian": ("Team Dietitian", "University of Maine at Orono", ""),
        "Cook: Weekends": ("Cook: Weekends", "", ""), "Cook (Nights)": ("Cook (Nights)", "", ""), "Cook | Remote": ("Cook", "", "Remote"), "": ("", "", ""),
    }
    for text, want in cases.items():
        assert tuple(one(spark, text, records.listing_title(F.col("a")))) == want, text


def test_small_helpers(spark):
    a = F.col("a")
    assert one(spark, "B4 Deep Sea", records.board_slugs(a)) == ["b4-deep-sea", "b4deepsea", "B4DeepSea", "b4"]
    assert one(spark, "Quo", records.board_slugs(a)) == ["quo"] and one(spark, None, records.board_slugs(a)) == []
    assert [one(spark, u, records.included(F.col("a"), ["/jobs/"], ["/search"])) for u in ("x/jobs/1", "x/jobs/search", "x")] == [True, False, False]
    assert one(spark, "The ARMY", records.any_of(a, ["army", "navy"]))
    assert one(spark, "x", F.transform(counts.distinct_spellings(F.array(F.lit("CSCS"), F.lit(" cscs "), F.lit(""), F.lit("ATC"), F.lit(None))), lambda x: x)) == ["CSCS", "ATC"]
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    assert [one(spark, t, counts.days_ago(F.col("a").cast("timestamp"), now)) for t in ("2024-03-01", "2024-02-29", "2024-02-20", "2023-12-01", None)] == ["today", "yesterday", "10 days ago", "3 mo ago", ""]


def test_selection(spark):
    rows = spark.createDataFrame([("a-b", "x"), ("c", "x"), ("d", "y")], "slug string, division string")
    assert sorted(r.slug for r in catalogue.selected(rows, ["y"], [], ["A  B # note", "#", ""]).collect()) == ["a-b", "d"]
    assert catalogue.selected(rows, [], [], []).count() == 3
    names = spark.createDataFrame([("c", "z2"), ("c", "z1")], "slug string, translated string")
    assert [(r.slug, r.translated) for r in catalogue.translated(rows, names, "slug").collect()] == [("c", "z1")]


def test_linked_data(spark):
    node = {"@type": ["JobPosting"], "title": "A &amp; B", "url": "/jobs/1", "description": "<p>d</p>", "skills": "s", "jobLocationType": "TELECOMMUTE", "employmentType": ["FULL_TIME", "OTHER"], "hiringOrganization": "Org", "industry": "I"}
    other = {"@type": "JobPosting", "title": "No id", "jobLocation": [{"address": {"addressLocality": "Reno", "addressCountry": {"name": "US"}}}]}
    html = f'<script type="application/ld+json">{json.dumps({"mainEntity": {"itemListElement": [{"item": node}, {"item": other}]}})}</script>'
    out = captures.json_ld_postings(spark.createDataFrame([(1, html, "https://a.org/list")], "k int, h string, u string"), "k", "h", "u").orderBy("title").collect()
    assert [(r.source_id, r.url, r.title, r.employer, r.remote, r.employment_type) for r in out] == [
        ("https://a.org/jobs/1", "https://a.org/jobs/1", "A & B", "Org", True, "FULL_TIME, OTHER"), ("https://a.org/list#no-id-reno-us", "https://a.org/list", "No id", None, False, None),
    ]
    assert out[0].description.split("\n") == ["d", "s", "Employment type: FULL_TIME, OTHER.", "Industry: I."]


def test_briefing(spark):
    report = posting_queries._report(spark, DATA)
    text, page = briefing.markdown(report, 3), briefing.page(report, 3)
    assert "## Employers" in text and "| CSCS |" in text and text.count("\n| ") < 200
    assert page.startswith("<!doctype html>") and "<script" not in page and "<h2>States</h2>" in page
    assert "report_employers" in queries.QUERIES
