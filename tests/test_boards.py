"""Board payloads of every kind, dot paths, details and their joins."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import boards


def parsed(spark, kind, payload, base="https://b.org/"):
    frame = spark.createDataFrame([(json.dumps(payload), f"{kind}:x", "E", base), ("{broken", f"{kind}:x", "E", base), (None, f"{kind}:x", "E", base)], "payload string, source string, employer string, base string")
    return boards.parse(frame, kind, base="base").orderBy("source_id").collect()


CASES = [
    ("ashby", {"jobs": [{"id": "a", "jobUrl": "u", "title": "T", "location": "Reno", "isRemote": True, "compensationTierSummary": "$1", "publishedAt": "2024-01-02", "descriptionHtml": "<p>x</p>"}]}, {"url": "u", "remote": True, "compensation": "$1", "description": "x"}),
    ("workable", {"jobs": [{"shortcode": "w", "url": "u", "title": "T", "city": "Reno", "state": "NV", "country": "", "description": "<b>a</b>", "requirements": "r", "telecommuting": False}]}, {"location": "Reno, NV", "description": "a r", "remote": False}),
    ("recruitee", {"offers": [{"id": 5, "careers_url": "u", "title": "T", "city": "Bonn", "country": "Germany", "description": "a", "requirements": "b"}]}, {"source_id": "5", "location": "Bonn, Germany", "description": "a b"}),
    ("breezy", [{"_id": "z", "name": "T", "location": {"name": "Fort X, NC", "is_remote": True}, "published_date": "nonsense", "creation_date": "2024-03-01", "description": "d", "department": "D", "type": {"name": "Full-Time"}}],
     {"url": "https://b.org/p/z", "location": "Fort X, NC", "remote": True, "posted_at": "2024-03-01 00:00:00", "description": "d\n\nDepartment: D. Employment type: Full-Time."}),
    ("breezy", [{"id": "y", "name": "T", "type": "Part-Time"}, {"id": "z", "name": "T", "type": {"label": "PRN"}}], {"description": "Employment type: Part-Time."}),
    ("rippling", {"results": [{"uuid": "r 1", "name": "T", "workLocation": {"label": "Remote"}, "employmentType": "FULL_TIME", "descriptionHtml": "h", "compensationDescription": "c"}]}, {"url": "https://b.org/jobs/r+1", "remote": True, "description": "h\n\nEmployment type: Full Time.", "compensation": "c"}),
    ("phenom", {"refineSearch": {"data": {"jobs": [{"jobId": "p", "title": "T", "city": "A", "state": "B", "descriptionTeaser": "t"}]}}}, {"url": "https://b.org/job/p", "location": "A, B", "description": "t"}),
    ("oraclecloud", {"items": [{"requisitionList": [{"Id": 9, "Title": "T", "workLocation": [{"TownOrCity": "A", "Country": "US"}], "ShortDescriptionStr": "s", "PostedDate": "2024-01-01"}]}]}, {"source_id": "9", "url": "https://b.org/job/9", "location": "A, US"}),
    ("jobvite", {"jobs": [{"id": "j", "applyURL": "https://a.org/x", "title": "T", "location": "", "country": "US", "category": "C"}, {"id": "k", "applyURL": "http://a.org/x", "title": "T"}]}, {"source_id": "j", "location": "US", "department": "C"}),
    ("governmentjobs", {"jobs": [], "results": [{"id": 3, "title": "T", "salaryMin": "60", "salaryMax": "70", "salaryType": "Hourly", "agency": "City", "description": "d"}]}, {"url": "https://b.org/3", "compensation": "60 - 70 Hourly", "employer": "City"}),
    ("usajobs", {"SearchResult": {"SearchResultItems": [{"MatchedObjectId": "u1", "MatchedObjectDescriptor": {
        "PositionTitle": "T", "PositionURI": "https://u", "OrganizationName": "Org", "DepartmentName": "Dep", "PositionLocationDisplay": "Fort X", "QualificationSummary": "q",
        "PositionRemuneration": [{"MinimumRange": "10", "MaximumRange": "20", "RateIntervalCode": "PH"}], "JobCategory": [{"Name": "A"}, {"Name": "B"}],
        "UserArea": {"Details": {"MajorDuties": ["m", "n"], "TeleworkEligible": "false", "SecurityClearanceRequired": "TS/SCI", "WhoMayApply": "USA"}}}}]}},
     {"employer": "Org", "department": "Dep", "compensation": "10 - 20 PH", "description": "q m n Security clearance: TS/SCI. Telework eligible: false. Who may apply: USA. Job category: A B."}),
]


@pytest.mark.parametrize("kind, payload, want", CASES)
def test_kinds(spark, kind, payload, want):
    row, *_ = parsed(spark, kind, payload)
    got = row.asDict() | {"posted_at": row.posted_at and str(row.posted_at)}
    assert {k: got[k] for k in want} == want


def test_status_filter(spark):
    rows = [{"id": str(k), "title": "T", "status": s} for k, s in enumerate(["Open", "closed", "ACTIVE", None, "draft"])]
    assert [r.source_id for r in parsed(spark, "jazzhr", rows)] == ["0", "2", "3"]


def test_lists_with_details(spark):
    pages = [[{"externalPath": "/job/a", "title": "A", "locationsText": "2 Locations", "postedOn": "Posted Today"}, {"externalPath": "/job/b", "title": "B", "locationsText": "Reno"}], [{"externalPath": "/job/a", "title": "A again"}, {"title": "no path"}]]
    listed = spark.createDataFrame([(k, "workday:x", "E", "https://w.org/site", json.dumps({"jobPostings": p})) for k, p in enumerate(pages)], "seq int, source string, employer string, base string, payload string")
    detail = {"jobPostingInfo": {"jobReqId": "R1", "location": "Fort X", "jobDescription": "<p>full</p>", "startDate": "2024-02-03", "payRange": {"minimum": "1", "maximum": "2", "frequency": "h"}, "timeType": "Full time"}}
    details = spark.createDataFrame([("/job/a", json.dumps(detail))], "key string, payload string")
    merged = boards.with_detail(listed, details, ("$.jobPostings",), ("$.externalPath",), ("$.jobPostingInfo", "$"))
    a, b = sorted(boards.parse(merged, "workday", base="base").collect(), key=lambda r: r.title)
    assert (a.source_id, a.url, a.title, a.location, a.compensation, str(a.posted_at)) == ("R1", "https://w.org/site/job/a", "A", "Fort X", "1 - 2 h", "2024-02-03 00:00:00")
    assert a.description == "full\n\nJob requisition id: R1. Time type: Full time."
    assert (b.source_id, b.url, b.location, b.description) == ("/job/b", "https://w.org/site/job/b", "Reno", "B")
    none = boards.parse(boards.with_detail(listed, details, ("$.jobPostings",), ("$.externalPath",), ("$.jobPostingInfo",), budget=0), "workday", base="base").collect()
    assert {r.source_id for r in none} == {"/job/a", "/job/b"}
    listed = spark.createDataFrame([("s", "E", json.dumps({"content": [{"id": "1", "name": "N", "ref": "https://r", "location": {"city": "X"}}]}))], "source string, employer string, payload string")
    sections = {"jobAd": {"sections": {"jobDescription": {"text": "a"}, "qualifications": {"text": "b"}, "additionalInformation": {"text": "c"}}}}
    (row,) = boards.parse(boards.with_detail(listed, spark.createDataFrame([("1", json.dumps(sections))], "key string, payload string"), ("$.content",), ("$.id",)), "smartrecruiters").collect()
    assert (row.description, row.url) == ("a b c", "https://r")
    listed = spark.createDataFrame([("s", "E", "https://x.bamboohr.com", json.dumps({"result": [{"id": 7, "jobOpeningName": "N", "location": {"city": "A", "state": "B"}, "departmentLabel": "D"}]}))], "source string, employer string, base string, payload string")
    (row,) = boards.parse(boards.with_detail(listed, spark.createDataFrame([("7", json.dumps({"result": {"jobOpening": {"description": "full", "compensation": "$5"}}}))], "key string, payload string"), ("$.result", "$.jobs"), ("$.id",), ("$.result.jobOpening", "$.result")), "bamboohr", base="base").collect()
    assert (row.url, row.location, row.compensation, row.description) == ("https://x.bamboohr.com/careers/7", "A, B", "$5", "full\n\nDepartment: D.")


def _two_boards(spark):
    pages = [("a", "https://a.org", [("/job/1", "A1"), ("/job/2", "A2")]), ("b", "https://b.org", [("/job/1", "B1"), ("/job/3", "B3")])]
    kinds = "seq int, source string, employer string, base string, payload string"
    listed = spark.createDataFrame([(k, f"workday:{name}", name, base, json.dumps({"jobPostings": [{"externalPath": p, "title": t} for p, t in jobs]})) for name, base, jobs in pages for k in (0, 1)], kinds)
    info = lambda ident: json.dumps({"jobPostingInfo": {"jobReqId": ident}})
    return listed, spark.createDataFrame([(f"workday:{n}", key, info(f"{n}{key}")) for n, key in (("a", "/job/1"), ("b", "/job/1"), ("b", "/job/3"), ("a", "/job/2"))], "source string, key string, payload string")


@pytest.mark.parametrize("budget, served", [(None, 4), (1, 2), (0, 0)])
def test_boards_with_equal_paths_keep_their_own_details(spark, budget, served):
    listed, details = _two_boards(spark)
    rows = boards.parse(boards.with_detail(listed, details, ("$.jobPostings",), ("$.externalPath",), ("$.jobPostingInfo",), budget=budget), "workday", base="base").collect()
    got = {r.title: r.source_id for r in rows}
    own = {"A1": "a/job/1", "A2": "a/job/2", "B1": "b/job/1", "B3": "b/job/3"}
    kept = own if budget is None else {k: v for k, v in own.items() if k in ("A1", "B1")} if budget else {}
    assert got == {t: kept.get(t, v[1:]) for t, v in own.items()} and len(kept) == served


def test_side_loaded_records(spark):
    rows = spark.createDataFrame([(1, "departments", "7"), (2, "departments", "8"), (3, None, None)], "id int, kind string, of string")
    included = spark.createDataFrame([("departments", "7", "Ops"), ("departments", "7", None), ("locations", "8", "Reno")], "type string, id string, name string")
    assert [r.department for r in boards.side_loaded(rows, included, "kind", "of", "name", "department").orderBy("id").collect()] == ["Ops", None, None]


def test_personio(spark):
    xml = "<workzag-jobs><position><id>1</id><name>Coach</name><office>Remote</office><department>D</department><employmentType>FULL_TIME</employmentType><createdAt>2024-01-02</createdAt><jobDescriptions><jobDescription><name>Tasks</name><value><![CDATA[<p>run</p>]]></value></jobDescription><jobDescription><name>Empty</name><value></value></jobDescription></jobDescriptions></position><position><id>2</id></position></workzag-jobs>"
    (row,) = boards.personio(spark.createDataFrame([(xml, "personio:x", "E", "https://p.de/"), (None, "s", "E", "b")], "payload string, source string, employer string, base string")).collect()
    assert (row.source_id, row.url, row.title, row.remote) == ("1", "https://p.de/job/1", "Coach", True)
    assert row.description == "Tasks\nrun\n\nDepartment: D. Employment type: Full Time."


def test_dot_paths(spark):
    payload = {"data": {"jobs": [{"title": "a"}, {"title": "b"}]}, "sections": [{"body": "x"}, {"body": ""}, {"other": 1}, {"body": ["y", "z"]}], "a": [{"b": [{"c": 1}, {"c": 2}]}, {"b": [{"c": 3}]}], "0": "zero"}
    paths = {"data.jobs.0.title": ["a"], "data.jobs.-1.title": ["b"], "data.jobs.5.title": [], "sections[].body": ["x", "y", "z"], "a[].b[].c": ["1", "2", "3"], "a.[].b.[].c": ["1", "2", "3"], "data.title": [], "data[]": [], "nope.x": [], "0": ["zero"]}
    frame = spark.createDataFrame([(json.dumps(payload),)], "p string")
    row = frame.select(*(boards.resolve(F.col("p"), p).alias(f"c{k}") for k, p in enumerate(paths))).first()
    assert {p: row[k] for k, p in enumerate(paths)} == paths
    assert spark.createDataFrame([("{bad",), (None,)], "p string").select(boards.resolve(F.col("p"), "a.b").alias("x")).collect() == [([],), ([],)]
