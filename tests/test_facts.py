"""The planted documents read a second time, in plain Python, over all rows."""

import re

from pyspark.sql import functions as F

from tidemark import fact_queries, queries

DATA = "/root/testdata/sf0.001"


def both(spark, monkeypatch, name):
    """doc_id, the description that the query reads, and what it reads."""
    seen = []
    whole = fact_queries.planted
    monkeypatch.setattr(fact_queries, "planted", lambda *a: seen.append(whole(*a)) or seen[-1])
    out = {r.doc_id: r for r in queries.QUERIES[name](spark, DATA).collect()}
    texts = {r.doc_id: r.description for r in seen[0].collect()}
    assert set(out) == set(texts) and len(out) >= 200
    return [(i, texts[i], out[i]) for i in out]


def test_plants_stand_inside_whole_texts(spark):
    rows = fact_queries.planted(spark, DATA, F.lit("@fact@")).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in rows:
        before, after = r.description.split("\n@fact@\n")
        assert before + after == docs[r.doc_id]
    assert sum(bool(r.description.split("\n@fact@\n")[0].strip()) for r in rows) > 150


def test_years(spark, monkeypatch):
    for _, text, row in both(spark, monkeypatch, "text_years"):
        spans = [int(a) for a in re.findall(r"(\d+) to \d+ years of experience", text)]
        assert row.years_experience_min == min((y for y in spans if y <= 40), default=None)


def test_certifications(spark, monkeypatch):
    for _, text, row in both(spark, monkeypatch, "text_certifications"):
        said = [name for name, phrase in fact_queries.CERTIFIED if phrase.lower() in text.lower()]
        assert row.certifications == ",".join(sorted(said))


def test_salary(spark, monkeypatch):
    money = re.compile(r"\$([\d,]+(?:\.\d+)?)(?: (?:-|to) \$([\d,]+(?:\.\d+)?))? (per year|per hour|annually)")
    number = lambda x: float(x.replace(",", "")) if x else None
    for _, text, row in both(spark, monkeypatch, "text_salary"):
        low, high, per = money.search(text).groups()
        assert (row.salary_min, row.salary_max, row.salary_period) == (number(low), number(high), "hour" if "hour" in per else "year")


def test_schedule_and_service(spark, monkeypatch):
    for _, text, row in both(spark, monkeypatch, "text_employment_type"):
        places = [(text.lower().index(said.lower()), name) for name, said in fact_queries.SCHEDULED if said.lower() in text.lower()]
        assert row.employment_type == min(places)[1]
    for _, text, row in both(spark, monkeypatch, "text_service_branch"):
        assert any(term in text.lower() for service, term in fact_queries.SERVED if service == row.service_branch)
