"""Registered queries against their SQL over small tables of odd rows."""

import duckdb
import pytest

from tidemark import fact_queries, posting_queries, queries
from tidemark.functions import enrichment
from tidemark.operators import similarity
from tidemark.operators.storage import spread
from tidemark.plans import postings

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def agree(spark, tmp_path):
    """Whether a query gives the rows of its SQL over tables made by SQL; texts tell -0.0 from 0.0."""

    def check(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.execute(f"CREATE TABLE {table} AS {sql}")
            con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
        got, want = queries.QUERIES[name](spark, str(tmp_path)).toArrow(), con.sql(queries.SQL[name]).to_arrow_table()
        rows = lambda t: sorted(str([r[n] for n in sorted(t.column_names)]) for r in t.to_pylist())
        assert rows(got) == rows(want)
        return rows(got)

    return check


def test_pay_is_rounded_as_sql_does(agree):
    # 1832.3075 * 26 is a little less than the half cent that it stands for.
    made = agree("annual_pay", orders="SELECT 15512::BIGINT AS o_orderkey, 183230.75::DOUBLE AS o_totalprice UNION ALL SELECT k, k * 7.77 FROM range(6, 3000) r(k)")
    assert "[15512, 47640]" in made


def test_recipients_without_any_amount_have_no_total(agree):
    made = agree("rank_recipients",
        customer="SELECT k::BIGINT AS c_custkey, 'C' || k AS c_name, 'm' AS c_mktsegment FROM range(3) r(k)",
        orders="SELECT k::BIGINT AS o_orderkey, k % 3 AS o_custkey, 'O' AS o_orderstatus, TIMESTAMP '2024-01-01' AS o_orderdate, '1-URGENT' AS o_orderpriority, 2.5::DOUBLE AS o_totalprice FROM (VALUES (7), (14), (3), (5)) r(k)")
    assert sum("None" in row for row in made) == 1


def test_balances_just_below_zero_keep_their_sign(agree):
    made = agree("usajobs_payloads", customer="SELECT k::BIGINT AS c_custkey, 'C' || k AS c_name, 'm' AS c_mktsegment, (['-0.0', '-0.004', '0.0', '1.005', '-81.865'])[k]::DOUBLE AS c_acctbal FROM range(1, 6) r(k)")
    assert sum("'-0.0 PA'" in row for row in made) == 2


def test_figures_in_addresses_are_no_pay(agree):
    # Id 2 plants a floor at 15838 % (length + 1) characters: right behind an address, a bare figure and a chain of numbers.
    for before in ("ab.39@mail9.example.com x", "about 36 xx", "call 555-92 x", "at 36.151.1"):
        text = next(t for n in range(400) for t in [before + "y" * n] if 15838 % (len(t) + 1) == len(before))
        agree("text_salary", documents=f"SELECT 2::BIGINT AS doc_id, '{text}' AS text, 'en' AS lang, 's' AS source, 1::BIGINT AS n_chars")


def test_postings_are_dealt_to_all_cores(spark):
    assert "RoundRobinPartitioning" in posting_queries._postings(spark, DATA)._jdf.queryExecution().toString()
    wide = spark.range(10).hint("x").crossJoin(spark.range(40_000_000).withColumnRenamed("id", "b"))
    assert "RoundRobin" not in spread(wide)._jdf.queryExecution().toString() and "RoundRobin" in spread(wide, 10**6)._jdf.queryExecution().toString()


def test_reports_read_only_the_facts_that_they_show(spark):
    archive = posting_queries._postings(spark, DATA)
    bare = postings.insights(archive, top=0, reports={"certifications", "totals"})
    assert set(bare) == {"certifications", "totals"}
    whole = postings.insights(enrichment.enrich(archive), top=0)
    for name, frame in bare.items():
        assert sorted(map(str, frame.collect())) == sorted(map(str, whole[name].collect()))


def test_best_match_joins_shared_passages_as_one(agree, spark, monkeypatch):
    seen = {}
    kept = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: seen.setdefault(name, kept(df, name)))
    # A passage of 40 words in every text, a copy of each fourth text, own words in all.
    text = "(SELECT string_agg('p' || j, ' ') FROM range(40) x(j)) || ' ' || (SELECT string_agg('w' || (k - k % 4 * (k % 8 // 4)) || 'x' || j, ' ') FROM range(30) x(j))"
    docs = f"SELECT k::BIGINT AS doc_id, {text} AS text FROM range(200) r(k)"
    for limit in (400_000, 10):
        seen.clear()
        monkeypatch.setattr(similarity, "BROADCAST_ROWS", limit)
        agree("best_match", documents=docs)
        assert seen["shared"].count() < seen["held"].count() / 20


def cut(before: str, behind: str, rest: int, of: int) -> str:
    """SQL for a document whose planted fact comes between the two; its key leaves a rest."""
    text, key = next((t, k) for n in range(9) for t in [before + behind + "Y" * n] for k in range(rest + of, 9_999, of) if k * 7919 % (len(t) + 1) == len(before))
    return f"SELECT {key}::BIGINT AS doc_id, '{text}' AS text, 'en' AS lang, 's' AS source, 1::BIGINT AS n_chars"


def stated(spark, field, texts):
    rows = [(i, "Worker", t, "", "") for i, t in enumerate(texts)]
    frame = enrichment.enrich(spark.createDataFrame(rows, "i int, title string, description string, location string, compensation string"))
    return [r[0] for r in frame.orderBy("i").select(f"enrichment.{field}").collect()]


def test_words_in_capitals_cut_in_two_are_no_degree(agree, spark):
    agree("text_education", documents=" UNION ALL ".join(cut("WAS!! THIN", "GED" + behind, k, 25) for k, behind in ((6, "!! ST!! THNTONHE!! "), (12, ",!! at"), (18, ". THE!! "))))
    said = ["GED", "Needs:\nGED\nCPR and first aid", "HOLDS A GED OR A HIGH SCHOOL PAPER, NO DEGREE AT ALL", "IN!! GED!! TION!!", "a GED!!"]
    assert stated(spark, "education", said) == ["High School"] * 3 + [None, "High School"]


def test_telephone_numbers_are_no_contract(agree, spark):
    agree("text_employment_type", documents=cut("call +1 (202) 555-1099 now ", "x", 2, 4))
    assert stated(spark, "employment_type", ["W-2/1099", "a 1099 position", "1099-NEC", "202.555.1099", "202 555 1099"]) == ["Contract"] * 3 + [None] * 2


def test_figures_behind_a_line_end_or_letters_are_no_pay(agree, spark):
    places = ("+1 (202) 555", "-0011 th"), ("th ", "and 4970008931099239 "), ("AKIAVRUXPZJN36K th ", ""), ("+1 (202) 555-0011 k", "eit")
    agree("text_salary", documents=" UNION ALL ".join(cut(before, behind, 2, 3) for before, behind in places))
    said = ["US$61,000 - $72,500 per year", "pay: $61,000\n- $72,500 per year", "pay: 61,000 -\n72,500 per year", "pay 61K to 72K", "KEY61K"]
    assert stated(spark, "salary_min", said) == [61000.0] * 4 + [None] and stated(spark, "salary_max", said) == [72500.0] * 3 + [72000.0, None]


def test_service_terms_hold_no_words_of_others(agree, spark):
    terms = [term for _, term in fact_queries.SERVED]
    for before, behind in (("la tionle. Airéè, ", "trer"), ("la air", "éè trer")):
        agree("text_service_branch", documents=cut(before, behind, terms.index("force fitness"), len(terms)))
    said = ["Serve the Air\nForce.", "in the air,\nforce fitness", "holistic health & fitness", "éarmyé"]
    assert stated(spark, "service_branch", said) == ["Air Force", "Marine Corps", "Army", None]


def test_best_match_compares_rows_of_the_same_frequent_runs_as_one(agree, spark, monkeypatch):
    seen = {}
    kept = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: seen.setdefault(name, kept(df, name)))
    # Up to three passages, own words of several lengths, copies of some texts; sizes and so similarities are often equal.
    passages = " || ".join(f"CASE WHEN k % {n} < 2 THEN (SELECT string_agg('{p}' || j, ' ') FROM range({30 + n}) x(j)) || ' ' ELSE '' END" for n, p in ((3, "p"), (5, "q"), (7, "s")))
    docs = f"SELECT k::BIGINT AS doc_id, {passages} || coalesce((SELECT string_agg('w' || (k - k % 3 * (k % 11 // 8)) || 'x' || j, ' ') FROM range(k % 13) x(j)), '') AS text FROM range(1000) r(k)"
    for rare, limit in ((0, 400_000), (0.02, 10), (2, 10)):
        seen.clear()
        monkeypatch.setattr(similarity, "RARE_ROWS", rare)
        monkeypatch.setattr(similarity, "BROADCAST_ROWS", limit)
        agree("best_match", documents=docs)
        assert seen["alike"].count() < seen["shared"].count() / 4
        assert (seen["alike"].count() > 0) == (rare < 2)
