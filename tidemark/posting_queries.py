"""Queries of the posting operators.  The tables hold no postings, so each customer gives one, its texts picked by its key; the SQL states what they must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import enrichment, places
from tidemark.functions.money import rounded
from tidemark.operators import awards, catalogue, facets, liveness
from tidemark.operators.storage import spread
from tidemark.plans import postings as plans
from tidemark.queries import query
from tidemark.session import table
from tidemark.sources import boards, captures, sinks

#: title, description, location, compensation, and what enrichment and facets must say of them.
TEXTS = [
    ("Senior Strength and Conditioning Coach (CSCS)", "Soldiers of the Army H2F program. Bachelor's degree and 5+ years of experience. Full-time.", "Fort Bragg, NC 28310", "$75,000 - $95,000 per year"),
    ("Athletic Trainer, Part-Time", "BOC certified ATC required. Secret clearance required.", "Camp Lejeune, North Carolina", "$45.00/hour ($93,600 annually)"),
    ("Dietitian", "RD credential. Master's degree. Our secret sauce. 3-5 years of experience.", "Remote", ""),
    ("Physical Therapist", "DPT required. TS/SCI eligibility preferred, Public Trust position.", "Ramstein, Germany", "up to $95,000"),
    ("Data Analyst", "The program launched 3 years ago. Manage a $500,000 equipment budget.", "Washington, DC", ""),
    ("Coach", "Contingent upon award. Salary range is $88,000 to $104,000 per year. PhD in biomechanics.", "anchorage, ak", "DOE"),
    ("Human Performance Specialist", "Naval Special Warfare. Position is fully funded. Per diem and lodging for travel. SMART goals.", "Coronado, CA", "$75-$95K"),
    ("Program Manager", "THOR3 under POTFF. PRN. High school diploma or GED.", "remote in us", "401(k)"),
]
CERTIFICATIONS = ["CSCS", "ATC", "RD", "DPT", "", "PhD", "", ""]
PAY = [(75000, 95000, "year"), (45, 45, "hour"), None, (None, 95000, "year"), None, (88000, 104000, "year"), (75000, 95000, "year"), None]
PROGRAMS = ["H2F", None, None, None, None, None, None, "THOR3"]
STATES = ["NC", "NC", None, None, "DC", "AK", "CA", None]
DISCIPLINES = ["strength-conditioning", "athletic-training", "nutrition", "physical-therapy", "other", "sport-science", "human-performance", "other"]
LEADS = [True, False, False, False, False, False, False, True]
CLASSES = ["conus", "conus", "remote", "oconus", "conus", "oconus", "conus", "remote"]
CONTINGENCY = ["unknown", "unknown", "unknown", "unknown", "unknown", "contingent", "funded", "unknown"]


def _sql(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else f"'{value}'" if isinstance(value, str) else str(value)


def _case(values: list, kind: str) -> str:
    """SQL for the value of a customer's texts."""
    return "(CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN {_sql(v)}" for k, v in enumerate(values)) + f" END)::{kind}"


def _pick(values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values)).cast("int"))


#: Customers are dealt to all cores up to so many splits of the file: a row is narrow, reading its posting's texts is not.
DEALT_SPLITS = 64


def _postings(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "customer"), DEALT_SPLITS)
    texts = {name: _pick([t[k] for t in TEXTS]) for k, name in enumerate(("title", "description", "location", "compensation"))}
    seq = F.col("c_custkey")
    employer = F.when(seq % 3 == 0, F.upper("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
    rows = c.select("c_custkey", seq.alias("seq"), employer.alias("employer"), *(v.alias(k) for k, v in texts.items()), F.col("c_acctbal").alias("balance"))
    return rows.withColumns({
        "id": F.concat(F.lit("j"), seq), "fingerprint": F.when(seq % 5 > 0, F.concat(F.lit("f"), F.floor(seq / 2) * 2)), "url": F.concat(F.lit("https://a.org/jobs/posting-"), seq), "source": _pick(["workday:a", "board:b", "Lever:c"]),
        "remote": seq % 4 == 0, "tags": F.array(_pick(["nutrition", "Strength"]), _pick(["army", "navy", "army"])), "posted_at": F.date_add(F.lit("2024-01-01").cast("date"), (seq % 400).cast("int")).cast("timestamp"),
        "archived_at": F.timestamp_seconds(seq),
    })


_FLOOR = [p and (p[0] if p[0] is not None else p[1]) * (2080 if p[2] == "hour" else 1) for p in PAY]


@query(f"""SELECT c_custkey, {_case(DISCIPLINES, 'VARCHAR')} AS discipline, {_case(LEADS, 'BOOLEAN')} AS lead, CASE WHEN c_custkey % 4 = 0 AND {_case(CLASSES, 'VARCHAR')} <> 'remote'
    THEN {_case(CLASSES, 'VARCHAR')} || ',remote' ELSE {_case(CLASSES, 'VARCHAR')} END AS location_classes, {_case(CONTINGENCY, 'VARCHAR')} AS contingency, {_case(_FLOOR, 'DOUBLE')} AS salary_floor_annual FROM customer""")
def posting_facets(spark: SparkSession, d: str) -> DataFrame:
    out = facets.facets(enrichment.enrich(_postings(spark, d))).select("c_custkey", "facets.*").drop("discipline_label")
    return out.withColumn("location_classes", F.array_join("location_classes", ","))


_CODES = list(places.STATES.values())


@query(f"SELECT c_custkey, ({_CODES})[c_custkey % {len(_CODES)} + 1] AS state FROM customer")
def state_codes(spark: SparkSession, d: str) -> DataFrame:
    """Every state behind a customer's name: its code, its name, its code with a ZIP, its name in capitals among words."""
    c, at = table(spark, d, "customer"), (F.col("c_custkey") % len(_CODES)).cast("int")
    code, name = F.get(F.array(*map(F.lit, _CODES)), at), F.get(F.array(*map(F.lit, places.STATES)), at)
    forms = F.array(F.concat("c_name", F.lit(", "), code), F.concat("c_name", F.lit(", "), F.initcap(name)), F.concat_ws(" ", F.lit("Hall,"), code, F.lit("01234")), F.concat(F.lit("near "), F.upper(name), F.lit(", ground floor")))
    return c.select("c_custkey", places.state_code(F.get(forms, F.expr(f"cast(c_custkey div {len(_CODES)} % 4 as int)"))).alias("state"))


_STATUS = [200, 404, 410, 500, None, 200, 301, 200]
_STATUS_SQL = "([200, 404, 410, 500, NULL, 200, 301, 200])[page_id % 8 + 1]"
_SAYS_SQL = "([" + ", ".join(f"'{m}'" for m in liveness.EXPIRED) + f"])[page_id % {len(liveness.EXPIRED)} + 1]"
_STATE_SQL = f"CASE WHEN {_STATUS_SQL} IS NULL OR {_STATUS_SQL} = 500 THEN 'unknown' WHEN {_STATUS_SQL} IN (404, 410) OR page_id % 3 = 0 THEN 'gone' ELSE 'live' END"


def _checked(spark: SparkSession, d: str) -> DataFrame:
    """Every page's whole markup; a third of them end in one of the sentences that tell of an end."""
    pages, number = table(spark, d, "pages"), F.col("page_id")
    marker = F.get(F.array(*map(F.lit, liveness.EXPIRED)), (number % len(liveness.EXPIRED)).cast("int"))
    body = F.concat(F.coalesce("html", F.lit("")), F.when(number % 3 == 0, F.concat(F.lit("<p>So <b>"), F.initcap(marker), F.lit("</b></p>"))).otherwise(F.lit("")))
    url = F.concat(F.lit("https://a.org/jobs/posting-"), number)
    final = F.when(number % 16 == 7, F.lit("https://a.org/jobs/search")).otherwise(url)
    status = F.get(F.array(*map(F.lit, _STATUS)), (number % 8).cast("int"))
    return liveness.verdict(pages.select(url.alias("url"), status.alias("status"), body.alias("body"), final.alias("final_url")))


@query(f"""SELECT 'https://a.org/jobs/posting-' || page_id AS url, {_STATE_SQL} AS state, CASE WHEN {_STATUS_SQL} IS NULL THEN 'unreachable' WHEN {_STATUS_SQL} IN (404, 410) THEN 'HTTP ' || {_STATUS_SQL}
    WHEN {_STATUS_SQL} = 500 THEN 'HTTP 500 (not a removal signal)' WHEN page_id % 3 = 0 THEN 'page says ''' || {_SAYS_SQL} || '''' WHEN page_id % 16 = 7 THEN 'redirected to https://a.org/jobs/search' ELSE 'reachable' END AS reason,
    {_STATUS_SQL}::INT AS http_status FROM pages""")
def liveness_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d)


@query(f"SELECT page_id, {_STATE_SQL} AS state FROM pages WHERE {_STATE_SQL} <> 'gone'")
def board_recheck(spark: SparkSession, d: str) -> DataFrame:
    board = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://a.org/jobs/posting-"), "page_id").alias("url"))
    return liveness.recheck(board, _checked(spark, d)).select("page_id", "state")


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'legacy' ELSE (['workday:a', 'board:b', 'Lever:c'])[c_custkey % 3 + 1] END AS source,
    CASE WHEN c_custkey % 2 = 1 THEN (['verified', 'listed', 'listed', 'aggregator', 'aggregator'])[c_custkey % 5 + 1] WHEN c_custkey % 3 = 1 THEN 'aggregator' ELSE 'listed' END AS confidence,
    CASE WHEN c_custkey % 2 = 1 THEN 'Old' ELSE {_case(PROGRAMS, 'VARCHAR')} END AS program, CASE WHEN c_custkey % 2 = 1 THEN '$40 per hour' ELSE {_case([t[3] for t in TEXTS], 'VARCHAR')} END AS compensation,
    CASE WHEN c_custkey % 2 = 1 THEN 83200 ELSE {_case(_FLOOR, 'DOUBLE')} END::DOUBLE AS floor FROM customer""")
def feed_normalise(spark: SparkSession, d: str) -> DataFrame:
    p, old = _postings(spark, d), F.col("c_custkey") % 2 == 1
    marks = _pick(["verified", "high", "High Confidence", "aggregator", "odd"])
    rows = p.withColumns({"c": F.col("c_custkey"), "validity": F.when(old, marks), "id": F.when(~old, F.col("id")), "salary": F.when(old, F.lit("$40 per hour")), "program": F.when(old, F.lit("Old")), "rank": F.col("c_custkey").cast("double")})
    out = sinks.feed_rows(rows)
    return out.select(F.col("rank").cast("long").alias("c_custkey"), "source", "confidence", "program", "compensation", F.col("facets.salary_floor_annual").alias("floor"))


_JOBS = f"""p AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS employer,
      CASE WHEN c_custkey % 5 > 0 THEN 'f' || (c_custkey // 2 * 2) ELSE 'j' || c_custkey END AS job, (['nutrition', 'strength'])[c_custkey % 2 + 1] AS discipline,
      {_case(STATES, 'VARCHAR')} AS state, {_case(CERTIFICATIONS, 'VARCHAR')} AS certification, c_custkey % 4 = 0 AS remote, {_case([p and (p[1] if p[0] is None else (p[0] + p[1]) / 2) * (2080 if p[2] == 'hour' else 1) for p in PAY], 'DOUBLE')} AS salary FROM customer),
    jobs AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY job ORDER BY seq DESC) = 1)"""


def _report(spark: SparkSession, d: str, *reports: str) -> dict[str, DataFrame]:
    return plans.insights(_postings(spark, d), top=0, disciplines=["nutrition", "strength"], domains=["army", "navy"], reports=set(reports) or None)


@query(f"WITH {_JOBS} SELECT arg_min(employer, seq) AS name, count(*) AS count, round(median(salary), 2) AS median_salary FROM jobs GROUP BY lower(employer)")
def report_employers(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, "employers")["employers"].drop("disciplines")


@query(f"WITH {_JOBS} SELECT certification AS name, count(*) AS count, round(count(*) / (SELECT count(*) FROM jobs WHERE certification <> ''), 4) AS share FROM jobs WHERE certification <> '' GROUP BY 1")
def report_certifications(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, "certifications")["certifications"]


@query(f"WITH {_JOBS} SELECT state AS value, count(*) AS n FROM jobs WHERE state IS NOT NULL GROUP BY 1")
def report_states(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, "states")["states"]


@query(f"WITH {_JOBS} SELECT count(*) FILTER (WHERE remote) AS count, round(count(*) FILTER (WHERE remote) / count(*), 4) AS share FROM jobs")
def report_remote(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, "remote")["remote"]


@query(f"WITH {_JOBS} SELECT discipline, count(*) AS n, min(salary) AS min, max(salary) AS max, median(salary) AS median FROM jobs WHERE salary IS NOT NULL GROUP BY 1")
def report_salaries(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, "salary_by_discipline")["salary_by_discipline"].select("discipline", "n", "min", "max", "median")


@query(f"WITH {_JOBS} SELECT (SELECT count(*) FROM p) AS postings, count(*) AS jobs, count(DISTINCT lower(employer)) AS employers, count(salary) AS with_salary FROM jobs")
def report_totals(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d, "totals")["totals"].select("postings", "jobs", "employers", "with_salary")


@query("""WITH r AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY 1 ORDER BY t DESC LIMIT 25) SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM r)""")
def award_leads(spark: SparkSession, d: str) -> DataFrame:
    """Awards of the 25 recipients that a briefing shows."""
    o = table(spark, d, "orders").withColumn("recipient", F.col("o_custkey").cast("string"))
    shown = awards.rank_recipients(o, "recipient", "o_totalprice", "o_orderstatus", "o_orderkey", "o_orderdate", seq="o_orderkey", top=25)
    return awards.leads(o, shown).select("o_orderkey")


@query("""SELECT c_custkey::VARCHAR AS source_id, c_name AS title, 'Org ' || c_mktsegment AS employer, round(c_acctbal, 2)::VARCHAR || ' PA' AS pay, 'q ' || c_mktsegment || ' n Travel: yes.' AS description FROM customer""")
def usajobs_payloads(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    details = F.struct(F.struct(F.array("c_mktsegment", F.lit("n")).alias("MajorDuties"), F.lit("yes").alias("TravelCode")).alias("Details"))
    pay = F.array(F.struct(rounded(F.col("c_acctbal"), 2).cast("string").alias("MinimumRange"), F.lit("PA").alias("RateIntervalCode")))
    inner = F.struct(
        F.col("c_name").alias("PositionTitle"), F.concat(F.lit("https://u/"), "c_custkey").alias("PositionURI"), F.concat(F.lit("Org "), "c_mktsegment").alias("OrganizationName"),
        F.lit("q").alias("QualificationSummary"), pay.alias("PositionRemuneration"), details.alias("UserArea"),
    )
    item = F.struct(F.col("c_custkey").alias("MatchedObjectId"), inner.alias("MatchedObjectDescriptor"))
    pages = c.groupBy((F.col("c_custkey") % 50).alias("page")).agg(F.collect_list(item).alias("SearchResultItems"))
    payloads = pages.select(F.to_json(F.struct(F.struct("SearchResultItems").alias("SearchResult"))).alias("payload"), F.lit("usajobs:x").alias("source"), F.lit("E").alias("employer"))
    return boards.parse(payloads, "usajobs").select("source_id", "title", "employer", F.col("compensation").alias("pay"), "description")


@query("""SELECT b AS source, CASE WHEN c_custkey % 3 = 0 THEN b || c_custkey ELSE '/job/' || c_custkey END AS source_id, 'https://' || b || '.org/job/' || c_custkey AS url, c_name AS title,
    CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS location FROM customer, (VALUES ('x'), ('y')) boards(b)""")
def workday_details(spark: SparkSession, d: str) -> DataFrame:
    """Two boards with the same paths; two search terms list every posting, a third of them have a detail page."""
    board = F.explode(F.array(F.lit("x"), F.lit("y")))
    c = table(spark, d, "customer").withColumn("source", board).withColumn("externalPath", F.concat(F.lit("/job/"), "c_custkey"))
    jobs = F.collect_list(F.struct("externalPath", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("locationsText")))
    pages = c.groupBy("source", (F.col("c_custkey") % 40).alias("page")).agg(jobs.alias("jobPostings")).withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    listed = pages.select("seq", F.to_json(F.struct("jobPostings")).alias("payload"), "source", F.lit("E").alias("employer"), F.concat(F.lit("https://"), "source", F.lit(".org")).alias("base"))
    info = F.struct(F.concat("source", "c_custkey").alias("jobReqId"), F.col("c_name").alias("location"))
    details = c.where("c_custkey % 3 = 0").select("source", F.col("externalPath").alias("key"), F.to_json(F.struct(info.alias("jobPostingInfo"))).alias("payload"))
    merged = boards.with_detail(listed, details, ("$.jobPostings",), ("$.externalPath",), ("$.jobPostingInfo",))
    return boards.parse(merged, "workday", base="base").select("source", "source_id", "url", "title", "location")


@query("""SELECT c_custkey AS page_id, 'C' || c_custkey AS source_id, c_name AS title, c_mktsegment AS employer, 'Reno, NV' AS location, round(c_acctbal, 2)::DOUBLE AS salary_min FROM customer WHERE c_custkey % 10 < 7""")
def json_ld_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of customers: seven of ten hold a posting, within a graph, others broken or other linked data."""
    node = F.struct(
        F.lit("JobPosting").alias("@type"), F.struct(F.concat(F.lit("C"), "c_custkey").alias("value")).alias("identifier"), F.col("c_name").alias("title"), F.struct(F.col("c_mktsegment").alias("name")).alias("hiringOrganization"),
        F.struct(F.struct(F.lit("Reno").alias("addressLocality"), F.lit("NV").alias("addressRegion")).alias("address")).alias("jobLocation"),
        F.struct(F.struct(rounded(F.col("c_acctbal"), 2).alias("minValue"), F.lit("YEAR").alias("unitText")).alias("value")).alias("baseSalary"),
    )
    held = F.when(F.col("c_custkey") % 10 < 7, F.to_json(F.struct(F.array(node).alias("@graph")))).when(F.col("c_custkey") % 10 == 7, F.lit("{broken")).otherwise(F.lit('{"@type": "Person"}'))
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), F.concat(F.lit('<p>x</p><script type="application/ld+json">'), held, F.lit("</script>")).alias("html"))
    return captures.json_ld_postings(pages, "page_id", "html").select("page_id", "source_id", "title", "employer", "location", "salary_min")


@query("""SELECT c_custkey, c_mktsegment || ',' || c_name || ',b' AS texts, c_name AS last FROM customer""")
def dot_paths(spark: SparkSession, d: str) -> DataFrame:
    node = lambda x: F.struct(F.struct(x.alias("text")).alias("body"))
    payload = F.to_json(F.struct(F.array(node(F.col("c_mktsegment")), node(F.col("c_name")), node(F.lit("")), node(F.lit("b"))).alias("sections"), F.array(F.lit("a"), F.col("c_name")).alias("names")))
    c = table(spark, d, "customer").select("c_custkey", payload.alias("p"))
    return c.select("c_custkey", F.array_join(boards.resolve(F.col("p"), "sections[].body.text"), ",").alias("texts"), F.try_element_at(boards.resolve(F.col("p"), "names.-1"), F.lit(1)).alias("last"))


_COLOURS = list(catalogue.COLOURS)


@query(f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN printf('#%06X', c_custkey * 40503 % 16777216) WHEN 1 THEN ({[catalogue.COLOURS[x] for x in _COLOURS]})[c_custkey // 3 % {len(_COLOURS)} + 1]
    ELSE '{catalogue.GREY}' END AS colour FROM customer""")
def colours(spark: SparkSession, d: str) -> DataFrame:
    """Six digits, every name, and names of customers, which are none."""
    k, name = F.col("c_custkey"), F.get(F.array(*map(F.lit, _COLOURS)), F.expr(f"cast(c_custkey div 3 % {len(_COLOURS)} as int)"))
    said = F.when(k % 3 == 0, F.format_string("#%06x", k * 40503 % 16777216)).when(k % 3 == 1, F.concat(F.lit(" "), F.initcap(name))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", catalogue.normal_colour(said).alias("colour"))


@query("""SELECT c_custkey, 'T' || c_custkey AS title, CASE WHEN c_custkey % 3 = 0 THEN 'NV' END AS state, CASE WHEN c_custkey % 3 = 0 THEN '$5,000' END AS pay, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-10' - to_days((c_custkey % 9)::INT) END AS posted_at FROM customer""")
def capture_listings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    meta = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Acme, founded 9 years ago, Reno, NV Contract $5,000 ● Posted "), (F.col("c_custkey") % 9).cast("string"), F.lit(" days ago"))).otherwise(F.lit("2 days ago"))
    page = F.concat(F.lit("SOURCE_URL: https://a.org\nRETRIEVED: 2024-01-10\n---\n## T"), F.col("c_custkey"), F.lit("\n\n"), meta, F.lit("\n"))
    out = captures.captured_listings(c.select("c_custkey", page.alias("text")), "c_custkey", "text")
    return out.select("c_custkey", "title", "state", "pay", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))
