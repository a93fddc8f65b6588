"""Queries of the library over the driver's tables, with DuckDB SQL for those that SQL can say."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import money, text
from tidemark.operators import awards, catalogue, counts, discover, facets, history, lexicon, search, similarity
from tidemark.operators.storage import shared_folder, spread
from tidemark.session import table
from tidemark.sources import archive, captures, markup
from tidemark.streaming import events as streams
from tidemark.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The lexicons of the queries; words that the tables hold.
DOMAIN = {"the": 0.5, "and": 0.5, "that": 1.0, "with": 1.5, "une": 0.5, "der": 0.5, "los": 0.5}
DISCIPLINE = {"for": 1.0, "this": 2.0, "was": 1.5, "have": 2.5, "pour": 1.5, "für": 1.0, "para": 1.5, "is the": 2.0}
EXCLUSIONS = ["click here", "of of", "the the"]
PROGRAM, CONTEXT, FAMILIES = {"is the": 5.0, "the": 1.0, "this is": 4.0}, {"and": 0.5, "on": 0.75, "by": 0.5, "as": 0.25}, [{"is the", "this is"}]
SEARCH = "the ation of there"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))


_WORDS = "regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')"
_HAY = "regexp_replace(' ' || " + _WORDS + " || ' ', ' +', ' ', 'g')"
_CANON = (
    "array_to_string(list_transform(list_filter(string_split(" + _WORDS + ", ' '), lambda w: w <> ''), lambda w: coalesce(map {{"
    + ", ".join(f"'{a}': '{b}'" for a, b in text.ABBREVIATIONS.items()) + "}}[w], w)), ' ')"
)
_TITLE = "split_part(text, chr(10), 1)"


@query(f"""SELECT doc_id, substr(sha256(source || chr(0) || doc_id::VARCHAR), 1, 20) AS identity,
    substr(sha256({_CANON.format(x='source')} || chr(0) || {_CANON.format(x=_TITLE)} || chr(0) || {_CANON.format(x='lang')}), 1, 20) AS fingerprint FROM documents""")
def identity_hash(spark: SparkSession, d: str) -> DataFrame:
    return _titled(spark, d).select("doc_id", text.identity("source", "doc_id").alias("identity"), text.fingerprint("source", "title", "lang").alias("fingerprint"))


@query("""SELECT arg_min(c, (event_id)) AS value, count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE event_type END AS c, event_id FROM events) GROUP BY lower(c)""")
def tally_ci(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("c", F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return counts.tally(e, "c", "event_id")


@query("""WITH t AS (SELECT unnest([lang, source]) AS tag, n_chars FROM documents)
    SELECT tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share, round(median(n_chars::DOUBLE), 2) AS median_amount FROM t GROUP BY tag""")
def facet_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.array("lang", "source").alias("tags"), F.col("n_chars").cast("double").alias("n_chars"))
    return counts.facet_share(docs, "tags", "n_chars")


@query("""SELECT o_orderpriority, count(*) AS n, round(min(o_totalprice), 2) AS min, round(max(o_totalprice), 2) AS max, round(quantile_cont(o_totalprice, 0.5), 2) AS median,
    round(quantile_cont(o_totalprice, 0.25), 2) AS p25, round(quantile_cont(o_totalprice, 0.75), 2) AS p75 FROM orders GROUP BY 1""")
def salary_stats(spark: SparkSession, d: str) -> DataFrame:
    return counts.amount_stats(table(spark, d, "orders"), F.col("o_totalprice"), "o_orderpriority")


_PERIODS = ["hour", "Monthly ", "paid bi-weekly", "", "salary per hour", "each year"]


@query("""WITH p AS (SELECT o_orderkey, o_totalprice / 100 AS mid, (o_orderkey % 6)::INT AS k FROM orders),
    f AS (SELECT *, mid * CASE k WHEN 0 THEN 2080 WHEN 1 THEN 12 WHEN 2 THEN 26 WHEN 3 THEN CASE WHEN mid < 250 THEN 2080 ELSE 1 END WHEN 4 THEN 2080 ELSE 1 END AS a FROM p)
    SELECT o_orderkey, CASE WHEN a BETWEEN 5000 AND 2000000 THEN floor(round(a, 2))::BIGINT END AS pay FROM f""")
def annual_pay(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    period = F.get(F.array(*map(F.lit, _PERIODS)), (F.col("o_orderkey") % 6).cast("int"))
    return orders.select("o_orderkey", money.annual_pay(F.col("o_totalprice") / 100, F.lit(None).cast("double"), period).alias("pay")).withColumn("pay", F.floor("pay"))


def _axis_sql(terms: dict[str, float]) -> str:
    def worth(t: str, w: float) -> str:
        n = lexicon.needle(t)
        return f"(CASE WHEN contains(t, '{n}') THEN {w * 2.5} ELSE 0.0 END + {w} * least((length(b) - length(replace(b, '{n}', ''))) // {len(n)}, 3))"

    return " + ".join(worth(t, w) for t, w in terms.items())


@query(f"""WITH h AS (SELECT doc_id, {_HAY.format(x=_TITLE)} AS t, {_HAY.format(x="text || ' ' || source")} AS b FROM documents),
    x AS (SELECT *, {' OR '.join(f"contains(t, '{lexicon.needle(e)}') OR contains(b, '{lexicon.needle(e)}')" for e in EXCLUSIONS)} AS veto FROM h),
    s AS (SELECT doc_id, veto, CASE WHEN veto THEN 0 ELSE {_axis_sql(DOMAIN)} END::DOUBLE AS domain_score, CASE WHEN veto THEN 0 ELSE {_axis_sql(DISCIPLINE)} END::DOUBLE AS discipline_score FROM x)
    SELECT doc_id, round(domain_score + discipline_score, 4) AS score, CASE WHEN veto OR domain_score < 1.5 OR discipline_score < 3 THEN 'reject'
        WHEN domain_score + discipline_score >= 14 THEN 'publish' WHEN domain_score + discipline_score >= 8 THEN 'review' ELSE 'reject' END AS verdict FROM s""")
def classify_verdict(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.classify(_titled(spark, d), "title", "text", "source", DOMAIN, DISCIPLINE, EXCLUSIONS).select("doc_id", money.rounded(F.col("score"), 4).alias("score"), "verdict")


@query(f"""WITH h AS (SELECT doc_id, {_HAY.format(x="text || ' ' || source")} AS t FROM documents)
    SELECT doc_id, list_sort(list_filter([CASE WHEN contains(t, ' the ') OR contains(t, ' that ') THEN 'article' END, CASE WHEN contains(t, ' der ') OR contains(t, ' une ') THEN 'foreign' END], lambda x: x IS NOT NULL))::VARCHAR AS tags FROM h""")
def derive_tags(spark: SparkSession, d: str) -> DataFrame:
    hay = _titled(spark, d).withColumn("_t", text.haystack("title")).withColumn("_b", text.haystack("text", "source"))
    hits = lexicon.axis(DOMAIN, F.col("_t"), F.col("_b"))[1]
    tags = lexicon.derive_tags(hits, {"article": ["the", "that"], "foreign": ["der", "une"]})
    return hay.select("doc_id", F.concat(F.lit("["), F.array_join(tags, ", "), F.lit("]")).alias("tags"))


@query(f"""WITH h AS (SELECT doc_id, {_HAY.format(x='text')} AS b FROM documents),
    m AS (SELECT doc_id, contains(b, ' is the ') AS it, contains(b, ' the ') AS th, contains(b, ' this is ') AS ti,
      {' + '.join(f"CASE WHEN contains(b, '{lexicon.needle(t)}') THEN {w} ELSE 0 END" for t, w in CONTEXT.items())} AS c,
      {' + '.join(f"CASE WHEN contains(b, '{lexicon.needle(t)}') THEN {w} ELSE 0 END" for t, w in {"have": 2.0, "pour": 1.5}.items())} AS d FROM h)
    SELECT doc_id, CASE WHEN it OR th OR ti OR d > 0 THEN round((CASE WHEN it THEN 5 WHEN ti THEN 4 ELSE 0 END + CASE WHEN th AND NOT it THEN 1 ELSE 0 END + d + least(c, 1.5))::DOUBLE, 2) ELSE 0 END::DOUBLE AS award_score FROM m""")
def award_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return lexicon.score_awards(docs, "text", PROGRAM, {"have": 2.0, "pour": 1.5}, CONTEXT, FAMILIES).select("doc_id", "award_score")


@query("""SELECT conv_id, turn, role, md5(text) AS hash FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def latest_revision(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("at", F.timestamp_seconds("turn"))
    return history.latest(c, "conv_id", "at", "turn").select("conv_id", "turn", "role", F.md5("text").alias("hash"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR b IS DISTINCT FROM event_type""")
def revision_log(spark: SparkSession, d: str) -> DataFrame:
    return history.revisions(table(spark, d, "events"), "user_id", "event_id", "event_type").select("user_id", "event_id", "event_type")


@query("""WITH o AS (SELECT *, event_id < (SELECT avg(event_id) FROM events) AS old FROM events),
    n AS (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM o WHERE NOT old WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    l AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM o WHERE old GROUP BY 1)
    SELECT user_id, event_id, event_type FROM n LEFT JOIN l USING (user_id) WHERE CASE WHEN r = 1 THEN t IS NULL OR t <> event_type ELSE b <> event_type END""")
def archive_append(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.avg("event_id").alias("mean"))))  # a single row
    return history.append_revisions(e.where("event_id >= mean"), e.where("event_id < mean"), "user_id", "event_id", "event_type").select("user_id", "event_id", "event_type")


@query()
def filter_new(spark: SparkSession, d: str) -> DataFrame:
    """Every event is either seen (one in a hundred) or new."""
    e = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat("event_type", F.pmod(F.xxhash64("event_id"), F.lit(2000))).alias("identity"), F.concat(F.lit("u"), "user_id").alias("fingerprint"))
    return history.filter_new(e.where("seq % 100 > 0"), e.where("seq % 100 = 0"))


@query("""WITH s AS (SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1) SELECT user_id, first_seen, last_seen, status FROM s""")
def store_mark(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnsRenamed({"event_type": "status"})
    old = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return history.mark(old, e.where("event_id % 2 = 1").withColumnRenamed("ts", "seen_at"), "user_id").select("user_id", "first_seen", "last_seen", "status")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS status, o_orderdate AS listed_at FROM orders
    WHERE o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 900 DAY""")
def upsert_board(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("old").alias("status"), F.col("o_orderdate").alias("listed_at"))
    return history.upsert(o, o.where("id % 3 = 0").withColumn("status", F.lit("new")), now=F.lit("1998-08-02").cast("timestamp"), retain_days=900)


@query("""SELECT count(*) AS records, count(DISTINCT lang) AS identities, count(*) - count(DISTINCT lang) AS revisions, count(DISTINCT source) AS sources, sum(length(text))::BIGINT AS chars FROM documents""")
def archive_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("lang").alias("id"), "source", F.col("lang").alias("employer"), F.col("text").alias("description"), F.current_timestamp().alias("archived_at"))
    return history.archive_stats(docs).select("records", "identities", "revisions", "sources", "chars")


_MONTHS = """months AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders WHERE month(o_orderdate) <> 4 GROUP BY 1),
    line AS (SELECT strftime(g.m, '%Y-%m') AS month, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(m) FROM months), (SELECT max(m) FROM months), INTERVAL 1 MONTH)) AS m) g LEFT JOIN months USING (m))"""


@query(f"WITH {_MONTHS} SELECT * FROM line")
def timeline_gapfill(spark: SparkSession, d: str) -> DataFrame:
    return counts.timeline(table(spark, d, "orders").where(F.month("o_orderdate") != 4), "o_orderdate")


@query(f"""WITH {_MONTHS}, b AS (SELECT *, lag(n) OVER (ORDER BY month) AS p FROM line) SELECT month, n, n - p AS change, CASE WHEN p <> 0 THEN round((n - p) / p, 4) END AS ratio,
    CASE WHEN n > p THEN 'up' WHEN n < p THEN 'down' WHEN n = p THEN 'flat' END AS direction FROM b""")
def month_movement(spark: SparkSession, d: str) -> DataFrame:
    return counts.month_movement(timeline_gapfill(spark, d))


@query("""WITH a AS (SELECT max(ts) AS l FROM events), w AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'U' ELSE 'u' END || user_id AS who, ts, l FROM events, a),
    c AS (SELECT arg_min(who, (ts < l - INTERVAL 5 DAY, ts, who)) AS value, count(*) FILTER (WHERE ts >= l - INTERVAL 5 DAY) AS recent, count(*) FILTER (WHERE ts < l - INTERVAL 5 DAY AND ts >= l - INTERVAL 10 DAY) AS prior FROM w GROUP BY lower(who))
    SELECT value, recent, prior, recent - prior AS change FROM c WHERE recent > prior""")
def trend_growth(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("who", F.concat(F.when(F.col("event_id") % 2 == 0, "U").otherwise("u"), "user_id"))
    return counts.growth(e, "who", "ts", days=5)


_SHINGLES = """w AS MATERIALIZED (SELECT {key} AS id, list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {table}),
    {name} AS MATERIALIZED (SELECT DISTINCT id, unnest(list_transform(generate_series(1, len(w) - 7), lambda i: array_to_string(w[i:i + 7], ' '))) AS h FROM w WHERE len(w) >= 8)"""


@query("""WITH """ + _SHINGLES.format(key="doc_id", text="regexp_replace(text, '(?s)^---.*?---', '')", table="documents", name="s") + """,
    n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
    c AS (SELECT a.id, b.id AS other, count(*) AS c FROM s a JOIN s b USING (h) WHERE a.id % 50 = 0 AND a.id <> b.id GROUP BY 1, 2),
    p AS (SELECT c.id, other, c / (n.n + m.n - c) AS j FROM c JOIN n ON n.id = c.id JOIN n m ON m.id = other),
    t AS (SELECT id, arg_max(other, (j, -other)) AS best_id, max(j) AS j FROM p GROUP BY 1)
    SELECT doc_id, best_id, round(coalesce(j, 0), 6) AS similarity, CASE WHEN j >= 0.4 THEN 'fail' WHEN j >= 0.2 THEN 'warn' ELSE 'ok' END AS verdict FROM documents LEFT JOIN t ON id = doc_id WHERE doc_id % 50 = 0""")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return similarity.best_match(docs.where("doc_id % 50 = 0"), docs)


@query("""WITH """ + _SHINGLES.format(key="item_id", text="text", table="benchmark", name="i") + ", " + _SHINGLES.format(key="doc_id", text="text", table="documents", name="s").replace("w AS MAT", "v AS MAT", 1).replace("FROM w ", "FROM v ") + """,
    n AS (SELECT id, count(*) AS n FROM i GROUP BY 1)
    SELECT i.id AS item_id, s.id AS doc_id, round(count(*) / any_value(n.n), 6) AS share FROM i JOIN s USING (h) JOIN n ON n.id = i.id GROUP BY 1, 2""")
def contamination(spark: SparkSession, d: str) -> DataFrame:
    return similarity.contained(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id")


@query(f"""WITH x AS (SELECT doc_id, lang, lower(source) AS nm, lower({_TITLE}) AS ds, lower(concat_ws(chr(10), source, {_TITLE}, substr(text, 1, 8000))) AS t FROM documents WHERE lang = 'en'),
    k AS (SELECT *, list_distinct(list_filter(string_split(regexp_replace(t, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')) AS held FROM x),
    r AS (SELECT doc_id, held, len(list_intersect(held, {search.query_tokens(SEARCH)}))::DOUBLE + CASE WHEN contains(t, '{SEARCH}') THEN 5 ELSE 0 END
      + {' + '.join(f"CASE WHEN contains(nm, '{t}') THEN 3.0 ELSE 0 END + CASE WHEN contains(ds, '{t}') THEN 1.5 ELSE 0 END" for t in search.query_tokens(SEARCH))} AS raw FROM k)
    SELECT doc_id, round(raw + 1 / sqrt(greatest(len(held), 1)), 6) AS score FROM r WHERE raw > 0 ORDER BY score DESC, doc_id LIMIT 25""")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _titled(spark, d)
    return search.rank(docs, SEARCH, "source", "title", "text", order=("doc_id",), limit=25, where=F.col("lang") == "en").select("doc_id", "score")


@query("""SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND contains(lower(concat_ws(' ', text, source, lang || ' ' || source)), 'ment')""")
def text_tag_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("tags", F.array("lang", "source"))
    return search.tag_filter(docs, ["de", "fr"], "ment", "tags", ["text", "source"]).select("doc_id")


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE rtrim(regexp_replace(substr(t, 1, 120), ' [^ ]*$', '')) || '…' END AS short FROM f""")
def excerpt(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.excerpt("text", 120).alias("short"))


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slugify("p_name").alias("slug"))


@query(r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') AS path FROM pages),
    s AS (SELECT page_id, regexp_replace(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '[a-zA-Z]{3}'))[-1], '\.[a-z]{2,5}$', '') AS slug FROM u)
    SELECT page_id, array_to_string(list_transform(list_filter(string_split_regex(slug, '[-_+]+'), lambda w: w <> '' AND NOT regexp_matches(w, '^[0-9]+$')), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM s""")
def deslugify_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.deslugify("url").alias("title"))


@query("""SELECT page_id, CASE WHEN regexp_matches(split_part(url, '?', 1), '(?i)/(jobs|careers|openings|search-results|job-category|category|search)/?$') THEN 'listing index, not one posting'
    WHEN regexp_matches(url, '(?i)/(job|jobs|job-details|job-v1|careers|career|opening|openings|vacanc\\w*|position|posting|workspread|recruiting)s?[-/][^/?#]{4,}')
      OR (regexp_matches(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1), '(?i)(job|career|hiring|recruit|talent|employ|vacanc)') AND regexp_matches(regexp_replace(split_part(url, '?', 1), '^[a-zA-Z]+://[^/]*', ''), '/[^/?#]{8,}')) THEN NULL
    ELSE 'no individual-posting path' END AS reason FROM pages""".replace("\\\\", "\\"))
def url_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", captures.rejection(F.col("url"), F.lit("A title")).alias("reason"))


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_to_text("html").alias("text"))


@query()
def json_ld_postings(spark: SparkSession, d: str) -> DataFrame:
    return captures.json_ld_postings(table(spark, d, "pages"), "page_id", "html")


@query("""SELECT o_orderkey, CASE (o_orderkey % 5)::INT WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN -floor(o_totalprice) WHEN 2 THEN 1.5e6 ELSE NULL END::DOUBLE AS amount FROM orders""")
def parse_amount(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey") % 5)
    price = F.col("o_totalprice")
    said = F.when(F.col("k") == 0, F.concat(F.lit("$"), F.format_number(price, 2))).when(F.col("k") == 1, F.concat(F.lit("- "), F.floor(price).cast("string"))).when(F.col("k") == 2, F.lit("$1.5e6"))
    said = F.when(F.col("k") == 3, F.concat(F.lit("("), F.floor(price).cast("string"), F.lit(")"))).otherwise(F.coalesce(said, F.lit("12.5.3 or so 7")))
    return o.select("o_orderkey", money.parse_amount(said).alias("amount"))


@query("""SELECT CASE WHEN any_value(c_custkey) % 2 = 0 THEN upper(c_name) ELSE c_name END AS recipient, count(*) AS awards, round(sum(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END), 2) AS total, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS missing,
    array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS agencies, any_value(c_mktsegment) AS states, count(*) AS ids,
    strftime(max(o_orderdate), '%Y-%m-%d') AS latest, arg_max(o_orderpriority, (o_orderkey % 5, -o_orderkey)) AS top_description FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name""")
def rank_recipients(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", (F.col("o_orderkey") % 5).alias("o_shippriority"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("amount"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    ranked = awards.rank_recipients(joined, "c_name", "amount", "o_orderstatus", "o_orderkey", "o_orderdate", seq="o_orderkey", state="c_mktsegment", description="o_orderpriority", relevance="o_shippriority")
    return ranked.select("recipient", "awards", "total", "missing", F.array_join("agencies", ",").alias("agencies"), F.array_join("states", ",").alias("states"), F.size("award_ids").cast("long").alias("ids"), F.substring("latest", 1, 10).alias("latest"), "top_description")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 <> 4 THEN s_name END AS registered FROM supplier""")
def employer_match(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    said = s.withColumn("said", F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("The "), F.upper("s_name"), F.lit(", Inc."))).otherwise(F.regexp_replace("s_name", "#", " - ")))
    said = said.withColumn("said", F.when(F.col("s_suppkey") % 5 == 4, F.concat("said", F.lit(" of Reno"))).otherwise(F.col("said")))
    return facets.match_employers(said, "said", s, "s_name", "s_suppkey").select("s_suppkey", "registered")


@query(r"""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, 'https?://(?:www\.)?([a-z0-9.-]+\.[a-z]{2,})', 1)) AS value FROM pages) SELECT value, count(*) AS mentions, count(DISTINCT page_id) AS documents FROM m GROUP BY 1""")
def discover_domains(spark: SparkSession, d: str) -> DataFrame:
    return discover.domains(table(spark, d, "pages"), "html")


@query(r"""WITH m AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}\p{M}_]+')) AS value FROM documents) SELECT value, count(*) AS mentions FROM m WHERE regexp_full_match(value, '[A-Z]{2,6}[0-9]?') GROUP BY 1 HAVING count(*) >= 2""")
def vocab_candidates(spark: SparkSession, d: str) -> DataFrame:
    return discover.acronyms(table(spark, d, "documents"), "text").select("value", "mentions")


@query("""SELECT o_custkey AS ref, count(*) AS n FROM orders ANTI JOIN supplier ON s_suppkey = o_custkey GROUP BY 1""")
def anti_join_refs(spark: SparkSession, d: str) -> DataFrame:
    o, s = table(spark, d, "orders"), table(spark, d, "supplier")
    return o.join(s, o.o_custkey == s.s_suppkey, "left_anti").groupBy(F.col("o_custkey").alias("ref")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_custkey AS k FROM orders UNION ALL SELECT -s_suppkey FROM supplier)
    SELECT DISTINCT c_custkey AS key, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT k FROM b) UNION ALL SELECT DISTINCT k, 'right' FROM b WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def key_mismatches(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    b = table(spark, d, "orders").select(F.col("o_custkey").alias("key")).unionByName(table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("key")))
    return catalogue.mismatches(a, b, "key")


def _headed(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one language behind a header, some of it missing."""
    head = F.concat(F.lit("---\nname: "), F.when(F.col("doc_id") % 7 != 0, F.col("source")).otherwise(F.lit("")), F.lit("\ndescription: x\ncolor: teal\n---\n## Identity\n"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "en", F.concat(head, "text")).otherwise(F.col("text")).alias("text"))


@query(r"""WITH d AS (SELECT doc_id, text, lang = 'en' AND NOT contains(text, chr(13)) AS sound FROM documents)
    SELECT doc_id, 'error' AS level, 'crlf' AS rule FROM d WHERE contains(text, chr(13)) UNION ALL SELECT doc_id, 'error', 'fence' FROM d WHERE NOT sound AND NOT contains(text, chr(13))
    UNION ALL SELECT doc_id, 'error', 'missing name' FROM d WHERE sound AND doc_id % 7 = 0
    UNION ALL SELECT doc_id, 'warning', 'section Core Mission' FROM d WHERE sound AND NOT contains(lower(text), 'core mission') UNION ALL SELECT doc_id, 'warning', 'section Critical Rules' FROM d WHERE sound AND NOT contains(lower(text), 'critical rules')
    UNION ALL SELECT doc_id, 'warning', 'short' FROM d WHERE sound AND len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) < 48""")
def lint_rules(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.lint(_headed(spark, d), "doc_id", "text")


@query(f"""SELECT doc_id, coalesce(regexp_matches({_TITLE}, '{facets.LEAD}'), false) AS lead, regexp_matches({_TITLE}, '(?i)\\bremote\\b') AS remote FROM documents""")
def lead_flag(spark: SparkSession, d: str) -> DataFrame:
    return _titled(spark, d).select("doc_id", facets.is_lead(F.col("title")).alias("lead"), F.col("title").rlike(r"(?i)\bremote\b").alias("remote"))


# Beyond the survey's own operators: what Spark brings along, over the same tables.


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.agg(money.rounded(F.sum("l_quantity"), 2).alias("sum_qty"), money.rounded(revenue, 2).alias("revenue"), money.rounded(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (1, 2)""")
def segment_cube(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    return joined.cube(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, rank() OVER w AS place, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS quarter,
    round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)""")
def ranked_events(spark: SparkSession, d: str) -> DataFrame:
    by_type, by_id = Window.partitionBy("user_id").orderBy("event_type"), Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(
        "user_id", "event_id", F.rank().over(by_type).alias("place"), F.dense_rank().over(by_type).alias("dense"), F.ntile(4).over(by_id).alias("quarter"),
        money.rounded(F.sum("value").over(by_id.rowsBetween(-2, 0)), 4).alias("moving"),
    )


def as_of(left: DataFrame, right: DataFrame, key: str, when: str, value: str) -> DataFrame:
    """left with `value` of right's latest row of the key at or before each row's time: one shuffle and a running last value over both sides."""
    names = left.columns
    both = left.withColumn("_side", F.lit(1)).unionByName(right.select(key, when, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(when, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*names, value)


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
    SELECT e.event_id, r.value FROM e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    right = e.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return as_of(e.where("event_id % 2 = 0").select("event_id", "user_id", "ts"), right, "user_id", "ts", "value").select("event_id", "value")


def within(left: DataFrame, right: DataFrame, key: str, when: str, seconds: int) -> DataFrame:
    """Pairs of one key no more than `seconds` apart, by time buckets instead of a nested loop."""
    bucket = F.floor(F.unix_timestamp(when) / seconds)
    a = left.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("a")
    b = right.withColumn("_b", bucket).alias("b")
    near = F.abs(F.unix_micros(F.col(f"a.{when}").cast("timestamp")) - F.unix_micros(F.col(f"b.{when}").cast("timestamp"))) <= seconds * 1_000_000
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._b") == F.col("b._b")) & near)


@query("""SELECT a.event_id AS e1, b.event_id AS e2 FROM events a JOIN events b ON a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1""")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return within(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "ts", 3600).select(F.col("a.event_id").alias("e1"), F.col("b.event_id").alias("e2"))


def _event_stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    source = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    source.select("event_id", "ts", "user_id", "event_type", "value").orderBy("ts").write.parquet(f"{folder}/in")
    return spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in"), folder


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR b IS DISTINCT FROM event_type""")
def archive_revisions(spark: SparkSession, d: str) -> DataFrame:
    """The events as an archive of JSON lines in several files, every hundredth line followed by a broken one; revisions by the order of writing."""
    e, path = table(spark, d, "events").select("user_id", "event_id", "event_type"), f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    text = F.to_json(F.struct("user_id", "event_id", "event_type"))
    broken = F.when(F.col("event_id") % 100 == 0, F.concat(text, F.lit("\n"), F.left(text, F.lit(20)))).otherwise(text)
    e.repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select(broken.alias("value")).write.text(path)
    rows = archive.read(spark, path, "user_id long, event_id long, event_type string")
    return history.revisions(rows, "user_id", "seq", "event_type").select("user_id", "event_id", "event_type")


def page_region(key: int) -> str:
    """Markup that a third of the pages end in for page_details: a description, its last paragraph left open."""
    return f'<div id="job-Body"><h2>Part {key}</h2><form>no</form><p>{f"word{key} " * 30}</div>' if key % 3 == 0 else ""


@query()
def page_details(spark: SparkSession, d: str) -> DataFrame:
    """The description of every page, whole: of its region where it has one, else of the page without its chrome."""
    key = F.col("page_id").cast("string")
    region = F.concat(F.lit('<div id="job-Body"><h2>Part '), key, F.lit("</h2><form>no</form><p>"), F.repeat(F.concat(F.lit("word"), key, F.lit(" ")), 30), F.lit("</div>"))
    pages = spread(table(spark, d, "pages")).withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.when(F.col("page_id") % 3 == 0, region).otherwise(F.lit(""))))
    return markup.with_detail_text(pages).select("page_id", "detail")


def _landed_stream(spark: SparkSession, d: str, batches: int = 4) -> tuple[DataFrame, str]:
    """The events in the order of their ids, landed in so many files one after the other, read one file a micro-batch."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    folder, most = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", events.agg(F.max("event_id")).first()[0] or 0
    for k in range(batches):
        part = events.where((F.col("event_id") * batches >= k * (most + 1)) & (F.col("event_id") * batches < (k + 1) * (most + 1)))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


@query("SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    stream, folder = _event_stream(spark, d)
    keyed = stream.withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    out = streams.drained(streams.first_seen(keyed, "key", "ts", "3650 days"), "dedupe", f"{folder}/state", f"{folder}/out")
    return out.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR b IS DISTINCT FROM event_type""")
def stream_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Four micro-batches; each user's last event is the state."""
    stream, folder = _landed_stream(spark, d)
    return state.run_to(state.revised(stream, "user_id", "event_id", "event_type"), f"{folder}/out", f"{folder}/state")


@query()
def stream_filter_new(spark: SparkSession, d: str) -> DataFrame:
    """Four micro-batches; the state is the keys of the events taken."""
    stream, folder = _landed_stream(spark, d)
    keyed = stream.select(F.col("event_id").alias("seq"), F.concat("event_type", F.pmod(F.xxhash64("event_id"), F.lit(2000))).alias("identity"), F.concat(F.lit("u"), "user_id").alias("fingerprint"))
    return state.take_new(keyed, "identity", "fingerprint", "seq", f"{folder}/out", f"{folder}/state").select("seq")


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s), r AS (SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, k)
    SELECT user_id, start, n FROM r WHERE last + INTERVAL 12 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    stream, folder = _event_stream(spark, d)
    out = streams.drained(streams.sessions(stream, "ts", "user_id", "12 hours"), "sessions", f"{folder}/state", f"{folder}/out")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    stream, folder = _event_stream(spark, d)
    out = streams.drained(streams.windowed(stream, "ts", "event_type", "value"), "windows", f"{folder}/state", f"{folder}/out")
    return out.withColumn("total", money.rounded(F.col("total"), 2)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    grouped = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "1 day"))
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")

from tidemark import fact_queries, posting_queries  # noqa: E402, F401 - they register their queries here
