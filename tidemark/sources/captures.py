"""Listings from saved texts: search results, page captures, JSON-LD in pages."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import html_to_text

#: What a result is refused for, in this order.
SOCIAL = r"(?i)^https?://(?:[a-z0-9-]+\.)?(?:linkedin|facebook|x|twitter|instagram|youtube|reddit|glassdoor|indeed|ziprecruiter)\.com/"
EDITORIAL = (
    r"(?i)\b(?:career overview|how to (?:get|become)|guide to|what is|why |top \d+|best \d+|\d+ (?:tips|ways|things)|overview|explained|vs\.?\s|comparison"
    r"|salary guide|certification|exam|course|webinar|podcast|blog|news|press release|announces|awarded)\b"
)
NO_HARVEST = ["indeed.com", "ziprecruiter.com", "glassdoor.com", "linkedin.com"]
INDEX = r"(?i)/(?:jobs|careers|openings|search-results|job-category|category|search)/?$"
POSTING = r"(?i)/(?:job|jobs|job-details|job-v1|careers|career|opening|openings|vacanc\w*|position|posting|workspread|recruiting)s?[-/][^/?#]{4,}"
HOST_HINT, SLUG = r"(?i)(?:job|career|hiring|recruit|talent|employ|vacanc)", r"/[^/?#]{8,}"
AGE_DAYS = {"hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}
EMPLOYMENT = ["Full-Time", "Part-Time", "Full Time", "Part Time", "Contract", "Internship", "Temporary", "Seasonal", "Freelance"]
DEPTH = 6
#: A listing's line is free text, then maybe a price or span of prices, then maybe an age.
PRICE = r"\$[\d,]+(?:\.\d+)?(?:\s*[-–]\s*\$?[\d,]+(?:\.\d+)?)?(?:\s*/\s*\w+)?"
LISTING = rf"^(.+?)(?:\s*({PRICE}))?(?:\s*●\s*Posted\s+([^●\n]+?))?\s*$"
AGE = r"(?i)^(\d{1,6})\s+(hour|day|week|month|year)s?\s+ago$"


def rejection(url: Column, title: Column) -> Column:
    """Why a result isn't one posting, null if it is; the first reason of seven."""
    bare = F.regexp_replace(url, r"\?.*$", "")
    host = F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)
    rest = F.regexp_replace(bare, r"^[a-zA-Z]+://[^/]*", "")
    excluded = F.lit(False)
    for name in NO_HARVEST:
        excluded = excluded | F.contains(F.lower(url), F.lit(name))
    return (
        F.when((F.coalesce(F.trim(url), F.lit("")) == "") | (F.coalesce(F.trim(title), F.lit("")) == ""), "missing url or title")
        .when(url.rlike(SOCIAL), "social or excluded aggregator").when(title.rlike(EDITORIAL), "editorial or announcement, not a posting")
        .when(excluded, "terms prohibit automated collection").when(bare.rlike(INDEX), "listing index, not one posting")
        .when(url.rlike(POSTING) | (host.rlike(HOST_HINT) & rest.rlike(SLUG)), F.lit(None)).otherwise("no individual-posting path")
    )


def _lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("_key"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")).alias("at", "line"))


def search_results(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, title, url, published, author, highlights, reason of each record of saved result sets.

    A record begins at a Title line; the lines after a Highlights line belong to it up to the next
    labelled line.  A record is judged first; of those that are postings the first of each URL (fragment off) stays, over all
    texts in the order of their keys.
    """
    label = r"^(Title|URL|Published|Author|Highlights):\s*(.*)$"
    own = Window.partitionBy("_key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(df, key, text).withColumn("label", F.regexp_extract("line", label, 1)).withColumn("value", F.trim(F.regexp_extract("line", label, 2)))
    rows = rows.withColumn("record", F.sum(F.when(F.col("label") == "Title", 1).otherwise(0)).over(own))
    rows = rows.withColumn("under", F.last(F.when(F.col("label") != "", F.col("label")), ignorenulls=True).over(own)).where("record > 0")
    told = F.when(F.col("label") == "Highlights", F.col("value")).when((F.col("label") == "") & (F.col("under") == "Highlights") & ~F.trim("line").isin("", "..."), F.trim("line"))
    last = lambda name: F.max_by("value", F.when(F.col("label") == name, F.col("at")))
    told = F.array_sort(F.collect_list(F.when(told != "", F.struct("at", told.alias("t")))))
    out = rows.groupBy("_key", "record").agg(
        F.min("at").alias("at"), last("Title").alias("title"), last("URL").alias("url"), last("Published").alias("published"), last("Author").alias("author"),
        F.array_join(F.transform(told, lambda x: x["t"]), "\n").alias("highlights"),
    ).where("url != ''")
    out = out.withColumn("reason", rejection(F.col("url"), F.col("title")))
    # Of one URL the first posting stays, in whatever text it stands; refused rows stay all, with their reasons.
    first = F.row_number().over(Window.partitionBy(F.regexp_replace("url", "#.*$", ""), F.col("reason").isNull()).orderBy("_key", "at"))
    out = out.withColumn("_n", first).where("_n = 1 or reason is not null")
    return out.select(F.col("_key").alias(key), "at", "title", "url", "published", "author", "highlights", "reason")


def captured_listings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, source_url, retrieved, title, meta, state, employment_type, pay, posted_at of each `## ` line of a capture.

    The meta line is the next one with text, unless that is a title too: what stands before a price or a `●` tells place and
    schedule, the price is the pay, and an age behind `Posted` gives an approximate time before the retrieval.  An age anywhere
    else is none.  Employer and city are not guessed.
    """
    w = Window.partitionBy("_key").orderBy("at")
    t = F.col(text)
    heads = df.select(
        F.col(key).alias("_key"), F.regexp_extract(t, r"SOURCE_URL:\s*(\S+)", 1).alias("source_url"), F.regexp_extract(t, r"RETRIEVED:\s*(\S+)", 1).try_cast("timestamp").alias("retrieved"),
    )
    rows = _lines(df, key, text).where(F.trim("line") != "").withColumn("next", F.lead(F.trim("line")).over(w))
    rows = rows.withColumn("title", F.trim(F.regexp_extract("line", r"^##\s+(.*)$", 1))).where("title != ''")
    meta = F.when(~F.startswith(F.col("next"), F.lit("##")), F.col("next"))
    rows = rows.withColumn("meta", meta).join(heads, "_key").where("source_url != ''")
    n, unit = F.regexp_extract("age", AGE, 1).try_cast("int"), F.lower(F.regexp_extract("age", AGE, 2))
    rows = rows.withColumns({name: F.regexp_extract("meta", LISTING, k) for k, name in ((1, "head"), (2, "pay"), (3, "age"))})
    pay = F.col("pay")
    days = n * F.element_at(F.create_map(*(F.lit(x) for pair in AGE_DAYS.items() for x in pair)), unit)
    kinds = F.coalesce(*(F.when(F.contains("head", F.lit(k)), F.lit(k)) for k in EMPLOYMENT), F.lit(None))
    state = F.regexp_extract("head", r",\s*([A-Z]{2})\b", 1)
    return rows.select(
        F.col("_key").alias(key), "at", "source_url", "retrieved", "title", "meta", F.when(state != "", state).alias("state"), kinds.alias("employment_type"), F.when(pay != "", pay).alias("pay"),
        F.timestamp_seconds(F.unix_timestamp("retrieved") - F.round(days * 86400)).alias("posted_at"),
    )


_SCRIPT = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script\s*>", re.I | re.S)


def _nodes(x: object, depth: int = 0) -> Iterator[dict]:
    """JobPosting objects under the keys that may hold them."""
    if depth > DEPTH:
        return
    if isinstance(x, list):
        for y in x:
            yield from _nodes(y, depth + 1)
    elif isinstance(x, dict):
        kind = x.get("@type")
        if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
            yield x
        else:
            for key in ("@graph", "itemListElement", "mainEntity", "item"):
                if key in x:
                    yield from _nodes(x[key], depth + 1)


def json_ld(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, posting (JSON) of every JobPosting in the pages' linked data; blocks that don't parse are passed over."""
    kind = pages.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch["key"], batch["html"], strict=True):
                at = 0
                for block in _SCRIPT.findall(text or ""):
                    try:
                        found = list(_nodes(json.loads(block)))
                    except (ValueError, RecursionError):
                        continue
                    for node in found:
                        out.append((k, at, json.dumps(node)))
                        at += 1
            yield pd.DataFrame(out, columns=["key", "at", "posting"])

    return pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInPandas(walk, f"key {kind}, at int, posting string").withColumnRenamed("key", key)


#: The free texts of a posting in linked data, in order, and the facts that follow them under a label.
NARRATIVE = ["description", "responsibilities", "qualifications", "skills", "experienceRequirements", "educationRequirements", "jobBenefits", "incentiveCompensation", "workHours", "specialCommitments"]
LABELLED = [("Employment type", "employmentType"), ("Security clearance", "securityClearanceRequirement"), ("Job category", "occupationalCategory"), ("Industry", "industry")]


def json_ld_postings(pages: DataFrame, key: str, html: str, url: str | None = None) -> DataFrame:
    """key, source_id, url, title, employer, location, remote, description, employment_type, posted_at, salary_min, salary_max, salary_period of linked data postings.

    url is the page's own, which a posting without one takes.  A posting's id is its identifier, else its URL if that isn't the page's, else the
    page's with its title and place, else a hash.  The description holds every free text of the posting and labelled facts behind them.
    """
    p = F.col("posting")
    get = lambda x: F.get_json_object(p, x)
    solid = lambda c: F.nullif(F.trim(c), F.lit(""))
    place = lambda x: F.coalesce(get(f"$.jobLocation.address.{x}.name"), get(f"$.jobLocation.address.{x}"), get(f"$.jobLocation[0].address.{x}.name"), get(f"$.jobLocation[0].address.{x}"))
    low, high = F.coalesce(get("$.baseSalary.value.minValue"), get("$.baseSalary.value.value")), F.coalesce(get("$.baseSalary.value.maxValue"), get("$.baseSalary.value.value"))
    found = json_ld(pages, key, html)
    page = F.lit(None).cast("string")
    if url is not None:
        found, page = found.join(pages.select(key, F.col(url).alias("_page")), key), F.col("_page")
    said = F.coalesce(solid(get("$.url")), solid(get("$['@id']")))
    link = F.when(said.rlike("^https?://"), said).when(said.startswith("//"), F.concat(F.lit("https:"), said)).when(
        said.startswith("/") & page.isNotNull(), F.concat(F.regexp_extract(page, "^(https?://[^/]+)", 1), said)).otherwise(page)
    where = F.concat_ws(", ", place("addressLocality"), place("addressRegion"), place("addressCountry"))
    title = html_to_text(get("$.title"))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", title, where)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    ident = F.coalesce(
        solid(get("$.identifier.value")), solid(get("$.identifier.name")), F.when(~get("$.identifier").startswith("{"), solid(get("$.identifier"))), F.when(~link.eqNullSafe(page), link),
        F.when(slug != "", F.concat(page, F.lit("#"), F.substring(slug, 1, 80))), F.sha2(p, 256),
    )
    kind = F.coalesce(F.array_join(F.from_json(get("$.employmentType"), "array<string>"), ", "), get("$.employmentType"))
    facts = [F.concat(F.lit(f"{label}: "), kind if x == "employmentType" else get(f"$.{x}"), F.lit(".")) for label, x in LABELLED]
    text = html_to_text(F.concat_ws("\n\n", *(solid(get(f"$.{x}")) for x in NARRATIVE), *facts))
    return found.select(
        key, ident.alias("source_id"), link.alias("url"), title.alias("title"), F.coalesce(get("$.hiringOrganization.name"), F.when(~get("$.hiringOrganization").startswith("{"), get("$.hiringOrganization"))).alias("employer"),
        where.alias("location"), F.coalesce(F.upper(get("$.jobLocationType")) == "TELECOMMUTE", F.lit(False)).alias("remote"), text.alias("description"), kind.alias("employment_type"),
        get("$.datePosted").alias("posted_at"), low.try_cast("double").alias("salary_min"), high.try_cast("double").alias("salary_max"), F.lower(get("$.baseSalary.value.unitText")).alias("salary_period"),
    )


def feed(spark, folder: str, kind: str = "rss") -> DataFrame:
    """title, link, published, text of RSS items or Atom entries in XML files; names are matched without name spaces."""
    if kind == "rss":
        schema = "title string, link string, guid string, pubDate string, description string"
        rows = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(schema).load(folder)
        return rows.select("title", F.coalesce("link", "guid").alias("link"), F.col("pubDate").alias("published"), F.col("description").alias("text"))
    schema = "title string, link struct<_href:string>, id string, updated string, published string, summary string, content string"
    rows = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", "true").schema(schema).load(folder)
    return rows.select("title", F.coalesce("link._href", "id").alias("link"), F.coalesce("published", "updated").alias("published"), F.coalesce("summary", "content").alias("text"))


def sitemap(spark, folder: str) -> DataFrame:
    """loc, lastmod of sitemap files, gzipped ones too."""
    return spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", "true").schema("loc string, lastmod string").load(folder)
