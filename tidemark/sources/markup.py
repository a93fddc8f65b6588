"""The structure of pages: elements with their depth and place, from which regions, texts without chrome and cards follow as columns."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import html_to_text

#: Tags without an end, tags whose insides are no text of the page, and what the name of a description's element holds.
VOID = "br img input hr meta link source col area base embed param track wbr".split()
CHROME = "script style nav header footer form select noscript template svg".split()
HINTS = (
    "jobdescription jobdetail jobbody jobcontent jobsummary jobad jobpost postingbody postingdetail vacancydetail description maincontent contentbody detailbody"
).split()
#: A region of so many characters is taken for the description.
LEAST_REGION = 120

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}


def structure(html: str) -> list[tuple[str, int, int, int, bool, str]]:
    """(tag, depth, first, past, chrome, names) of the elements of a page outside of chrome, and of the outermost chrome, in the order of their starts.

    first and past enclose an element's inside, of chrome its tags too.  An end tag closes the nearest open element of its
    name and all inside it; one without such an element is nothing.  What is open at the end ends there.
    """
    out: list[list] = []
    open_: list[tuple[str, int | None]] = []  # the tag and its place in out, None inside chrome
    hidden, at = 0, 0

    def close(to: int, inner: int, outer: int) -> None:
        nonlocal hidden
        for k in range(len(open_) - 1, to - 1, -1):
            _, place = open_.pop()
            if place is not None:
                # Elements that the end tag only implies end where it begins.
                out[place][3] = outer if out[place][4] and k == to else inner
                hidden -= out[place][4]

    while (m := _TOKEN.search(html, at)) is not None:
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in VOID:
            continue
        if m[1]:
            last = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == tag), None)
            if last is not None:
                close(last, m.start(), at)
            continue
        chrome = tag in CHROME
        if hidden:
            open_.append((tag, None))
        else:
            names = " ".join(re.sub("[^a-z0-9]", "", n.lower()) for n in _NAMES.findall(m[3]))
            open_.append((tag, len(out)))
            out.append([tag, len(open_), m.start() if chrome else at, len(html), chrome, names])
            hidden += chrome
        if tag in _RAW and (end := _RAW[tag].search(html, at)) is not None:
            at = end.start()
    return [tuple(row) for row in out]


_FIELDS = [("tag", pa.string()), ("depth", pa.int32()), ("first", pa.int32()), ("past", pa.int32()), ("chrome", pa.bool_()), ("names", pa.string())]


def elements(html: Column) -> Column:
    """array of struct(tag, depth, first, past, chrome, names) of a page, see structure; places count characters from 0.  A null page has none."""

    def found(pages: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct(_FIELDS))
        return pa.array([[dict(zip((n for n, _ in _FIELDS), row, strict=True)) for row in structure(page)] for page in (p.as_py() or "" for p in pages)], kind)

    return F.arrow_udf(found, "array<struct<tag string, depth int, first int, past int, chrome boolean, names string>>")(html)


def text_of(html: Column, found: Column, first: Column, past: Column) -> Column:
    """The text of a page's part without the chrome in it."""
    gone = F.filter(found, lambda e: e["chrome"] & (e["first"] >= first) & (e["past"] <= past))
    starts = F.concat(F.array(first), F.transform(gone, lambda e: e["past"]))
    ends = F.concat(F.transform(gone, lambda e: e["first"]), F.array(past))
    return html_to_text(F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(html, a + 1, F.greatest(b - a, F.lit(0)))), " "))


def with_detail_text(pages: DataFrame, html: str = "html", name: str = "detail", least: int = LEAST_REGION) -> DataFrame:
    """pages with `name`: the longest text of an element that is named like a description, if it has `least` characters; else that or the page's text, whichever is longer.

    Of texts of one length the first counts.  Scripts, styles, navigation, headers, footers, forms and the like are no text.  A null or empty
    page has an empty text.  Pages of any length are read whole; other columns are returned as they are.
    """
    page = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    out = pages.withColumn("_html", page).withColumn("_found", elements(F.col("_html")))
    named = F.filter("_found", lambda e: ~e["chrome"] & e["names"].rlike("|".join(HINTS)))
    out = out.withColumn("_regions", F.transform(named, lambda e: text_of(F.col("_html"), F.col("_found"), e["first"], e["past"])))
    out = out.withColumn("_page", text_of(F.col("_html"), F.col("_found"), F.lit(0), F.length("_html")))
    longest = F.aggregate("_regions", F.lit(""), lambda a, t: F.when(F.length(t) > F.length(a), t).otherwise(a))
    out = out.withColumn("_best", longest)
    best = F.when((F.length("_best") >= least) | (F.length("_best") > F.length("_page")), F.col("_best")).otherwise(F.col("_page"))
    return out.withColumn(name, best).select(*(F.col(f"`{c}`") for c in pages.columns if c != name), F.col(name))


def cards(pages: DataFrame, key: str, pattern: str, html: str = "html") -> DataFrame:
    """key, at (from 0) and card: the markup inside each element one of whose folded names matches a pattern, outermost ones only, in the order of the page."""
    found = pages.select(F.col(key), F.coalesce(F.col(html), F.lit("")).alias("_html")).withColumn("_found", elements(F.col("_html")))
    own = found.withColumn("_own", F.filter("_found", lambda e: ~e["chrome"] & e["names"].rlike(rf"(?:^| )(?:{pattern})(?: |$)")))
    outer = F.filter("_own", lambda e: ~F.exists("_own", lambda o: (o["depth"] < e["depth"]) & (o["first"] <= e["first"]) & (o["past"] >= e["past"])))
    rows = own.select(key, "_html", F.posexplode(outer).alias("at", "_e"))
    return rows.select(key, "at", F.substring("_html", F.col("_e.first") + 1, F.col("_e.past") - F.col("_e.first")).alias("card"))
