"""Structure of pages against a second reading with the standard parser, over all pages."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.functions.text import html_to_text
from tidemark.sources import markup

DATA = "/root/testdata/sf0.001"


class Words(HTMLParser):
    """Words of a page outside of chrome, and of each element named like a description."""

    def __init__(self, page, chrome=tuple(markup.CHROME)):
        super().__init__(convert_charrefs=True)
        self.chrome = chrome
        self.path, self.page, self.regions = [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in markup.VOID:
            return
        named = "".join(c for k, v in attrs if k in ("class", "id", "itemprop") for c in (v or "").lower() if c.isalnum() and c.isascii())
        hidden = any(t in self.chrome for t, _ in (*self.path, (tag, None)))
        region = [] if not hidden and any(h in named for h in markup.HINTS) else None
        if region is not None:
            self.regions.append(region)
        self.path.append((tag, region))

    def handle_endtag(self, tag):
        at = [k for k, (t, _) in enumerate(self.path) if t == tag]
        if at and tag not in markup.VOID:
            del self.path[at[-1] :]

    def handle_data(self, data):
        if not any(t in self.chrome for t, _ in self.path):
            for words in (self.page, *(r for _, r in self.path if r is not None)):
                words += data.split()


def test_details_of_all_pages(spark):
    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r.detail for r in queries.QUERIES["page_details"](spark, DATA).collect()}
    assert got.keys() == pages.keys()
    for key, page in pages.items():
        read = Words(page + queries.page_region(key))
        want = max([r for r in read.regions if r], key=lambda r: len(" ".join(r)), default=[])
        want = want if len(" ".join(want)) >= markup.LEAST_REGION else max(read.page, want, key=lambda r: len(" ".join(r)))
        assert "".join(got[key].split()) == "".join(want), key


def test_texts_of_all_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in pages.select("page_id", "html", html_to_text("html").alias("text")).collect():
        read = Words(r.html or "", ("script", "style", "noscript", "template"))
        assert "".join(r.text.split()) == "".join(read.page), r.page_id


CASES = [
    ("<div class='job-description'><p>one<li>two</div>three", ["p/2", "li/3"], "one\ntwo"),
    ("a<nav>b<div id=jobDetail>c</div></nav>d", [], "a d"),
    ("<p>x</span>y<br>z", ["p/1"], "x y\nz"),
    ("<script>if (a<b) '</p>'</script><p>t</p><!-- <p>no</p> -->", ["p/1"], "t"),
    ("", [], ""), (None, [], ""), ("<div", [], "<div"),
]


@pytest.mark.parametrize("page, inside, text", CASES)
def test_small_pages(spark, page, inside, text):
    frame = spark.createDataFrame([(1, page, "old")], "k int, html string, detail string")
    row = markup.with_detail_text(frame.withColumn("e", markup.elements(F.col("html"))), least=1).first()
    tags = [f"{e.tag}/{e.depth}" for e in row.e if not e.chrome and "job" not in e.names]
    assert tags == inside and row.detail.split() == text.split()


def test_cards(spark):
    page = '<ul><li class="job card">A<div class="card">in</div></li><li class="card">B</li><li class="cardinal">C</li></ul><nav><p class=card>no</p></nav>'
    out = markup.cards(spark.createDataFrame([(1, page), (2, None)], "k int, html string"), "k", "(?:job)?card").orderBy("at").collect()
    assert [(r.k, r.at, r.card) for r in out] == [(1, 0, 'A<div class="card">in</div>'), (1, 1, "B")]
