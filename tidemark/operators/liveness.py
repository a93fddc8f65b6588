"""Whether fetched pages still offer a posting, and the board joined to that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a page says that no longer takes applications, in the order in which it is reported; statuses that mean gone; bytes of a page that are read.
EXPIRED = [
    "no longer accepting applications", "no longer accepting application", "this job is no longer available", "this position is no longer available", "this posting is no longer available",
    "the job you are looking for is no longer", "job posting has expired", "this job has expired", "this posting has expired", "posting is closed", "this requisition is closed",
    "this position has been filled", "position has since been filled", "we are no longer accepting", "job not found", "position not found", "requisition not found",
    "sorry, this job is not available", "sorry, this position is no longer", "the job you have selected is no longer", "job id is no longer active", "this opportunity is no longer available",
]
GONE_STATUSES, BODY_BYTES = [404, 410], 400_000
#: Paths of one posting, and last parts that are lists all the same.
ONE_POSTING = r"(?i)/(?:job|jobs|opening|position|posting|vacanc|requisition|career)s?[-/]([^/?#]+)"
A_LIST = r"(?i)^(?:search|results?|list|index|all|browse|home|apply|overview)$"


def visible_text(html: Column) -> Column:
    """Lower-case text of a page without scripts, styles and markup, apostrophes straight; null is empty."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(?:script|style)\b.*?</(?:script|style)>", " ")
    text = F.lower(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))
    return F.translate(text, "’‘", "''")


def _of_one_posting(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")
    tail = F.regexp_extract(path, ONE_POSTING, 1)
    return (tail != "") & ~tail.rlike(A_LIST)


def verdict(pages: DataFrame, url: str = "url", status: str = "status", body: str = "body", final_url: str = "final_url", body_bytes: int = BODY_BYTES) -> DataFrame:
    """url, state (live, gone, unknown), reason, http_status of fetched pages; a null status is a page that couldn't be reached.

    Gone are pages with status 404 or 410 and pages that say so; other errors tell nothing.  A page is read to body_bytes, as it is fetched.
    """
    rows = pages.withColumn("_text", visible_text(F.decode(F.substring(F.encode(F.coalesce(body, F.lit("")), "UTF-8"), 1, body_bytes), "UTF-8")))
    said = F.coalesce(*(F.when(F.contains("_text", F.lit(marker)), F.lit(marker)) for marker in EXPIRED))
    fetchable = F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))
    code, failed = F.col(status), F.col(status) >= 400
    trim = lambda c: F.regexp_replace(c, "/+$", "")
    moved = F.col(final_url).isNotNull() & (trim(F.col(final_url)) != trim(F.col(url))) & _of_one_posting(F.col(url)) & ~_of_one_posting(F.col(final_url))
    state = F.when(~fetchable | code.isNull(), "unknown").when(code.isin(GONE_STATUSES), "gone").when(failed, "unknown").when(said.isNotNull(), "gone").otherwise("live")
    reason = (
        F.when(~fetchable, "no fetchable url").when(code.isNull(), "unreachable").when(code.isin(GONE_STATUSES), F.concat(F.lit("HTTP "), code.cast("string")))
        .when(failed, F.concat(F.lit("HTTP "), code.cast("string"), F.lit(" (not a removal signal)"))).when(said.isNotNull(), F.concat(F.lit("page says '"), said, F.lit("'")))
        .when(moved, F.concat(F.lit("redirected to "), F.col(final_url))).otherwise("reachable")
    )
    return rows.select(url, state.alias("state"), reason.alias("reason"), code.alias("http_status"))


def recheck(board: DataFrame, checked: DataFrame, url: str = "url", drop_gone: bool = True) -> DataFrame:
    """The board with state and reason of its pages, rows that are gone left out; a URL that wasn't checked has no state.  Of several checks of one URL that of the least state stays."""
    one = checked.groupBy(url).agg(F.min(F.struct("state", "reason", "http_status")).alias("_l"))
    out = board.join(one.select(url, "_l.state", "_l.reason", "_l.http_status"), url, "left")
    return out.where(F.col("state").isNull() | (F.col("state") != "gone")) if drop_gone else out
