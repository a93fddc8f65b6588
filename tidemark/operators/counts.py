"""Tallies, shares, pay statistics, time lines and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.money import rounded
from tidemark.operators.ranks import numbered
from tidemark.operators.storage import stored


def tally(df: DataFrame, value: str, order: str, top: int = 0) -> DataFrame:
    """value and n: counts whatever the case, shown in the spelling seen first by `order`; most first, then by name.  top 0 is all."""
    counted = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(F.lower(value).alias("_k"))
    shown = counted.agg(F.min_by(F.struct(value), F.struct(order, value))[value].alias("value"), F.count("*").alias("n"))
    out = shown.select("value", "n").orderBy(F.desc("n"), "value")
    return out.limit(top) if top > 0 else out


def facet_share(df: DataFrame, tags: str, amount: str | None = None) -> DataFrame:
    """tag, n, share, median_amount: rows with each tag, as a share of the rows with any."""
    keep = df.select(F.array_distinct(tags).alias("_tags"), F.col(amount).alias("_a") if amount else F.lit(None).cast("double").alias("_a")).where(F.size("_tags") > 0)
    base = keep.agg(F.count("*").alias("_base"))
    counted = keep.select(F.explode("_tags").alias("tag"), "_a").groupBy("tag").agg(F.count("*").alias("n"), F.median("_a").alias("_m"))
    joined = counted.join(F.broadcast(base))  # a single row
    return joined.select("tag", "n", rounded(F.col("n") / F.col("_base"), 4).alias("share"), rounded(F.col("_m"), 2).alias("median_amount"))


def quantiles(df: DataFrame, amount: str, shares: list[float], *by: str) -> DataFrame:
    """by and `quantiles`, an array: exact quantiles, linear between ranks, of an amount that is not null, in total or by group.

    Values are dealt by ranges of group and value and get their ranks from the ranges' counts (ranks.numbered); the two rows
    around each share are picked by rank.  So a group of any size is spread, and no state holds more than a few numbers.
    """
    part = F.struct(*by) if by else F.lit(0)
    ranked = numbered(df.where(F.col(amount).isNotNull()).select(part.alias("_group"), F.col(amount).cast("double").alias("_v")), "_group", ["_v"])
    at = [F.lit(q) * (F.col("n") - 1) for q in shares]
    ends = [(F.floor(x), F.ceil(x)) for x in at]
    near = F.lit(False)
    for low, high in ends:
        near = near | (F.col("pos") == low) | (F.col("pos") == high)
    picked = ranked.where(near).groupBy("_group", "n").agg(*(
        F.max(F.when(F.col("pos") == end, F.col("_v"))).alias(f"_{k}{side}") for k, pair in enumerate(ends) for side, end in zip("lh", pair, strict=True)
    ))
    between = [F.col(f"_{k}l") + (F.col(f"_{k}h") - F.col(f"_{k}l")) * (x - F.floor(x)) for k, x in enumerate(at)]
    return picked.select(*(F.col("_group")[b].alias(b) for b in by), F.array(*between).alias("quantiles"))


def amount_stats(df: DataFrame, amount: Column, *by: str) -> DataFrame:
    """count, min, max, median, p25, p75 (linear between ranks) of an amount, in total or by group."""
    rows = stored(df.select(*by, amount.cast("double").alias("_a")).where("_a is not null"), "amounts")
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_a").alias("lo"), F.max("_a").alias("hi"))
    middle = quantiles(rows, "_a", [0.25, 0.5, 0.75], *by).withColumnsRenamed({b: f"_{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    stats = stats.join(middle, same, "left")
    return stats.select(
        *by, "n", rounded(F.col("lo"), 2).alias("min"), rounded(F.col("hi"), 2).alias("max"), rounded(F.col("quantiles")[1], 2).alias("median"),
        rounded(F.col("quantiles")[0], 2).alias("p25"), rounded(F.col("quantiles")[2], 2).alias("p75"),
    )


def timeline(df: DataFrame, when: str, last: int = 120) -> DataFrame:
    """month (yyyy-MM) and n for every month from first to last, empty ones too, at most the `last` latest."""
    months = df.where(F.col(when).isNotNull()).groupBy(F.trunc(when, "month").alias("_m")).agg(F.count("*").alias("n"))
    ends = months.agg(F.min("_m").alias("a"), F.max("_m").alias("b")).where("a is not null")
    span = ends.select(F.explode(F.sequence(F.greatest("a", F.add_months("b", 1 - last)), "b", F.expr("interval 1 month"))).alias("_m"))
    return span.join(months, "_m", "left").select(F.date_format("_m", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def growth(df: DataFrame, value: str, when: str, days: int = 90, least: int = 3) -> DataFrame:
    """value, recent, prior, change for values that grew in the `days` before the last time over the `days` before those.

    Values are counted whatever their case and shown as spelled first in the recent window, of spellings of one time the least.  The windows hang on the
    latest time in the data, not on now; nothing is told below `least` dated rows.
    """
    dated = df.where(F.col(when).isNotNull())
    anchor = dated.agg(F.max(when).alias("_last"), F.count("*").alias("_dated")).where(F.col("_dated") >= least)
    span = F.expr(f"interval {days} days")
    rows = dated.join(F.broadcast(anchor))  # a single row
    recent, prior = F.col(when) >= F.col("_last") - span, (F.col(when) < F.col("_last") - span) & (F.col(when) >= F.col("_last") - span - span)
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.lower(value).alias("_k")).agg(
        F.min_by(F.struct(value), F.struct((~recent).alias("old"), when, value))[value].alias("value"), F.count_if(recent).alias("recent"), F.count_if(prior).alias("prior")
    ).drop("_k")
    return counted.withColumn("change", F.col("recent") - F.col("prior")).where("change > 0").orderBy(F.desc("change"), F.desc("recent"), "value")


def month_movement(months: DataFrame) -> DataFrame:
    """month, n, change and ratio against the month before (null ratio for a prior of zero), direction."""
    before = F.lag("n").over(Window.orderBy("month"))  # at most the 120 rows of a time line
    out = months.withColumn("_b", before).withColumn("change", F.col("n") - F.col("_b"))
    return out.select(
        "month", "n", "change", F.when(F.col("_b") != 0, rounded(F.col("change") / F.col("_b"), 4)).alias("ratio"),
        F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").when(F.col("change") == 0, "flat").alias("direction"),
    )


def pay_bands(stats: DataFrame) -> DataFrame:
    """Bands in order of their middle, those out of order within left out."""
    return stats.where("p25 <= median and median <= p75").orderBy(F.desc("median"))


def share_of_any(df: DataFrame, values: str, seq: str, top: int = 0) -> DataFrame:
    """name, count, share of the values of an array column, one a row whatever the spelling; the share is of the rows that have any value."""
    rows = df.where(F.size(values) > 0)
    each = rows.select(F.col(seq).alias("_seq"), F.explode(distinct_spellings(F.col(values))).alias("_v"))
    any_row = rows.agg(F.count("*").alias("_any"))
    out = tally(each, "_v", "_seq", top).crossJoin(F.broadcast(any_row))  # a single row
    return out.select(F.col("value").alias("name"), F.col("n").alias("count"), rounded(F.col("n") / F.col("_any"), 4).alias("share"))


def distinct_spellings(values: Column) -> Column:
    """An array without repeats whatever the case: of each the first spelling, in the order of first places; blanks go."""

    def firsts(solid: Column) -> Column:
        low = F.transform(solid, lambda x: F.lower(x))
        return F.filter(solid, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    # As a lambda's variable, so that what the values are made of is worked out once and not for each place.
    solid = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.get(F.transform(F.array(solid), firsts), F.lit(0))


def by_employer(df: DataFrame, employer: str, disciplines: str, pay: str, seq: str, top: int = 0) -> DataFrame:
    """name (first spelling), count, disciplines (most frequent first) and median_salary of each employer whatever the case."""
    rows = df.where(F.trim(F.coalesce(F.col(employer), F.lit(""))) != "").withColumn("_k", F.lower(F.trim(employer)))
    main = rows.groupBy("_k").agg(F.min_by(F.trim(employer), seq).alias("name"), F.count("*").alias("count"), rounded(F.median(pay), 2).alias("median_salary"))
    each = rows.select("_k", F.explode(disciplines).alias("d")).groupBy("_k", "d").agg(F.count("*").alias("n"))
    ranked = each.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "d"))), lambda x: x["d"]).alias("disciplines"))
    out = main.join(ranked, "_k", "left").select("name", "count", F.coalesce("disciplines", F.array().cast("array<string>")).alias("disciplines"), "median_salary")
    out = out.orderBy(F.desc("count"), "name")
    return out.limit(top) if top > 0 else out


def flagged_share(df: DataFrame, flag: str) -> DataFrame:
    """One row: count of rows with the flag and their share; no rows give a share of 0."""
    return df.agg(F.count_if(F.col(flag)).alias("count"), F.coalesce(rounded(F.try_divide(F.count_if(F.col(flag)), F.count("*")), 4), F.lit(0.0)).alias("share"))


def days_ago(then: Column, now: Column) -> Column:
    """today, yesterday, so many days or months ago; empty for no time."""
    days = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 86_400_000)
    told = F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
    return F.when(then.isNull(), "").otherwise(F.coalesce(told, F.concat(F.floor(days / 30).cast("string"), F.lit(" mo ago"))))
