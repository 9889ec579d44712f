"""Posts and quotes to daily frames.

The roll-ups are the only steps that read the big tables. They group by date (and
label) with map-side combine, so what is shuffled is days, not posts. All later
steps work on daily frames: one row per key and date, bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import month_key
from ..functions.scores import NEGATIVE, POSITIVE, fixed, mid_price, normalized, score_label, signed_score
from ..functions.text import strip_quotes
from .common import attach


def daily_info(posts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Posts per date and label, with their mean confidence."""
    return posts.groupBy(*keys, "date", "label").agg(F.count("*").alias("count"), F.avg("conf").alias("conf"))


def signed_daily(info: DataFrame) -> DataFrame:
    """Complete daily rows with a clean label and a signed score."""
    return (
        info.dropna("any")
        .withColumn("label", strip_quotes("label"))
        .withColumn("signed_score", signed_score("label", "conf"))
    )


def daily_sentiment(info: DataFrame, keys: Sequence[str] = (), require_both: bool = True) -> DataFrame:
    """Volume-weighted sentiment, volume and counts by sign, one row per day.

    One conditional aggregation stands for the joins of per-label frames.
    ``norm_count`` is scaled by the largest volume over all days, those without
    both signs included; ``require_both`` then drops such days.
    """
    count = F.col("count")
    days = (
        signed_daily(info)
        .groupBy(*keys, "date")
        .agg(
            fixed(F.sum(count * F.col("signed_score")) / F.sum(count)).alias("sentiment"),
            F.sum(count).alias("count"),
            F.sum(F.when(F.col("label") == NEGATIVE, count)).alias("negatives"),
            F.sum(F.when(F.col("label") == POSITIVE, count)).alias("positives"),
        )
    )
    top = days.groupBy(*keys).agg(F.max("count").alias("top_count"))
    days = attach(days, top, keys, ["top_count"])
    if require_both:
        days = days.filter(F.col("negatives").isNotNull() & F.col("positives").isNotNull())
    return days.select(
        *keys,
        "date",
        "sentiment",
        normalized(F.col("sentiment"), F.lit(-1.0), F.lit(1.0)).alias("norm_sent"),
        score_label("sentiment").alias("label"),
        "count",
        F.try_divide(F.col("count"), F.col("top_count")).alias("norm_count"),
        "negatives",
        "positives",
    )


def drop_outlier_days(daily: DataFrame, limit: float = 100000, column: str = "count") -> DataFrame:
    """Days below a volume limit; the limit itself is out."""
    return daily.filter(F.col(column) < limit)


def without_period(df: DataFrame, first, last, date: str = "date") -> DataFrame:
    """Rows outside an inclusive period; rows without a date stay out as well."""
    return df.filter(~F.col(date).between(F.lit(first), F.lit(last)))


def market_daily(quotes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Daily high and low of finer-grained quotes."""
    return quotes.groupBy(*keys, "date").agg(F.max("high").alias("high"), F.min("low").alias("low"))


def common_range(*frames: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """The dates that all frames cover: one row (lo, hi), or one per key (keys, lo, hi).

    Every key has a range of its own, so a key that ends early shortens no other. Frames without
    the keys bound all of them. Empty frames do not narrow a range. Keys hold no NULL.
    """
    own = [f for f in frames if all(k in f.columns for k in keys)]
    shared = [f for f in frames if f not in own]

    def spans(parts: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
        found = None
        for part in parts:
            span = part.groupBy(*by).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
            found = span if found is None else found.unionByName(span)
        return found.groupBy(*by).agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))

    ranges = spans(own, keys)
    if not shared:
        return ranges
    outer = spans(shared, []).select(F.struct("lo", "hi").alias("span")).scalar()
    return ranges.select(*keys, F.greatest("lo", outer["lo"]).alias("lo"), F.least("hi", outer["hi"]).alias("hi"))


def shared_range(ranges: DataFrame) -> DataFrame:
    """One row (lo, hi): the dates that the ranges of all keys have in common."""
    return ranges.agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))


def in_range(df: DataFrame, bounds: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose date lies in the inclusive range that ``bounds`` holds, with ``keys`` in that of their key."""
    if keys:
        cut = df.join(bounds.select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), list(keys))
        return cut.filter(F.col(date).between(F.col("_lo"), F.col("_hi"))).select(*df.columns)
    span = bounds.select(F.struct("lo", "hi").alias("span")).scalar()
    return df.filter(F.col(date).between(span["lo"], span["hi"]))


def for_each_range(df: DataFrame, bounds: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The rows of a keyless daily frame once for every key whose range holds their date.

    Ranges are spelled out as dates, so this is an equi-join whose size is keys times days.
    """
    days = bounds.filter("lo <= hi").select(*keys, F.explode(F.sequence("lo", "hi")).alias(date))
    return days.join(df, date)


def distinct_dates(*frames: DataFrame, date: str = "date") -> DataFrame:
    """Every date of any frame once."""
    dates = frames[0].select(date)
    for frame in frames[1:]:
        dates = dates.unionByName(frame.select(date))
    return dates.distinct()


def price_frame(market: DataFrame, dates: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mid price, and its place between its lowest and highest; only on ``dates`` if given."""
    prices = market.dropna("any")
    if dates is not None:
        prices = prices.join(dates.select("date").distinct(), "date")
    prices = prices.withColumn("mid_price", mid_price())
    span = prices.groupBy(*keys).agg(F.min("mid_price").alias("lo_price"), F.max("mid_price").alias("hi_price"))
    prices = attach(prices, span, keys, ["lo_price", "hi_price"])
    return prices.select(
        *keys,
        "date",
        "high",
        "low",
        "mid_price",
        normalized(F.col("mid_price"), F.col("lo_price"), F.col("hi_price")).alias("norm_mid_price"),
    )


def monthly_mean_volume(daily: DataFrame, keys: Sequence[str] = (), column: str = "count") -> DataFrame:
    """Mean daily volume of each month."""
    return daily.groupBy(*keys, month_key("date").alias("month")).agg(F.avg(column).alias(column))
