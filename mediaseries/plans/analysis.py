"""The analyses a user runs: one medium (or many by key) against a price, all media together, users."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.media import MEDIA, media_summary
from ..operators.rollup import (
    common_range,
    daily_info,
    daily_sentiment,
    distinct_dates,
    drop_outlier_days,
    for_each_range,
    in_range,
    market_daily,
    price_frame,
    shared_range,
)
from ..operators.series import series_vs_price
from ..session import stage


@dataclass(frozen=True)
class Analysis:
    """Daily frames of one analysis; ``series`` puts any daily value beside the price.

    ``bounds`` has the common range, one row per key if there are keys; ``dates`` only exists without keys.
    """

    daily: DataFrame
    prices: DataFrame
    bounds: DataFrame
    dates: DataFrame | None
    keys: tuple[str, ...] = ()
    matching: DataFrame | None = None

    def series(self, value: str) -> DataFrame:
        daily = self.daily
        if self.matching is not None:
            daily = daily.join(self.matching, [k for k in self.keys if k in daily.columns])
        return stage(series_vs_price(daily, self.prices, value, self.keys), "series")


def analyse(
    posts: DataFrame,
    quotes: DataFrame,
    keys: Sequence[str] = (),
    outlier_limit: float | None = None,
    pairs: Sequence[str] = (),
    matching: DataFrame | None = None,
) -> Analysis:
    """Posts and quotes to the daily frames all later measures read.

    ``keys`` are columns that tell series of posts apart (the medium), ``pairs`` columns that tell
    prices apart. Every series has a date range of its own: its days that the prices cover too, as if it were
    analysed alone. With both, ``matching`` (keys, pairs) says which series meets which price.
    Each big table is scanned once: its roll-up is written as a small table
    before ranges, scaling and joins read it several times.
    """
    if keys and pairs and matching is None:
        raise ValueError("many series and many prices need a frame that matches them")
    info = stage(daily_info(posts, keys), "daily_info").dropna("any")
    market = stage(market_daily(quotes, pairs), "market_daily").dropna("any")
    bounds = common_range(info, market.select("date", "high", "low"), keys=keys)
    daily = daily_sentiment(in_range(info, bounds, keys=keys), keys)
    dates = None if keys else in_range(distinct_dates(market, info), bounds)
    if pairs:
        prices = price_frame(in_range(market, common_range(market, info.select("date"), keys=pairs), keys=pairs), keys=pairs)
    elif keys:
        prices = price_frame(for_each_range(market, bounds, keys), keys=keys)
    else:
        prices = price_frame(in_range(market, bounds))  # the dates hold every market date of the range
    if outlier_limit is not None:
        daily = drop_outlier_days(daily, outlier_limit)
    return Analysis(daily, prices, bounds, dates, (*keys, *pairs), matching)


@dataclass(frozen=True)
class MediaAnalysis:
    """``daily`` has a row per medium and day, ``summary`` one per day all media share."""

    daily: DataFrame
    summary: DataFrame
    prices: DataFrame

    def series(self, value: str) -> DataFrame:
        return stage(series_vs_price(self.summary, self.prices, value), "media_series")


def analyse_media(
    posts: DataFrame, quotes: DataFrame, media: Sequence[str] = MEDIA, limited: str = "twitter", limit: float = 100000
) -> MediaAnalysis:
    """All media of one ``medium`` column, over the one range that all of them and the prices cover.

    Prices keep their scaling when cut to the summary's days.
    """
    info = stage(daily_info(posts.filter(F.col("medium").isin(list(media))), ["medium"]), "media_info").dropna("any")
    market = stage(market_daily(quotes), "market_daily").dropna("any")
    bounds = shared_range(common_range(info, market, keys=["medium"]))
    daily = daily_sentiment(in_range(info, bounds), ["medium"])
    prices = price_frame(in_range(market, bounds))
    summary = media_summary(daily, media, limited, limit)
    span = summary.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return MediaAnalysis(daily, summary, in_range(prices, span))
