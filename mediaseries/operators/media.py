"""Several media side by side. Input: one daily frame with a ``medium`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import month_key, month_start
from ..functions.scores import fixed, normalized, score_label

# The media, in the order their columns are laid out.
MEDIA = ("news", "reddit", "twitter", "telegram")


def _of(medium: str, column: str) -> Column:
    return F.max(F.when(F.col("medium") == medium, F.col(column)))


def _sum(columns: Sequence[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total


def media_summary(
    daily: DataFrame, media: Sequence[str] = MEDIA, limited: str | None = "twitter", limit: float = 100000
) -> DataFrame:
    """One row per day that every medium has: sentiment and volume of each, their mean and total.

    A conditional aggregation takes the place of joining the media one by one.
    Days on which the ``limited`` medium reaches the limit are left out.
    """
    picks = [
        _of(m, column).alias(f"{m}_{out}")
        for m in media
        for column, out in (("sentiment", "sentiment"), ("norm_count", "normalized_count"), ("count", "count"))
    ]
    days = daily.groupBy("date").agg(*picks)
    for m in media:
        days = days.filter(F.col(f"{m}_count").isNotNull())
    days = days.fillna(0)
    if limited is not None:
        days = days.filter(F.col(f"{limited}_count") < limit)
    mean = fixed(_sum([f"{m}_sentiment" for m in media]) / len(media))
    return (
        days.withColumn("sentiment", mean)
        .withColumn("norm_sent", normalized(F.col("sentiment"), F.lit(-1.0), F.lit(1.0)))
        .withColumn("label", score_label("sentiment", neutral=False))
        .withColumn("count", _sum([f"{m}_count" for m in media]))
    )


def melt_media(summary: DataFrame, column: str, media: Sequence[str] = MEDIA, id_column: str = "date") -> DataFrame:
    """Long frame (date, medium, value) of one measure."""
    wide = summary.select(id_column, *[F.col(f"{m}_{column}").alias(m) for m in media])
    return wide.unpivot([id_column], list(media), "medium", column)


def media_monthly(daily: DataFrame, media: Sequence[str] = MEDIA) -> DataFrame:
    """Monthly mean volume of each medium, for months every medium has.

    One aggregation gives what outer joins of per-medium months without their gaps would.
    """
    means = [F.avg(F.when(F.col("medium") == m, F.col("count"))).alias(f"{m}_count") for m in media]
    return daily.groupBy(month_key("date").alias("month")).agg(*means).dropna("any")


def media_heatmap(summary: DataFrame, media: Sequence[str] = MEDIA) -> DataFrame:
    """Mean sentiment per month and medium."""
    long = melt_media(summary, "sentiment", media)
    return long.groupBy(month_start("date").alias("month"), "medium").agg(F.avg("sentiment").alias("sentiment"))
