"""Positions, scaling, time bins and trends of daily series.

A series holds one row per key and date, so even an unkeyed window or a hot key
is bounded by the calendar (366 rows a year), not by the posts behind it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scores import normalized
from .common import attach


def add_position(df: DataFrame, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Column ``i``: 0-based place of each row in its series, by date."""
    return df.withColumn("i", (F.row_number().over(W.partitionBy(*keys).orderBy(date)) - 1).cast("long"))


def series_vs_price(daily: DataFrame, prices: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """A daily value beside the mid price of the same date, with positions."""
    own = [k for k in keys if k in prices.columns and k not in daily.columns]
    shared = [k for k in keys if k in prices.columns and k in daily.columns]
    left = daily.select(*[k for k in keys if k in daily.columns], "date", value)
    right = prices.select(*own, *shared, "date", "mid_price")
    return add_position(left.join(right, ["date", *shared]), keys).select(*keys, "date", "i", value, "mid_price")


def normalize_series(
    df: DataFrame, value: str, out: str, keys: Sequence[str] = (), lo: float | None = None, hi: float | None = None
) -> DataFrame:
    """Min-max scaling. A bound not given is taken from the series itself."""
    if lo is not None and hi is not None:
        return df.withColumn(out, normalized(F.col(value), F.lit(lo), F.lit(hi)))
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spanned = attach(df, span, keys, ["_lo", "_hi"])
    low = F.col("_lo") if lo is None else F.lit(lo)
    high = F.col("_hi") if hi is None else F.lit(hi)
    return spanned.withColumn(out, normalized(F.col(value), low, high)).drop("_lo", "_hi")


def time_bins(
    df: DataFrame, value: str, keys: Sequence[str] = (), date: str = "date", max_bins: int = 100, extent=None
) -> DataFrame:
    """Equal-width date bins over the data's span or a selected ``extent`` (first, last).

    Whole-day arithmetic keeps every date on one side of a bin edge.
    """
    day = F.unix_date(F.col(date))
    if extent is not None:
        df = df.filter(F.col(date).between(F.lit(extent[0]), F.lit(extent[1])))
    span = df.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    spanned = attach(df, span, keys, ["_first", "_last"])
    if extent is not None:
        first, last = (F.unix_date(F.lit(e).cast("date")) for e in extent)
        spanned = spanned.withColumn("_first", first).withColumn("_last", last)
    width = F.greatest(F.col("_last") - F.col("_first"), F.lit(1))
    place = F.floor((day - F.col("_first")) * max_bins / width)
    return (
        spanned.withColumn("bin", F.least(place, F.lit(max_bins - 1)).cast("int"))
        .groupBy(*keys, "bin")
        .agg(
            F.min(date).alias("first_date"),
            F.max(date).alias("last_date"),
            F.count("*").alias("days"),
            F.sum(value).alias("total"),
            F.avg(value).alias("mean"),
        )
    )


def _basis(t: Column, degree: int) -> Column:
    """Chebyshev polynomial of the first kind on [-1, 1]."""
    return F.cos(F.acos(t) * degree)


def _solver(degree: int):
    """Coefficients from the moments of T_m and y*T_m, a batch of keys at a time."""
    n = degree + 1
    places = np.arange(n)
    add, diff = np.add.outer(places, places), np.abs(np.subtract.outer(places, places))

    def solve(moments: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for own, cross in moments:
            if not len(own):
                yield pd.Series([], dtype=object)
                continue
            s, b = np.stack(own.to_numpy()), np.stack(cross.to_numpy())
            gram = (s[:, add] + s[:, diff]) / 2
            yield pd.Series(list(np.einsum("kij,kj->ki", np.linalg.pinv(gram, rcond=1e-12, hermitian=True), b)))

    return F.pandas_udf(solve, "array<double>")


def polynomial_trend(
    df: DataFrame, value: str, keys: Sequence[str] = (), date: str = "date", degree: int = 9
) -> DataFrame:
    """Least-squares polynomial of a value on its date, with the fitted value of each row.

    Dates are scaled to [-1, 1] and the fit is made in a Chebyshev basis: one
    aggregate gives the ``3*degree+2`` moments of a key, and only those numbers
    leave the JVM for the small linear solve.
    """
    day = F.unix_date(F.col(date)).cast("double")
    rows = df.filter(F.col(value).isNotNull())
    span = rows.groupBy(*keys).agg(F.min(day).alias("_first"), F.max(day).alias("_last"))
    middle, half = (F.col("_first") + F.col("_last")) / 2, F.greatest((F.col("_last") - F.col("_first")) / 2, F.lit(0.5))
    scaled = attach(rows, span, keys, ["_first", "_last"]).withColumn("_t", (day - middle) / half)
    t, y = F.col("_t"), F.col(value).cast("double")
    moments = scaled.groupBy(*keys).agg(
        F.array(*[F.sum(_basis(t, m)) for m in range(2 * degree + 1)]).alias("own"),
        F.array(*[F.sum(_basis(t, m) * y) for m in range(degree + 1)]).alias("cross"),
    )
    fitted = moments.select(*keys, _solver(degree)("own", "cross").alias("_coef"))
    out = attach(scaled, fitted, keys, ["_coef"])
    trend = sum((F.col("_coef")[m] * _basis(t, m) for m in range(1, degree + 1)), F.col("_coef")[0])
    return out.withColumn("trend", trend).select(*df.columns, "trend")
