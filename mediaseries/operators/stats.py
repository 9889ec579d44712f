"""Histograms, exact quantiles and box-plot summaries, for frames of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import stage
from .common import attach

ACCURACY = 10_000
#: Rank errors of the sketch by which a bracket reaches beyond its answer.
SLACK = 2.0


def histogram(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct value."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("rows"))


def _beside(df: DataFrame, summary: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """``attach`` for frames of any size: a keyed summary is written first.

    Spark then knows how small it is and need not shuffle ``df`` by its keys, hot ones included.
    """
    return attach(df, stage(summary, name) if keys else summary, keys, columns)


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key and probability.

    A quantile sketch brackets each answer: its rank error is at most 1/accuracy, and a bracket spans two of those
    each way. Rows below a bracket become one with their count and maximum, rows above it one with their
    minimum, where they lie; only the distinct values inside (about 4/accuracy of a key's rows) are shuffled. They are
    sorted by range, each task counts its share, and the counts of the tasks before it are added up, so
    no task holds a key or a bracket. The sketch steers the work, not the result: where an answer lies outside its
    bracket, all is done again with brackets sixteen times as wide, in the end from the smallest to the greatest value.
    """
    slack = SLACK / accuracy
    while True:
        found = stage(_bracketed(df, value, probs, list(keys), accuracy, slack), "quantiles")
        if slack >= 1 or found.where(F.col("quantile").isNull()).isEmpty():
            return found
        slack = max(slack * 16, SLACK / accuracy, 1e-6)


def _bracketed(df: DataFrame, value: str, probs: Sequence[float], keys: list[str], accuracy: int, slack: float) -> DataFrame:
    """One round of ``quantiles``: NULL where an answer lies outside its bracket of ``slack`` on either side."""
    spark = df.sparkSession
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    near = [p for q in probs for p in (max(q - slack, 0.0), min(q + slack, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", near, accuracy).alias("_near"), F.count("*").alias("_total"), F.min("_v").alias("_min"), F.max("_v").alias("_max")
    )

    def bracket(k: int, q: float):
        lo = F.col("_near")[2 * k] if q - slack > 0 else F.col("_min")
        hi = F.col("_near")[2 * k + 1] if q + slack < 1 else F.col("_max")
        return F.struct(F.lit(float(q)).alias("prob"), lo.alias("lo"), hi.alias("hi"))

    brackets = F.array(*[bracket(k, q) for k, q in enumerate(probs)])
    placed = _beside(rows, sketch, keys, ["_near", "_total", "_min", "_max"], "sketch").withColumn("_b", F.explode(brackets))
    zone = F.when(F.col("_v") < F.col("_b.lo"), 0).when(F.col("_v") <= F.col("_b.hi"), 1).otherwise(2).alias("_zone")
    inside = F.when(F.col("_v").between(F.col("_b.lo"), F.col("_b.hi")), F.col("_v")).alias("_inside")
    steps = placed.groupBy(*keys, F.col("_b.prob").alias("prob"), "_total", zone, inside).agg(
        F.count("*").alias("_n"), F.max("_v").alias("_most"), F.min("_v").alias("_least")
    )
    # Below the bracket only the greatest value can be asked for, above it only the smallest.
    steps = steps.withColumn("_v", F.when(F.col("_zone") == 0, F.col("_most")).otherwise(F.col("_least")))
    by = [*keys, "prob"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_steps = steps.repartitionByRange(tasks, *by, "_v").withColumn("_task", F.spark_partition_id())
    sorted_steps = stage(sorted_steps.select(*by, "_total", "_zone", "_v", "_n", "_task"), "steps")
    shares = sorted_steps.groupBy(*by, "_task").agg(F.sum("_n").alias("_share"))
    earlier = W.partitionBy(*by).orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = shares.select(*by, "_task", F.coalesce(F.sum("_share").over(earlier), F.lit(0)).alias("_offset"))
    within = W.partitionBy(*by, "_task").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = sorted_steps.join(offsets, [*by, "_task"]).withColumn("_upto", F.col("_offset") + F.sum("_n").over(within))
    counted = counted.withColumn("_before", F.col("_upto") - F.col("_n"))
    place = (F.col("_total") - 1) * F.col("prob")

    def at(rank):
        """The value of a rank: any inside the bracket, the greatest of those below it, the smallest of those above."""
        known = (F.col("_zone") == 1) | ((F.col("_zone") == 0) & (rank == F.col("_upto") - 1)) | ((F.col("_zone") == 2) & (rank == F.col("_before")))
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_upto")) & known, F.col("_v")))

    found = counted.groupBy(*by).agg(
        at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_z"), F.max(place - F.floor(place)).alias("_f")
    )
    exact = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")
    return found.select(*by, exact.alias("quantile"))


def _fences(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    cuts = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    found = quantiles(df, value, list(cuts.values()), keys)
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(name) for name, p in cuts.items()]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return wide.withColumn("_low", F.col("q1") - reach).withColumn("_high", F.col("q3") + reach)


_FENCE_COLUMNS = ["q1", "median", "q3", "_low", "_high"]


def box_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Box plot as numbers. Whiskers end at the outermost values within 1.5 interquartile ranges."""
    v = F.col(value).cast("double")
    placed = _beside(df, _fences(df, value, keys), keys, _FENCE_COLUMNS, "fences")
    regular = v.between(F.col("_low"), F.col("_high"))
    return (
        placed.filter(v.isNotNull())
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.count("*").alias("rows"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            F.min(F.when(regular, v)).alias("whisker_low"),
            F.max(F.when(regular, v)).alias("whisker_high"),
            F.count_if(~regular).alias("outliers"),
        )
    )


def outliers(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """The rows beyond the whiskers."""
    placed = _beside(df, _fences(df, value, keys), keys, _FENCE_COLUMNS, "fences")
    v = F.col(value).cast("double")
    return placed.filter(~v.between(F.col("_low"), F.col("_high"))).select(*df.columns)


def clip_at_quantile(df: DataFrame, value: str, prob: float = 0.75, factor: float = 1.0) -> DataFrame:
    """Rows whose value is at most ``factor`` times the value's own quantile."""
    limit = quantiles(df, value, [prob]).select((F.col("quantile") * factor).alias("limit")).scalar()
    return df.filter(F.col(value) <= limit)
