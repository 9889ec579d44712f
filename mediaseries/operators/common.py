"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage


def attach(df: DataFrame, summary: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Put the one ``summary`` row of a key beside each row of ``df``.

    Keyed: an equi-join, whose small side AQE may broadcast after measuring it.
    Without keys: a scalar subquery, so no join at all. Keys hold no NULL.
    """
    if keys:
        return df.join(summary.select(*keys, *columns), list(keys))
    row = summary.select(F.struct(*columns).alias("s")).scalar()
    return df.withColumns({c: row[c] for c in columns})


def align(df: DataFrame, schema) -> DataFrame:
    """The columns of ``schema`` in its order: known ones cast, missing ones NULL, others left out."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def size_in_bytes(df: DataFrame) -> int:
    """What Spark takes a frame's size to be; of a staged table, its files tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's own bound of broadcasts in bytes, -1 if it broadcasts nothing."""
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(bound)) if bound != "-1" else -1


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int | None = None) -> DataFrame:
    """The first row of each group by ``order``, NULLs first; of rows alike in it the smallest by their other columns, taken in turn.

    The smallest order of each group is found first, without the other columns, and staged. Where that table is no larger than ``limit`` bytes
    (Spark's own bound of broadcasts unless given), it meets the rows where they lie, and only rows that are first go
    on, to settle ties. Beyond it each task reduces its rows to one per group before any is
    moved. Either way no more than a row per group and task is shuffled. Columns must be of types that can be sorted.
    """
    rest = [c for c in df.columns if c not in by and c not in order]
    least = stage(df.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first")), "first-orders")
    if limit is None:
        limit = broadcast_limit(df.sparkSession)
    if size_in_bytes(least) <= limit:
        others = least.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *[F.col(f"_first.{c}").alias(f"_order{k}") for k, c in enumerate(order)])
        same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]
        same += [F.col(c).eqNullSafe(F.col(f"_order{k}")) for k, c in enumerate(order)]
        df = df.join(F.broadcast(others), same, "left_semi").select(*df.columns)
        if not rest:
            return df.distinct()
    first = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*by).agg(first).select(*[F.col(c) if c in by else F.col(f"_first.{c}") for c in df.columns])


def pending_counts(df: DataFrame, column: str) -> DataFrame:
    """How many rows there are, how many still wait for a value in ``column``, how many have one."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(column).isNull()).alias("pending"),
        F.count(column).alias("done"),
    )


def fill_pending(df: DataFrame, column: str, value) -> DataFrame:
    """Compute ``column`` only where it is still NULL; finished rows keep what they have."""
    return df.withColumn(column, F.when(F.col(column).isNull(), value).otherwise(F.col(column)))
