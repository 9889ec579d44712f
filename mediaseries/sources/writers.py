"""Writers. A table is not changed in place: a new version, more files, or whole partitions anew."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import hadoop_path, stage

#: The column that tells the batches of a table apart.
BATCH = "batch"
#: Tasks that share a partition when it is written anew.
SPREAD = 8

#: Texts keep the blanks at their ends.
_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def append_rows(df: DataFrame, path: str) -> None:
    """More rows; a repeated call has them twice. ``append_batch`` can be repeated."""
    df.write.mode("append").parquet(path)


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """The rows of a batch that has a name: one partition of the table, which a repeated call replaces as a whole.

    Names are letters, digits, dots, hyphens and underscores. Rows may not have a column "batch". A batch may be empty, also where it
    had rows before. Other batches are left as they lie, so several may be written at once. The new files are written beside the old
    ones and take their place at the end, so a call that fails before leaves the batch as it was.
    """
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"{batch!r} is no name of a batch")
    if BATCH in df.columns:
        raise ValueError(f"rows have a column {BATCH!r}")
    spark = df.sparkSession
    store, place = hadoop_path(spark, f"{path}/{BATCH}={batch}")
    beside = hadoop_path(spark, f"{path}/_writing-{batch}")[1]  # readers pass over names with an underscore in front
    df.write.mode("overwrite").parquet(beside.toString())
    store.delete(place, True)
    if not store.rename(beside, place):
        raise OSError(f"{beside} cannot take the place of {place}")


def rewrite_pending(
    spark: SparkSession, path: str, partitions: Sequence[str], pending: Column, fill: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Compute what is missing in a partitioned table, and write only the partitions that hold such rows.

    ``pending`` says which rows wait, ``fill`` takes all rows of the partitions that hold one and gives them back, finished
    and with the same columns. Returns the partitions that were written, with the number of rows that waited in each. Of other
    partitions only the columns ``pending`` needs are read, and their files stay. A NULL among partition values is a partition like others.

    The rewritten rows are staged in the shared folder before any file goes, so that they never depend on files that are being
    replaced. Partitions are replaced when the job commits.
    """
    rows = spark.read.parquet(path)
    counts = stage(rows.groupBy(*partitions).agg(F.count_if(pending).alias("waiting")), "pending-partitions")
    written = counts.where("waiting > 0")
    others = written.select(*[F.col(p).alias(f"_{k}") for k, p in enumerate(partitions)])
    whole = F.lit(True)
    for p in partitions:
        whole = whole & F.col(p).isNotNull()
    # Equality lets the scan leave partitions out while it runs; those with a NULL are few, and filtered by it.
    held = rows.where(whole).join(others, [F.col(p) == F.col(f"_{k}") for k, p in enumerate(partitions)], "left_semi")
    odd = rows.where(~whole).join(others, [F.col(p).eqNullSafe(F.col(f"_{k}")) for k, p in enumerate(partitions)], "left_semi")
    finished = fill(held.unionByName(odd))
    if sorted(finished.columns) != sorted(rows.columns):
        raise ValueError(f"columns {finished.columns} are not those of the table, {rows.columns}")
    finished = stage(finished.select(*rows.columns), "pending-finished")
    by_partition = finished.repartition(*partitions, F.pmod(F.xxhash64(*finished.columns), F.lit(SPREAD)))
    by_partition.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
    return written


def write_version(df: DataFrame, path: str) -> None:
    """A finished table under a path of its own; an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows without a header line."""
    df.write.mode("append").option("header", False).options(**_BLANKS).csv(path)


def export_view(df: DataFrame, name: str, path: str) -> None:
    """Register a named view and write what it holds as CSV with a header. CSV reads empty texts back as NULL."""
    df.createOrReplaceTempView(name)
    df.sparkSession.table(name).write.option("header", True).options(**_BLANKS).csv(path)


def write_chart_data(df: DataFrame, path: str) -> None:
    """The rows behind a chart, one JSON object per line."""
    df.write.json(path)
