"""Fill dates, word counts and country names of rows that still lack them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import parse_datetime, standard_datetime
from ..functions.text import word_count
from .common import fill_pending


def format_datetimes(df: DataFrame, column: str = "datetime", formatted: str = "formatted", **options) -> DataFrame:
    """Raw datetime text to a timestamp and its date; ``formatted`` tells where that worked.

    Rows whose ``formatted`` says they are done hold the standard format and are not parsed again: a text
    of digits in them is no epoch.
    """
    parsed = parse_datetime(F.col(column), **options)
    if formatted in df.columns:
        parsed = F.when(F.col(formatted), standard_datetime(column)).otherwise(parsed)
    return (
        df.withColumn(column, parsed)
        .withColumn("date", F.to_date(column))
        .withColumn(formatted, F.col(column).isNotNull())
    )


def datetime_rejects(df: DataFrame, column: str = "datetime", **options) -> DataFrame:
    """The rows whose datetime text no layout can read, unchanged."""
    return df.filter(F.col(column).isNotNull() & parse_datetime(F.col(column), **options).isNull())


def count_words(df: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """Word counts for the rows that have none yet."""
    counted = word_count(text).cast("int")
    return fill_pending(df, out, counted) if out in df.columns else df.withColumn(out, counted)


def country_names(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Name and numeric id from the two-letter code, for rows without a name; unknown codes stay NULL.

    ``countries`` has one row per ``alpha_2``. The join is a plain left join: Spark
    broadcasts the table while it is small and shuffles it otherwise.
    """
    lookup = countries.select(
        F.upper("alpha_2").alias("_code"), F.col("name").alias("_name"), F.col("numeric").alias("_id")
    )
    pending = F.col("country_name").isNull()
    code = F.when(pending, F.upper("country_code"))
    joined = df.join(lookup, code == F.col("_code"), "left")
    return joined.select(
        *[
            F.coalesce(F.col("country_name"), F.col("_name")).alias(c)
            if c == "country_name"
            else F.when(pending & F.col("_code").isNotNull(), F.col("_id")).otherwise(F.col(c)).alias(c)
            if c == "country_id"
            else F.col(c)
            for c in df.columns
        ]
    )
