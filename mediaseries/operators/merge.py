"""Fold many source tables into one, filling gaps of known rows (first value wins)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import none_to_null, parse_text, strip_quotes
from .common import align

_RANK, _ORDER, _LONE = "_rank", "_order", "_lone"


def clean_strings(df: DataFrame, trim: bool = False, none_is_missing: Sequence[str] = ()) -> DataFrame:
    """Every string column without double quotes (and, if asked, outer blanks).

    In the columns ``none_is_missing`` names, the text ``None`` becomes NULL, as older tables mean it.
    """
    clean = parse_text if trim else strip_quotes
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}

    def one(c: str) -> Column:
        if c not in strings:
            return F.col(c)
        return (none_to_null(clean(c)) if c in none_is_missing else clean(c)).alias(c)

    return df.select(*[one(c) for c in df.columns])


def stack_sources(
    sources: Sequence[DataFrame],
    key: str,
    schema: T.StructType,
    order: Sequence[str],
    trim: bool = False,
    none_is_missing: bool | Sequence[bool] = True,
) -> DataFrame:
    """All sources under one schema, each row with its source's rank (the master is 0) and its place there.

    ``order`` names columns of every source that put its rows in first-seen order. ``none_is_missing`` says of all
    sources, or of each, whether the text ``None`` is a missing value; it never is one in the key.
    """
    place = T.StructField(_ORDER, T.StructType([T.StructField(c, sources[0].schema[c].dataType) for c in order]))
    wanted = T.StructType([*schema.fields, place])
    rules = [none_is_missing] * len(sources) if isinstance(none_is_missing, bool) else none_is_missing
    stacked = None
    for rank, (source, rule) in enumerate(zip(sources, rules, strict=True)):
        placed = source.withColumn(_ORDER, F.struct(*order))
        placed = clean_strings(placed, trim, [c for c in source.columns if c != key] if rule else [])
        part = align(placed, wanted).withColumn(_RANK, F.lit(rank))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def merge_upsert(
    sources: Sequence[DataFrame],
    key: str,
    schema: T.StructType,
    order: Sequence[str],
    blank_is_missing: bool = False,
    trim: bool = False,
    none_is_missing: bool | Sequence[bool] = True,
) -> DataFrame:
    """One row per key; each column holds its first value in (source, row) order that is not missing.

    All sources are scanned once and folded in one pass: a single shuffle on the key, behind
    map-side combining, so copies of one text, however many, are reduced where
    they are read. A hash in front of the key makes comparing long texts cheap; equality stays exact. With
    ``blank_is_missing`` an empty string yields to any later value. Rows without a key
    match nothing and stay as they are: each is a group of its own, by a salt that no other row has.
    """
    stacked = stack_sources(sources, key, schema, order, trim, none_is_missing)
    strings = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}

    def first(c: str) -> Column:
        late = [(F.col(c) == "").alias("blank")] if blank_is_missing and c in strings else []
        return F.min(F.when(F.col(c).isNotNull(), F.struct(*late, _RANK, _ORDER, F.col(c).alias("value"))))["value"].alias(c)

    lone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    salted = stacked.withColumn(_LONE, lone).groupBy(F.xxhash64(key).alias("_hash"), F.col(key), F.col(_LONE))
    return salted.agg(*[first(f.name) for f in schema.fields if f.name != key]).select(*schema.names)


def fill_gaps(older: Column, newer: Column, blank_is_missing: bool = False) -> Column:
    """The older value, or the newer one where it is missing. With ``blank_is_missing`` an empty string yields to a later text."""
    if not blank_is_missing:
        return F.coalesce(older, newer)
    return F.coalesce(F.nullif(older, F.lit("")), F.nullif(newer, F.lit("")), older, newer)


def merge_report(
    sources: Sequence[DataFrame], key: str, schema: T.StructType, order: Sequence[str], trim: bool = False
) -> DataFrame:
    """Rows of each source that opened a new key, and rows that met a known one. A row without a key opens one."""
    stacked = stack_sources(sources, key, T.StructType([schema[key]]), order, trim)
    ranks = range(len(sources))

    def rows_of(r: int) -> Column:
        return F.count_if(F.col(_RANK) == r).alias(f"rows{r}")

    keyed = stacked.filter(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("_hash"), F.col(key))
    per_key = keyed.agg(F.min(_RANK).alias("opener"), *[rows_of(r) for r in ranks])
    opened = [F.count_if(F.col("opener") == r).alias(f"new{r}") for r in ranks]
    known = per_key.agg(*[F.sum(f"rows{r}").alias(f"rows{r}") for r in ranks], *opened)
    lone = stacked.filter(F.col(key).isNull()).agg(*[rows_of(r) for r in ranks])
    both = known.unionByName(lone.select("*", *[F.col(f"rows{r}").alias(f"new{r}") for r in ranks]))
    sums = both.agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in both.columns])
    lines = F.array(
        *[
            F.struct(
                F.lit(r).alias("source"),
                F.col(f"new{r}").alias("inserted"),
                (F.col(f"rows{r}") - F.col(f"new{r}")).alias("updated"),
            )
            for r in ranks
        ]
    )
    return sums.select(F.inline(lines))
