"""A corpus from raw documents to a mixed training set, one operator of ``mediaseries.llm`` after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaseries.llm import queries
from mediaseries.llm.bagminhash import near_duplicates
from mediaseries.llm.decontamination import remove_contamination
from mediaseries.llm.mixing import mix_sources
from mediaseries.llm.suffix_dedup import remove_repeats
from mediaseries.llm.toxicity import learn, score
from mediaseries.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.7. The lexicon is learned from the labelled ones among them."""
    model = learn(docs, queries.table(spark, sf_dir, "labels").where(~queries.held_out()))
    return score(docs, model, COLUMNS).where("score < 0.7").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest number.

    A document is an id with a text: rows alike in both are one, of which the smallest by its other columns stays. Its number is the id;
    further texts of an id, and texts without an id, have numbers from 2^62 on, made from both.
    """
    row, low = "__row", "__low"  # no names of documents, whose columns are COLUMNS
    docs, text = docs.select(*COLUMNS), F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.groupBy(F.col("doc_id").alias("__id")).agg(F.min(text).alias(low), F.max(text).alias("__high"))
    several = stage(texts.where(f"__id IS NOT NULL AND {low} < __high").select("__id", low), "several-texts")
    own = F.col("doc_id").isNotNull() & (F.col(low).isNull() | (F.col(low) == text))
    number = F.when(own, F.col("doc_id")).otherwise(F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 62)) + (1 << 62))
    numbered = docs.join(several, F.col("doc_id") == F.col("__id"), "left").select(*COLUMNS, number.alias(row))
    found = stage(near_duplicates(numbered, row), "near-duplicates")
    dropped = stage(found.where("id <> class_id").select("id").distinct(), "dropped")  # its true size tells whether texts have to move
    left = numbered.join(dropped, F.col(row) == F.col("id"), "left_anti")
    again = stage(found.where("id = class_id").groupBy("id").count().where("count > 1").select("id"), "repeated-rows")
    if again.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(again, F.col(row) == F.col("id"), "left_anti").select(*COLUMNS)
    more = left.join(again, F.col(row) == F.col("id"), "left_semi").groupBy(row).agg(F.min(F.struct(*COLUMNS)).alias("first"))
    return once.unionByName(more.select("first.*"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings of 100 bytes that stand earlier too; those of which nothing is left go."""
    return remove_repeats(docs.select(*COLUMNS)).withColumns({"n_chars": queries.n_chars()})


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that stand in windows of the benchmark."""
    clean = remove_contamination(docs.select(*COLUMNS), queries.table(spark, sf_dir, "benchmark"))
    return clean.withColumns({"n_chars": queries.n_chars()})


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mix in which every source weighs the same, in a global random order."""
    return mix_sources(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The learned lexicon and the signatures are no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
