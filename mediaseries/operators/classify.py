"""Sentiment of texts: clean, split, score, decide.

The whole way from text to verdict is a narrow map: sentences and scores stay in
arrays of their own row, so classifying shuffles nothing and a huge or repeated
text is never gathered anywhere. Scorers over tables are offered beside it.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import NEGATIVE, NEUTRAL, POSITIVE
from ..functions.text import clean_html, letters_only_words, split_sentences
from ..session import stage
from .common import broadcast_limit, size_in_bytes

SCORES = "array<struct<label:string,conf:double>>"

Scorer = Callable[[Column], Column]
Model = Callable[[list[str]], Sequence[tuple[str, float] | None]]


def lexicon_scorer(positive: Sequence[str], negative: Sequence[str]) -> Scorer:
    """Scores sentences by counting words of two lists, in the JVM.

    Label by the majority, confidence |p - n| / (p + n); a sentence with a draw or
    without any listed word gets no label. The lists travel in the plan as a hash set;
    lexicons kept in tables go through ``score_with_lexicon_table``.
    """

    def score(sentences: Column) -> Column:
        def hits(words: Column, listed: Sequence[str]) -> Column:
            return F.size(F.filter(words, lambda w: w.isin(list(listed))))

        worded = F.transform(sentences, letters_only_words)
        counts = F.transform(worded, lambda ws: F.struct(hits(ws, positive).alias("p"), hits(ws, negative).alias("n")))
        counted = F.filter(counts, lambda s: s["p"] != s["n"])
        return F.transform(
            counted,
            lambda s: F.struct(
                F.when(s["p"] > s["n"], POSITIVE).otherwise(NEGATIVE).alias("label"),
                (F.abs(s["p"] - s["n"]) / (s["p"] + s["n"])).alias("conf"),
            ),
        )

    return score


def model_scorer(load: Callable[[], Model], mini_batch: int = 500) -> Scorer:
    """Scores sentences with any model. ``load`` runs once per Python worker process, however many tasks it works on.

    The model maps a list of sentences to (label, confidence) pairs, None for no label.
    """
    token = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # This function is unpickled for every task; a module of the process's own table of modules outlives it.
        kept = sys.modules.setdefault("mediaseries_loaded_models", types.ModuleType("mediaseries_loaded_models")).__dict__
        if token not in kept:
            kept[token] = load()
        model = kept[token]
        for rows in batches:
            flat = [s for row in rows if row is not None for s in row]
            scored = []
            for at in range(0, len(flat), mini_batch):
                scored.extend(model(flat[at : at + mini_batch]))
            results = iter(scored)
            out = []
            for row in rows:
                if row is None:
                    out.append(None)
                    continue
                got = [next(results) for _ in row]
                out.append([{"label": r[0], "conf": float(r[1])} for r in got if r is not None])
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, SCORES)


def verdict(scores: Column) -> Column:
    """Struct with ``label`` and ``conf`` of a text: the label with the highest mean confidence, the first seen on a draw.

    Means are compared at 12 decimals. No scored sentence means NEUTRAL with 0.
    """

    def mean(label: Column) -> Column:
        own = F.filter(scores, lambda s: s["label"] == label)
        total = F.aggregate(own, F.lit(0.0), lambda acc, s: acc + s["conf"])
        return F.round(total / F.size(own), 12)

    labels = F.array_distinct(F.transform(scores, lambda s: s["label"]))
    ranked = F.transform(
        labels, lambda name, k: F.struct(mean(name).alias("conf"), (-k).alias("first"), name.alias("label"))
    )
    neutral = F.struct(F.lit(0.0).alias("conf"), F.lit(0).alias("first"), F.lit(NEUTRAL).alias("label"))
    return F.coalesce(F.array_max(ranked), neutral)


def classify(df: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """Fill ``label`` and ``conf`` of the rows without a confidence.

    Empty and missing texts stay unclassified; a text that cleans to nothing, or
    of which no sentence can be scored, is NEUTRAL with 0. Finished rows are kept.
    """
    for name, kind in (("label", "string"), ("conf", "double")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    todo = F.col("conf").isNull() & (F.col(text) != "")
    sentences = F.when(todo, split_sentences(clean_html(text)))
    scored = df.withColumn("_scores", scorer(sentences))
    decided = scored.withColumn("_verdict", F.when(todo, verdict(F.col("_scores"))))
    return decided.withColumns(
        {
            "label": F.when(todo, F.col("_verdict.label")).otherwise(F.col("label")),
            "conf": F.when(todo, F.col("_verdict.conf")).otherwise(F.col("conf")),
        }
    ).drop("_scores", "_verdict")


def sentence_rows(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """One row per sentence: id, position in its text, sentence."""
    sentences = split_sentences(clean_html(text))
    return df.select(id_column, F.posexplode(sentences).alias("pos", "sentence"))


def score_sentence_rows(sentences: DataFrame, scorer: Scorer) -> DataFrame:
    """Label and confidence of each sentence row; sentences without a label are left out."""
    scored = sentences.withColumn("_s", scorer(F.array("sentence")))
    keep = [c for c in sentences.columns if c != "sentence"]
    return scored.select(*keep, F.inline("_s"))


def weigh_words(words: DataFrame, lexicon: DataFrame, id_column: str) -> DataFrame:
    """The words (id, pos, word) that a staged lexicon holds, with its columns and ``times``, how often they stand in their sentence.

    A lexicon that Spark broadcasts meets each word where it lies (a row each, ``times`` 1), and only words that it holds go
    on. Words that have to be shuffled for a larger one are counted first, so each travels once per sentence.
    """
    if size_in_bytes(lexicon) <= broadcast_limit(words.sparkSession):
        return words.join(lexicon, "word").withColumn("times", F.lit(1))
    return words.groupBy(id_column, "pos", "word").agg(F.count("*").alias("times")).join(lexicon, "word")


def score_with_lexicon_table(sentences: DataFrame, lexicon: DataFrame, id_column: str) -> DataFrame:
    """Scores sentence rows against a table (word, weight) of any length, weights being 1 or -1.

    The lexicon is staged, so that Spark knows its size and chooses by it how to move it; AQE splits the words that are
    hot in a shuffle.
    """
    words = sentences.select(id_column, "pos", F.explode(letters_only_words("sentence")).alias("word"))
    weight, times = F.col("weight"), F.col("times")
    return (
        weigh_words(words, stage(lexicon, "lexicon"), id_column)
        .groupBy(id_column, "pos")
        .agg(F.sum(F.when(weight > 0, times).otherwise(0)).alias("p"), F.sum(F.when(weight < 0, times).otherwise(0)).alias("n"))
        .filter(F.col("p") != F.col("n"))
        .select(
            id_column,
            "pos",
            F.when(F.col("p") > F.col("n"), POSITIVE).otherwise(NEGATIVE).alias("label"),
            (F.abs(F.col("p") - F.col("n")) / (F.col("p") + F.col("n"))).alias("conf"),
        )
    )


def text_verdicts(scores: DataFrame, id_column: str) -> DataFrame:
    """Verdict per text from scored sentence rows (id, pos, label, conf).

    Two combining aggregates: sentences of a text may lie anywhere and be any number.
    """
    means = scores.groupBy(id_column, "label").agg(F.avg("conf").alias("conf"), F.min("pos").alias("first"))
    rank = F.struct(F.round("conf", 12).alias("conf"), (-F.col("first")).alias("first"), F.col("label").alias("label"))
    best = means.groupBy(id_column).agg(F.max(rank).alias("best"))
    return best.select(id_column, F.col("best.label").alias("label"), F.col("best.conf").alias("conf"))


def apply_verdicts(df: DataFrame, verdicts: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """Put verdicts on texts: NEUTRAL with 0 where a text has none, nothing where there is no text.

    Whether there is a text is asked before the join, so texts that are not selected afterwards do not travel.
    """
    usable = F.col("_usable")
    joined = df.withColumn("_usable", F.col(text) != "").join(verdicts.select(id_column, F.col("label").alias("_l"), F.col("conf").alias("_c")), id_column, "left")
    return joined.withColumns(
        {
            "label": F.when(usable, F.coalesce(F.col("_l"), F.lit(NEUTRAL))),
            "conf": F.when(usable, F.coalesce(F.col("_c"), F.lit(0.0))),
        }
    ).drop("_l", "_c", "_usable")
