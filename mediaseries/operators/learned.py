"""What is learned from the corpus itself by counting: sentiment weights of words, abbreviations, the order of day and month.

All of it is aggregates with map-side combine, of any number of rows; what comes out are tables, which meet the rows by
joins without hints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import DAY_FIRST, DAY_MONTH, parse_datetime
from ..functions.scores import NEGATIVE, POSITIVE
from ..functions.text import letters_only_words
from ..session import stage
from .classify import sentence_rows, weigh_words

#: A word counts if its log odds are so many standard errors away from even.
SIGNIFICANT = 3.0
#: The word of a lexicon that stands in every sentence: its weight is what a sentence without known words leans to.
ALWAYS = ""


def learn_weights(texts: DataFrame, positive: Column, text: str = "text", errors: float = SIGNIFICANT) -> DataFrame:
    """A linear classifier of texts: word, weight, with a row for ``ALWAYS``.

    ``positive`` is true, false, or NULL for texts without a label, which are left out. A word's weight is the log of the ratio of its odds
    in positive and in negative texts, each text counted once, a half added to every count; words whose
    weight is within ``errors`` standard errors of zero tell nothing and are left out. Weights are fixed at 12
    decimals. Every labelled text is counted, no sample is taken. Where one of the two labels has no text, there is only ``ALWAYS``.
    """
    told = texts.select(F.array_distinct(letters_only_words(text)).alias("words"), positive.alias("p")).where(F.col("p").isNotNull())
    totals = told.agg(F.count_if("p").alias("all_p"), F.count_if(~F.col("p")).alias("all_n"))
    every = totals.select(F.struct("all_p", "all_n").alias("s")).scalar()
    counts = told.select(F.explode("words").alias("word"), "p").groupBy("word")
    counts = counts.agg(F.count_if("p").alias("p"), F.count_if(~F.col("p")).alias("n"))
    cells = [F.col("p") + 0.5, every["all_p"] - F.col("p") + 0.5, F.col("n") + 0.5, every["all_n"] - F.col("n") + 0.5]
    weight = F.ln(cells[0]) - F.ln(cells[1]) - F.ln(cells[2]) + F.ln(cells[3])
    error = F.sqrt(1 / cells[0] + 1 / cells[1] + 1 / cells[2] + 1 / cells[3])
    both = (every["all_p"] > 0) & (every["all_n"] > 0)
    words = counts.where(both).select("word", F.round(weight, 12).alias("weight"), error.alias("error"))
    words = words.where(F.abs("weight") >= F.round(F.lit(errors) * F.col("error"), 12)).select("word", "weight")
    leaning = totals.select(F.lit(ALWAYS).alias("word"), F.round(F.ln(F.col("all_p") + 0.5) - F.ln(F.col("all_n") + 0.5), 12).alias("weight"))
    return words.unionByName(leaning)


def score_with_weights(sentences: DataFrame, weights: DataFrame, id_column: str) -> DataFrame:
    """Label and confidence of sentence rows (id, pos, sentence) by a table of ``learn_weights``.

    A sentence's score is the sum of the weights of its words, each occurrence counted; the label is its sign, the confidence the
    hyperbolic tangent of half its size: 0 for even odds, towards 1. A score of zero is no label. Stage the weights, so that
    their size decides how words meet them (``classify.weigh_words``).
    """
    words = sentences.select(id_column, "pos", F.explode(F.array_append(letters_only_words("sentence"), F.lit(ALWAYS))).alias("word"))
    score = F.round(F.sum(F.col("weight") * F.col("times")), 9).alias("score")
    summed = weigh_words(words, weights, id_column).groupBy(id_column, "pos").agg(score).where("score <> 0")
    return summed.select(
        id_column,
        "pos",
        F.when(F.col("score") > 0, POSITIVE).otherwise(NEGATIVE).alias("label"),
        F.tanh(F.abs("score") / 2).alias("conf"),
    )


# --- abbreviations

#: A word with its inner full stops, and the one behind it if there is one.
_TOKEN = r"\p{L}+(?:\.\p{L}+)*\.?"
_LAST = r"(\p{L}+(?:\.\p{L}+)*)\.$"
#: A word is an abbreviation from this score on.
LEAST = 0.3


def learn_abbreviations(texts: DataFrame, text: str = "text", least: float = LEAST) -> DataFrame:
    """word, score of the words (lower case, without their last full stop) that the corpus writes as abbreviations.

    A word and the full stop behind it are taken as a collocation (Kiss and Strunk 2006): the score is Dunning's log-likelihood ratio of the
    full stop always following against following as it does any word, times e^-letters, times inner full stops + 1, times letters^-(times
    without a full stop). Counts are over all texts.
    """
    tokens = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))).alias("token"))
    word = F.regexp_replace("token", r"\.$", "").alias("word")
    counts = tokens.groupBy(word).agg(F.count("*").alias("n"), F.count_if(F.endswith("token", F.lit("."))).alias("stops"))
    counts = stage(counts, "stop-counts")
    row = counts.agg(F.sum("n").alias("n"), F.sum("stops").alias("stops")).select(F.struct("n", "stops").alias("s")).scalar()
    usual = row["stops"] / row["n"]
    with_, without = F.col("stops"), F.col("n") - F.col("stops")
    ratio = with_ * (F.ln(F.lit(0.99)) - F.ln(usual)) + without * (F.ln(F.lit(0.01)) - F.ln(1 - usual))
    letters, inner = F.length(F.replace("word", F.lit("."))), F.regexp_count("word", F.lit(r"\."))
    score = 2 * ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -without)
    scored = counts.where((usual > 0) & (usual < 1) & (with_ > 0)).select("word", F.round(score, 9).alias("score"))
    return scored.where(F.col("score") >= least)


def whole_sentences(df: DataFrame, id_column: str, abbreviations: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence (id, pos, sentence), where a full stop behind an abbreviation ends none.

    Texts are split at every mark first; a part that ends with an abbreviation goes on with the next part, a blank between
    them. Ids are distinct. A sentence that ends its text ends whatever its last word is.
    """
    parts = sentence_rows(df, id_column, text).withColumn("_last", F.lower(F.regexp_extract("sentence", _LAST, 1)))
    marked = parts.join(abbreviations.select(F.col("word").alias("_last"), F.lit(1).alias("_open")), "_last", "left")
    begins = F.array_sort(F.collect_list(F.struct("pos", "sentence", F.coalesce("_open", F.lit(0)).alias("open"))))
    texts = marked.groupBy(id_column).agg(begins.alias("parts"))
    # A part opens a sentence unless the one before it is open; what it opens reaches up to the next that opens one.
    opens = F.expr("filter(sequence(1, size(parts)), k -> k = 1 or parts[k - 2].open = 0)")
    spans = F.expr("transform(opens, (k, i) -> slice(parts, k, coalesce(get(opens, i + 1), size(parts) + 1) - k))")
    joined = F.expr("transform(spans, s -> array_join(transform(s, p -> p.sentence), ' '))")
    found = texts.withColumn("opens", opens).withColumn("spans", spans).select(id_column, F.posexplode(joined).alias("pos", "sentence"))
    return found


# --- the order of day and month


def learn_day_order(df: DataFrame, source: str, column: str = "datetime") -> DataFrame:
    """Per source: day_first, and the votes for each order.

    Texts of two numbers and a year vote where one number is beyond 12. Most votes decide; without any, or with a draw, the
    month is first. Rows without a source are a source of their own.
    """
    first = F.regexp_extract(column, DAY_MONTH, 1).try_cast("int")
    second = F.regexp_extract(column, DAY_MONTH, 2).try_cast("int")
    votes = df.groupBy(source).agg(
        F.count_if((first > 12) & second.between(1, 12)).alias("day_votes"), F.count_if(first.between(1, 12) & (second > 12)).alias("month_votes")
    )
    return votes.withColumn("day_first", F.col("day_votes") > F.col("month_votes"))


def format_by_source(df: DataFrame, source: str, column: str = "datetime") -> DataFrame:
    """``column`` to a timestamp, with its date and whether that worked, where 03/04/2020 is read as its source writes it.

    A text that its source's order cannot be (13/01 of a source that puts the month first) is read in the other one.
    """
    order = stage(learn_day_order(df, source, column), "day-order").select(F.col(source).alias("_source"), "day_first")
    told = df.join(order, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    as_month, as_day = parse_datetime(column), parse_datetime(column, DAY_FIRST)
    read = F.when(F.col("day_first"), F.coalesce(as_day, as_month)).otherwise(F.coalesce(as_month, as_day))
    return told.withColumn(column, read).withColumn("date", F.to_date(column)).withColumn("formatted", F.col(column).isNotNull()).drop("day_first")
