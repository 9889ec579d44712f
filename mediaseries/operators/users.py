"""Metrics per user.

Posts are reduced by hash aggregation on their own executors first; the one
aggregate that has to sort (the smallest full name) sees a user's distinct texts, not posts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .stats import clip_at_quantile


def _per_user(partial: DataFrame, **metrics: Column) -> DataFrame:
    return partial.groupBy("username").agg(
        F.min("full_name").alias("full_name"), *[c.alias(name) for name, c in metrics.items()]
    )


def _by_text(posts: DataFrame, **sums: Column) -> DataFrame:
    """Posts reduced to (username, full_name, text), spread by all three; a text travels as its SHA-256 digest."""
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key")
    return posts.groupBy("username", "full_name", digest).agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in sums.items()])


def user_retweets(posts: DataFrame) -> DataFrame:
    """Sum of retweets per user."""
    partial = posts.groupBy("username", "full_name").agg(F.sum("retweets").alias("retweets"))
    return _per_user(partial, retweets=F.sum("retweets"))


def user_tweets(posts: DataFrame) -> DataFrame:
    """Number of distinct texts per user."""
    return _per_user(_by_text(posts), tweets=F.count_distinct("key"))


def user_words(posts: DataFrame) -> DataFrame:
    """Mean number of words per user, posts without a count left out."""
    partial = posts.groupBy("username", "full_name").agg(
        F.sum("words").alias("_words"), F.count("words").alias("_counted")
    )
    return _per_user(partial, words_avg=F.try_divide(F.sum("_words").cast("double"), F.sum("_counted")))


def user_metrics(posts: DataFrame) -> DataFrame:
    """All three metrics per user from one scan: distinct texts need one shuffle, and the sums travel with them."""
    partial = _by_text(posts, retweets=F.sum("retweets"), _words=F.sum("words"), _counted=F.count("words"))
    return _per_user(
        partial,
        tweets=F.count_distinct("key"),
        retweets=F.sum("retweets").cast("long"),
        words_avg=F.try_divide(F.sum("_words").cast("double"), F.sum("_counted")),
    )


def named_users(df: DataFrame) -> DataFrame:
    """Leaves out the group of posts without a username."""
    return df.filter(F.col("username").isNotNull())


def ranked(df: DataFrame, metric: str, k: int | None = None) -> DataFrame:
    """Users by a metric, highest first; ``k`` makes it a top-k report."""
    out = df.orderBy(F.col(metric).desc_nulls_last(), F.col("username").asc_nulls_first())
    return out if k is None else out.limit(k)


def join_user_metrics(tweets: DataFrame, retweets: DataFrame, words: DataFrame) -> DataFrame:
    """The three per-user tables on (username, full_name); missing names match each other."""

    def beside(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
        other = right.select(F.col("username").alias("_u"), F.col("full_name").alias("_f"), column)
        same = F.col("username").eqNullSafe(F.col("_u")) & F.col("full_name").eqNullSafe(F.col("_f"))
        return left.join(other, same).drop("_u", "_f")

    return beside(beside(tweets, retweets, "retweets"), words, "words_avg")


def short_text_users(metrics: DataFrame, factor: float = 1.5) -> DataFrame:
    """Users whose mean length is at most ``factor`` times its third quartile."""
    return clip_at_quantile(metrics, "words_avg", 0.75, factor)


def plot_area(metrics: DataFrame, tweets=(0, 5000), retweets=(0, 16000)) -> DataFrame:
    """Users inside the drawn area."""
    return metrics.filter(F.col("tweets").between(*tweets) & F.col("retweets").between(*retweets))


def long_metric(df: DataFrame, metric: str) -> DataFrame:
    """One row per user and way of drawing it (with and without outliers)."""
    value = F.col(metric)
    return df.select(value.alias("outliers"), value.alias("no outliers")).unpivot(
        [], ["outliers", "no outliers"], "viz", metric
    )


def metric_rows(tweets: DataFrame, retweets: DataFrame, words: DataFrame) -> DataFrame:
    """(metric, value) rows for box plots; mean lengths are cut to whole words."""
    parts = [
        named_users(tweets).select(F.lit("tweets").alias("metric"), F.col("tweets").cast("double").alias("value")),
        named_users(retweets).select(F.lit("retweets").alias("metric"), F.col("retweets").cast("double").alias("value")),
        words.select(F.lit("words_avg").alias("metric"), F.col("words_avg").cast("int").cast("double").alias("value")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
