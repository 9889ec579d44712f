import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaseries.operators import stats, users


def test_quantiles_through_brackets(spark):
    """Large keys, most of one key one value: brackets, not whole ordering, and still exact."""
    rng = np.random.default_rng(4)
    rows = [("hot", 5.0)] * 4000 + [("hot", float(v)) for v in rng.normal(0, 50, 4000)]
    rows += [("even", float(v)) for v in rng.random(5000)] + [("few", 1.0), ("few", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r.k, r.prob): r.quantile for r in stats.quantiles(df, "v", probs, ["k"], accuracy=100).collect()}
    assert len(got) == 3 * len(probs)
    for key in ("hot", "even", "few"):
        values = [v for k, v in rows if k == key]
        for p in probs:
            assert got[key, p] == pytest.approx(np.quantile(values, p)), (key, p)
    lone = {r.prob: r.quantile for r in stats.quantiles(df, "v", [0.5], accuracy=100).collect()}
    assert lone[0.5] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_missed_brackets_are_widened(spark, monkeypatch, keys):
    """With brackets far too narrow for a coarse sketch, answers are missed at first and found in a later round."""
    rng = np.random.default_rng(9)
    values = rng.normal(size=3000).round(6)
    df = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate(values)], "k int, v double")
    rounds = []
    inner = stats._bracketed
    monkeypatch.setattr(stats, "SLACK", 0.0)
    monkeypatch.setattr(stats, "_bracketed", lambda *a: rounds.append(a[-1]) or inner(*a))
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {(r["k"] if keys else None, r["prob"]): r["quantile"] for r in stats.quantiles(df, "v", probs, keys, accuracy=20).collect()}
    for k in range(3) if keys else [None]:
        own = values if k is None else values[k::3]
        for p in probs:
            assert got[k, p] == pytest.approx(np.quantile(own, p), abs=1e-12)
    assert len(rounds) > 1 and rounds[0] == 0 and rounds == sorted(rounds)


def test_box_and_outliers(spark):
    values = [float(v) for v in (1, 2, 3, 4, 5, 6, 7, 8, 9, 100, -50)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    box = stats.box_summary(df, "v").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert (box.q1, box.q3, box.rows, box.min, box.max) == (q1, q3, 11, -50, 100)
    assert (box.whisker_low, box.whisker_high, box.outliers) == (1, 9, 2)
    assert sorted(r.v for r in stats.outliers(df, "v").collect()) == [-50, 100]


def test_clip_is_inclusive(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5)], "v int")
    assert sorted(r.v for r in stats.clip_at_quantile(df, "v").collect()) == [1, 2, 3, 4]


POSTS = [
    ("a", "A", "t1", 5, 1), ("a", "A", "t1", 1, 2), ("a", "B", "t2", None, None), (None, "x", "t1", 100, 9),
    (None, None, "t3", 1, 9), ("b", None, None, 2, 4), ("b", None, "t1", 2, 4),
]


@pytest.fixture
def posts(spark):
    return spark.createDataFrame(POSTS, "username string, full_name string, text string, retweets long, words long")


def rows(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_user_metrics(posts):
    want = {"a": ("A", 2, 6, 1.5), "b": (None, 1, 4, 4.0), None: ("x", 2, 101, 9.0)}
    assert rows(users.user_metrics(posts)) == want
    assert rows(users.user_tweets(posts)) == {k: (v[0], v[1]) for k, v in want.items()}
    assert rows(users.user_retweets(posts)) == {k: (v[0], v[2]) for k, v in want.items()}
    assert rows(users.user_words(posts)) == {k: (v[0], v[3]) for k, v in want.items()}


def test_long_and_short_texts_are_told_apart(spark):
    long = "é" * 64
    rows = [("a", None, t, 1, 1) for t in (long, long, long + "x", "s", "s", "", None)]
    df = spark.createDataFrame(rows, "username string, full_name string, text string, retweets long, words long")
    assert users.user_tweets(df).first().tweets == 4


def test_join_matches_missing_names(posts):
    m = users.user_metrics(posts)
    joined = users.join_user_metrics(*[m.select("username", "full_name", c) for c in ("tweets", "retweets", "words_avg")])
    assert rows(joined) == rows(m)
    assert {r.username for r in users.named_users(joined).collect()} == {"a", "b"}


def test_ranking_and_long_frame(posts):
    m = users.user_metrics(posts)
    assert [r.username for r in users.ranked(m, "retweets").collect()] == [None, "a", "b"]
    assert users.ranked(m, "retweets", 1).count() == 1
    assert users.long_metric(m, "tweets").count() == 6
    short = users.short_text_users(m, 1.0).collect()
    assert {r.username for r in short} == {"a", "b"}
    assert users.plot_area(m, (0, 1), (0, 50)).first().username == "b"
    counts = {r.metric: r.n for r in users.metric_rows(m, m, m).groupBy("metric").agg(F.count("*").alias("n")).collect()}
    assert counts == {"tweets": 2, "retweets": 2, "words_avg": 3}
