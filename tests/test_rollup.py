import datetime as dt

import pytest
from pyspark.sql import functions as F

from mediaseries.operators import common, media, rollup, series
from mediaseries.plans.analysis import analyse, analyse_media


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def info(spark, rows):
    return spark.createDataFrame([(day(d), l, c, f) for d, l, c, f in rows], "date date, label string, count long, conf double")


def test_quoted_and_plain_labels_are_one(spark):
    daily = rollup.daily_sentiment(
        info(spark, [(0, '"POSITIVE"', 3, 0.5), (0, "POSITIVE", 1, 0.9), (0, "NEGATIVE", 4, 0.2), (0, "NEUTRAL", 2, 0.0)])
    ).collect()
    assert len(daily) == 1
    row = daily[0]
    assert (row["count"], row.positives, row.negatives) == (10, 4, 4)
    assert row.sentiment == pytest.approx((1.5 + 0.9 - 0.8) / 10)
    assert row.norm_sent == pytest.approx((row.sentiment + 1) / 2)


def test_one_sided_days_vanish_but_set_the_scale(spark):
    rows = [(0, "POSITIVE", 5, 0.5), (0, "NEGATIVE", 5, 0.5), (1, "POSITIVE", 40, 0.5), (2, None, 7, 0.1), (3, "NEGATIVE", 1, None)]
    daily = rollup.daily_sentiment(info(spark, rows)).collect()
    assert [(r.date, r.norm_count, r.label) for r in daily] == [(day(0), 10 / 40, "NEUTRAL")]
    assert rollup.daily_sentiment(info(spark, rows), require_both=False).count() == 2


def test_unclassified_posts_count_but_do_not_weigh(spark):
    posts = spark.createDataFrame([(day(0), "A", 0.5), (day(0), "A", None)], "date date, label string, conf double")
    assert [(r["count"], r.conf) for r in rollup.daily_info(posts).collect()] == [(2, 0.5)]


def test_outlier_limit_is_exclusive(spark):
    df = spark.createDataFrame([(9,), (10,), (11,)], "count long")
    assert [r["count"] for r in rollup.drop_outlier_days(df, 10).collect()] == [9]


def test_ranges_and_dates(spark):
    a = spark.createDataFrame([(day(d),) for d in (0, 3, 9)], "date date")
    b = spark.createDataFrame([(day(d),) for d in (2, 3, 12)], "date date")
    bounds = rollup.common_range(a, b)
    assert tuple(bounds.first()) == (day(2), day(9))
    kept = rollup.in_range(rollup.distinct_dates(a, b), bounds).orderBy("date").collect()
    assert [r.date for r in kept] == [day(2), day(3), day(9)]


def test_without_period(spark):
    df = spark.createDataFrame([(day(d),) for d in range(5)], "date date")
    assert [r.date for r in rollup.without_period(df, day(1), day(3)).orderBy("date").collect()] == [day(0), day(4)]


def test_price_frame_scales_what_it_keeps(spark):
    market = spark.createDataFrame([(day(d), 2.0 * d + 2, 2.0 * d) for d in range(5)] + [(day(5), None, 1.0)], "date date, high double, low double")
    dates = spark.createDataFrame([(day(d),) for d in (1, 2, 3)], "date date")
    got = rollup.price_frame(market, dates).orderBy("date").collect()
    assert [(r.mid_price, r.norm_mid_price) for r in got] == [(3.0, 0.0), (5.0, 0.5), (7.0, 1.0)]


def test_media_summary_rules(spark):
    rows = []
    for d in range(3):
        for k, m in enumerate(media.MEDIA):
            if (d, m) != (1, "news"):
                rows.append((m, day(d), (-1.0) ** k * 0.5, 10 * (d + 1), 0.1))
    daily = spark.createDataFrame(rows, "medium string, date date, sentiment double, count long, norm_count double")
    got = media.media_summary(daily, limit=30).collect()
    assert [(r.date, r.sentiment, r.label, r["count"]) for r in got] == [(day(0), 0.0, "NEGATIVE", 40)]
    long = media.melt_media(media.media_summary(daily), "count").collect()
    assert len(long) == 8
    months = media.media_monthly(daily).collect()
    assert [(r.month, r.news_count, r.reddit_count) for r in months] == [("2020-01", 20.0, 20.0)]
    assert media.media_heatmap(media.media_summary(daily)).count() == 4


def test_analysis_end_to_end(spark):
    posts = spark.createDataFrame(
        [(day(d), l, 0.5, m) for d in range(6) for l in ("POSITIVE", "NEGATIVE") for m in media.MEDIA],
        "date date, label string, conf double, medium string",
    )
    quotes = spark.createDataFrame([(day(d), 10.0 + d, 9.0 + d) for d in range(2, 9)], "date date, high double, low double")
    found = analyse(posts, quotes, ["medium"])
    assert {tuple(r) for r in found.bounds.collect()} == {(m, day(2), day(5)) for m in media.MEDIA}
    line = found.series("count").filter("medium = 'news'").orderBy("i").collect()
    assert [(r.i, r.date) for r in line] == [(k, day(2 + k)) for k in range(4)]
    everything = analyse_media(posts, quotes)
    assert everything.summary.count() == 4
    assert everything.series("norm_sent").count() == 4


def test_a_short_series_shortens_no_other(spark):
    rows = [(day(d), l, 0.5, "long") for d in range(20) for l in ("POSITIVE", "NEGATIVE")]
    rows += [(day(d), l, 0.25, "short") for d in range(3) for l in ("POSITIVE", "NEGATIVE")]
    posts = spark.createDataFrame(rows, "date date, label string, conf double, medium string")
    quotes = spark.createDataFrame([(day(d), 10.0 + d, 9.0 + d) for d in range(1, 15)], "date date, high double, low double")
    found = analyse(posts, quotes, ["medium"])
    for medium in ("long", "short"):
        alone = analyse(posts.filter(F.col("medium") == medium), quotes)
        mine = found.daily.filter(F.col("medium") == medium)
        assert sorted(map(tuple, mine.drop("medium").collect())) == sorted(map(tuple, alone.daily.collect()))
        prices = found.prices.filter(F.col("medium") == medium).drop("medium")
        assert sorted(map(tuple, prices.collect())) == sorted(map(tuple, alone.prices.collect()))
        assert found.series("count").filter(F.col("medium") == medium).count() == alone.series("count").count()


def test_series_meet_the_prices_they_are_matched_with(spark):
    posts = spark.createDataFrame(
        [(day(d), l, 0.5, m) for d in range(4) for l in ("POSITIVE", "NEGATIVE") for m in ("news", "reddit")],
        "date date, label string, conf double, medium string",
    )
    quotes = spark.createDataFrame(
        [(p, day(d), h + d, h) for p, h in (("a", 10.0), ("b", 20.0)) for d in range(4)], "pair string, date date, high double, low double"
    )
    wanted = [("news", "a"), ("news", "b"), ("reddit", "b")]
    matching = spark.createDataFrame(wanted, "medium string, pair string")
    line = analyse(posts, quotes, ["medium"], pairs=["pair"], matching=matching).series("count")
    got = line.groupBy("medium", "pair").agg(F.max("i").alias("last"), F.min("mid_price").alias("low")).collect()
    assert sorted(tuple(r) for r in got) == [(m, p, 3, {"a": 10.0, "b": 20.0}[p]) for m, p in wanted]
    with pytest.raises(ValueError):
        analyse(posts, quotes, ["medium"], pairs=["pair"])


def test_no_common_days(spark):
    posts = spark.createDataFrame([(day(0), "POSITIVE", 0.5), (day(0), "NEGATIVE", 0.5)], "date date, label string, conf double")
    quotes = spark.createDataFrame([(day(5), 1.0, 1.0)], "date date, high double, low double")
    found = analyse(posts, quotes)
    assert found.series("count").count() == 0
    empty = analyse(posts.limit(0), quotes)
    assert empty.daily.count() == 0 and empty.series("count").count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "z"), (2, 5, "c")], "k int, o int, v string")
    assert sorted(tuple(r) for r in common.keep_first(df, ["k"], ["o"]).collect()) == [(1, 1, "z"), (2, 5, "c")]


@pytest.mark.parametrize("limit", [None, -1])
def test_keep_first_of_ties_nulls_and_copies(spark, limit):
    rows = [(1, 2, "b", 1), (1, None, "z", 1), (1, None, "y", 2), (1, None, "y", 1), (None, 5, None, 3), (None, 5, "c", 0), (2, 1, "q", 1), (2, 1, "q", 1)]
    df = spark.createDataFrame(rows, "k int, o int, v string, w int")
    got = sorted((tuple(r) for r in common.keep_first(df, ["k"], ["o"], limit).collect()), key=str)
    assert got == sorted([(1, None, "y", 1), (None, 5, None, 3), (2, 1, "q", 1)], key=str)
    only = common.keep_first(df.select("k", "o"), ["k"], ["o"], limit)
    assert sorted((tuple(r) for r in only.collect()), key=str) == sorted([(1, None), (None, 5), (2, 1)], key=str)
    assert common.keep_first(df.limit(0), ["k"], ["o"], limit).count() == 0


def test_keep_first_moves_only_first_rows(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS k", "id % 50 AS o", "concat('text ', id) AS text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    small = common.keep_first(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert small.index("partial_min") < small.index("BroadcastHashJoin") and "LeftSemi" in small  # first rows only reach the aggregate
    large = common.keep_first(df, ["k"], ["o"], -1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in large and large.index("Exchange") < large.index("partial_min")


def test_pending(spark):
    df = spark.createDataFrame([(1, None), (2, 7)], "k int, v int")
    assert tuple(common.pending_counts(df, "v").first()) == (2, 1, 1)
    once = common.fill_pending(df, "v", F.lit(9))
    assert [r.v for r in common.fill_pending(once, "v", F.lit(1)).orderBy("k").collect()] == [9, 7]


def test_time_bins(spark):
    df = spark.createDataFrame([(day(d), d) for d in range(201)], "date date, v long")
    bins = series.time_bins(df, "v").orderBy("bin").collect()
    assert len(bins) == 100 and sum(b.days for b in bins) == 201
    assert bins[99].last_date == day(200) and bins[99].days == 3
    one = series.time_bins(df.filter("v = 7"), "v").collect()
    assert [(b.bin, b.total) for b in one] == [(0, 7)]


def test_normalize_series_bounds(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 5.0)], "k string, v double")
    got = {(r.k, r.v): r.n for r in series.normalize_series(df, "v", "n", ["k"]).collect()}
    assert got == {("a", 2.0): 0.0, ("a", 4.0): 1.0, ("b", 5.0): None}
    given = [r.n for r in series.normalize_series(df, "v", "n", lo=0.0, hi=10.0).orderBy("v").collect()]
    assert given == [0.2, 0.4, 0.5]


def test_trend_recovers_a_polynomial(spark):
    import numpy as np

    x = np.arange(400)
    t = 2 * x / 399 - 1
    y = 3 - t + 2 * t**4 - 5 * t**9
    df = spark.createDataFrame([("k", day(int(d)), float(v)) for d, v in zip(x, y)], "s string, date date, v double")
    for keys in ((), ("s",)):
        got = series.polynomial_trend(df, "v", keys).orderBy("date").collect()
        assert np.allclose([r.trend for r in got], y, atol=1e-7)
    noisy = df.withColumn("v", F.col("v") + F.sin(F.unix_date("date") * 1.7))
    rest = np.array([r.v - r.trend for r in series.polynomial_trend(noisy, "v").orderBy("date").collect()])
    for k in range(10):
        assert abs((rest * t**k).sum()) < 1e-6
    single = series.polynomial_trend(df.limit(1), "v").collect()
    assert np.isclose(single[0].trend, single[0].v)
