"""Queries over the test tables, one per operator or measure. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions import dates, scores, text
from ..operators import articles, classify, common, correlate, enrich, learned, media, merge, rollup, series, stats, users
from ..session import stage, staged_path
from ..sources import readers, writers
from ..sources.masters import StandingMaster
from . import views
from .analysis import analyse, analyse_media

TLCC_OFFSETS = range(-150, 151)
WINDOW_OFFSETS = range(-66, 67, 4)
SHORT_OFFSETS = range(-20, 21)
QUARTER = 120
WINDOW_SIZES = (5, 60, 365)
EVERY_SIZE = range(5, 366)
OUTLIER_LIMIT = 35
POSITIVE_WORDS = ("the", "of", "de", "que", "und", "with", "for", "les")
NEGATIVE_WORDS = ("and", "to", "la", "der", "is", "en", "that", "die")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def shown(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles at fixed digits, dates and times as ISO text."""

    def one(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return (F.round(c, digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        return c

    return df.select(*[one(f) for f in df.schema.fields])


def _analysis(spark: SparkSession, d: str, keys=(), limit=None):
    return analyse(views.posts(spark, d), views.quotes(spark, d), keys, limit)


def _media(spark: SparkSession, d: str):
    return analyse_media(views.posts(spark, d), views.quotes(spark, d))


# Roll-ups


@query
def daily_info(spark, d):
    """Posts per date and label with mean confidence; labels as stored."""
    return shown(rollup.daily_info(views.posts(spark, d)), 10)


@query
def signed_daily(spark, d):
    """Daily rows with clean labels and signed scores."""
    signed = rollup.signed_daily(rollup.daily_info(views.posts(spark, d)))
    return shown(signed.withColumn("score_label", scores.score_label("signed_score")), 10)


@query
def daily_sentiment(spark, d):
    """Weighted sentiment, volume and counts by sign per day."""
    return shown(_analysis(spark, d).daily, 10)


@query
def daily_sentiment_all_days(spark, d):
    """The same without dropping days that lack a sign."""
    info = stage(rollup.daily_info(views.posts(spark, d)), "daily_info")
    return shown(rollup.daily_sentiment(info, require_both=False), 10)


@query
def daily_sentiment_by_medium(spark, d):
    """Daily frames of four media in one keyed run."""
    return shown(_analysis(spark, d, ["medium"]).daily, 10)


def _uneven_posts(spark, d):
    """Posts of media that cover different spans: the later news count as another medium."""
    late = (F.col("medium") == "news") & (F.col("date") >= F.lit("1995-01-01").cast("date"))
    return views.posts(spark, d).withColumn("medium", F.when(late, "press").otherwise(F.col("medium")))


@query
def daily_sentiment_uneven_media(spark, d):
    """Daily frames of media with different spans: each keeps all days it shares with the prices."""
    return shown(analyse(_uneven_posts(spark, d), views.quotes(spark, d), ["medium"]).daily, 10)


@query
def uneven_media_prices(spark, d):
    """Prices in the range of each medium, scaled inside it."""
    return shown(analyse(_uneven_posts(spark, d), views.quotes(spark, d), ["medium"]).prices)


@query
def daily_without_outliers(spark, d):
    """Daily frame below a volume limit; the scaled volume still knows the outliers."""
    return shown(_analysis(spark, d, limit=OUTLIER_LIMIT).daily, 10)


@query
def daily_without_period(spark, d):
    """Daily rows of posts outside a dirty month."""
    kept = rollup.without_period(views.posts(spark, d), "1998-11-01", "1998-11-30")
    return shown(rollup.daily_info(kept.withColumn("label", text.strip_quotes("label"))), 10)


@query
def market_daily(spark, d):
    """Daily high and low of quotes."""
    return shown(rollup.market_daily(views.quotes(spark, d)))


@query
def market_daily_by_pair(spark, d):
    """Daily high and low of every pair, with the mid price scaled within its pair."""
    market = stage(rollup.market_daily(views.quotes(spark, d), ["pair"]), "market_pairs")
    with_mid = market.withColumn("mid_price", scores.mid_price())
    return shown(series.normalize_series(with_mid, "mid_price", "norm_mid_price", ["pair"]))


@query
def market_prices(spark, d):
    """Mid price, plain and scaled, on the dates in the common range."""
    return shown(_analysis(spark, d).prices)


@query
def common_date_range(spark, d):
    """First and last date all inputs cover."""
    return shown(_analysis(spark, d).bounds)


@query
def common_dates(spark, d):
    """Every date of any input inside the common range."""
    return shown(_analysis(spark, d).dates).orderBy("date")


@query
def normalized_volume(spark, d):
    """Volume scaled by its own bounds, and from zero."""
    daily = stage(_analysis(spark, d).daily.select("date", "count"), "volume")
    both = series.normalize_series(daily, "count", "scaled")
    return shown(series.normalize_series(both, "count", "scaled_from_zero", lo=0))


@query
def first_post_of_day(spark, d):
    """One row per day: the first by label and confidence."""
    return shown(common.keep_first(views.posts(spark, d), ["date"], ["label", "conf", "medium"]))


@query
def monthly_mean_volume(spark, d):
    """Mean daily volume per month."""
    return shown(rollup.monthly_mean_volume(_analysis(spark, d).daily))


@query
def monthly_volume_by_medium(spark, d):
    """Mean daily volume per month and medium."""
    return shown(rollup.monthly_mean_volume(_analysis(spark, d, ["medium"]).daily, ["medium"]))


# Distributions


@query
def sentiment_histogram(spark, d):
    """Days per scaled sentiment at two digits."""
    daily = _analysis(spark, d).daily
    return stats.histogram(daily.withColumn("norm_sent", scores.round_even("norm_sent", 2)), "norm_sent")


@query
def volume_histogram(spark, d):
    """Days per volume."""
    return stats.histogram(_analysis(spark, d).daily, "count")


@query
def clipped_volume_histogram(spark, d):
    """Days per volume up to the third quartile."""
    daily = stage(_analysis(spark, d).daily, "daily")
    return stats.histogram(stats.clip_at_quantile(daily, "count"), "count")


@query
def sentiment_box(spark, d):
    """Box-plot numbers of scaled sentiment at two digits."""
    daily = _analysis(spark, d).daily.select(scores.round_even("norm_sent", 2).alias("norm_sent"))
    return shown(stats.box_summary(stage(daily, "daily"), "norm_sent"))


@query
def volume_box(spark, d):
    """Box-plot numbers of daily volume."""
    return shown(stats.box_summary(stage(_analysis(spark, d).daily, "daily"), "count"))


@query
def volume_box_by_medium(spark, d):
    """Box-plot numbers of daily volume, one row per medium."""
    daily = stage(_analysis(spark, d, ["medium"]).daily, "daily")
    return shown(stats.box_summary(daily, "count", ["medium"]))


@query
def volume_outliers(spark, d):
    """Days whose volume lies beyond the whiskers."""
    daily = stage(_analysis(spark, d).daily.select("date", "count"), "daily")
    return shown(stats.outliers(daily, "count"))


@query
def price_quantiles(spark, d):
    """Exact quantiles of all quotes."""
    return shown(stats.quantiles(views.quotes(spark, d), "high", [0.05, 0.25, 0.5, 0.75, 0.95]), 4)


@query
def price_quantiles_by_pair(spark, d):
    """Exact quantiles of the quotes of every pair."""
    return shown(stats.quantiles(views.quotes(spark, d), "high", [0.25, 0.5, 0.75], ["pair"]), 4)


# Bins and trends


@query
def sentiment_time_bins(spark, d):
    """Scaled sentiment in at most 100 date bins."""
    return shown(series.time_bins(_analysis(spark, d).daily, "norm_sent"), 6)


@query
def volume_time_bins(spark, d):
    """Volume in at most 100 date bins."""
    return shown(series.time_bins(_analysis(spark, d).daily, "count"), 6)


@query
def volume_time_bins_selected(spark, d):
    """Volume in date bins over a selected span, per medium."""
    daily = _analysis(spark, d, ["medium"]).daily
    return shown(series.time_bins(daily, "count", ["medium"], extent=("1997-01-01", "1998-12-31")), 6)


@query
def volume_trend(spark, d):
    """Degree-9 polynomial of volume on date."""
    daily = stage(_analysis(spark, d).daily.select("date", "count"), "daily")
    return shown(series.polynomial_trend(daily, "count").drop("count"), 5)


@query
def price_trend(spark, d):
    """Degree-9 polynomial of mid price on date."""
    prices = stage(_analysis(spark, d).prices.select("date", "mid_price"), "prices")
    return shown(series.polynomial_trend(prices, "mid_price").drop("mid_price"), 2)


@query
def volume_line_by_medium(spark, d):
    """Straight line through the volumes of each medium."""
    daily = stage(_analysis(spark, d, ["medium"]).daily.select("medium", "date", "count"), "daily")
    return shown(series.polynomial_trend(daily, "count", ["medium"], degree=1), 6)


# Correlation


def _sentiment_series(spark, d):
    return _analysis(spark, d).series("norm_sent")


def _volume_series(spark, d):
    return _analysis(spark, d).series("count")


@query
def sentiment_vs_price(spark, d):
    """Scaled sentiment beside the price of its date."""
    return shown(_sentiment_series(spark, d))


@query
def volume_vs_price(spark, d):
    """Volume beside the price of its date."""
    return shown(_volume_series(spark, d))


def _tlcc(frame, value, methods, offsets=TLCC_OFFSETS, keys=(), sizes=None):
    return correlate.lagged_correlation(frame, value, "mid_price", offsets, keys, methods, sizes)


@query
def tlcc_pearson(spark, d):
    """Pearson correlation of sentiment with price at 301 offsets."""
    return shown(_tlcc(_sentiment_series(spark, d), "norm_sent", ["pearson"]))


@query
def tlcc_spearman(spark, d):
    """Spearman correlation of sentiment with price at 301 offsets."""
    return shown(_tlcc(_sentiment_series(spark, d), "norm_sent", ["spearman"]))


@query
def tlcc_kendall(spark, d):
    """Kendall's tau-b of sentiment with price at 301 offsets."""
    return shown(_tlcc(_sentiment_series(spark, d), "norm_sent", ["kendall"]))


@query
def tlcc_volume(spark, d):
    """Pearson and Spearman correlation of volume with price at 301 offsets."""
    return shown(_tlcc(_volume_series(spark, d), "count", ["pearson", "spearman"]))


@query
def tlcc_volume_kendall(spark, d):
    """Kendall's tau-b of volume with price at 301 offsets."""
    return shown(_tlcc(_volume_series(spark, d), "count", ["kendall"]))


@query
def tlcc_by_medium(spark, d):
    """Pearson and Spearman correlation of every medium's sentiment with price at 301 offsets."""
    frame = _analysis(spark, d, ["medium"]).series("norm_sent")
    return shown(_tlcc(frame, "norm_sent", ["pearson", "spearman"], keys=["medium"]))


@query
def tlcc_by_pair(spark, d):
    """Pearson and Spearman correlation of sentiment with the price of every pair at 301 offsets."""
    frame = analyse(views.posts(spark, d), views.quotes(spark, d), pairs=["pair"]).series("norm_sent")
    return shown(_tlcc(frame, "norm_sent", ["pearson", "spearman"], keys=["pair"]))


@query
def tlcc_extremes(spark, d):
    """Largest and smallest sentiment correlation and where they lie, for each method."""
    frame = _sentiment_series(spark, d)
    return shown(correlate.correlation_extremes(_tlcc(frame, "norm_sent", ["pearson", "spearman"])))


@query
def tlcc_volume_extremes(spark, d):
    """Largest and smallest volume correlation and where they lie, for each method."""
    frame = _volume_series(spark, d)
    return shown(correlate.correlation_extremes(_tlcc(frame, "count", ["pearson", "spearman"])))


@query
def wtlcc_sentiment(spark, d):
    """Windowed Spearman correlation of sentiment, 120 rows a window."""
    return shown(_tlcc(_sentiment_series(spark, d), "norm_sent", ["spearman"], WINDOW_OFFSETS, sizes=[QUARTER]))


@query
def wtlcc_volume(spark, d):
    """Windowed Spearman correlation of volume, 120 rows a window."""
    return shown(_tlcc(_volume_series(spark, d), "count", ["spearman"], WINDOW_OFFSETS, sizes=[QUARTER]))


@query
def wtlcc_volume_short(spark, d):
    """Windowed Spearman correlation of volume, 60 rows a window, every offset to 20."""
    return shown(_tlcc(_volume_series(spark, d), "count", ["spearman"], SHORT_OFFSETS, sizes=[60]))


@query
def wtlcc_window_sizes(spark, d):
    """Windowed Spearman correlation of sentiment at several window sizes in one run."""
    return shown(_tlcc(_sentiment_series(spark, d), "norm_sent", ["spearman"], WINDOW_OFFSETS, sizes=WINDOW_SIZES))


@query
def wtlcc_every_size(spark, d):
    """Windowed Spearman correlation of sentiment at every window size from 5 to 365."""
    return shown(_tlcc(_sentiment_series(spark, d), "norm_sent", ["spearman"], WINDOW_OFFSETS, sizes=EVERY_SIZE))


@query
def wtlcc_by_medium(spark, d):
    """Windowed Spearman correlation of every medium's sentiment, 60 rows a window."""
    frame = _analysis(spark, d, ["medium"]).series("norm_sent")
    return shown(_tlcc(frame, "norm_sent", ["spearman"], WINDOW_OFFSETS, ["medium"], [60]))


# All media


@query
def media_summary(spark, d):
    """One row per day all media share: each one's sentiment and volume, mean and total."""
    return shown(_media(spark, d).summary)


@query
def media_prices(spark, d):
    """Prices cut to the summary's days, scaled before the cut."""
    return shown(_media(spark, d).prices)


@query
def media_monthly_volume(spark, d):
    """Monthly mean volume per medium, long, months every medium has."""
    monthly = media.media_monthly(_media(spark, d).daily)
    return shown(media.melt_media(monthly, "count", id_column="month"))


@query
def media_sentiment_long(spark, d):
    """Daily sentiment of each medium, long."""
    return shown(media.melt_media(_media(spark, d).summary, "sentiment"))


@query
def media_volume_long(spark, d):
    """Daily volume of each medium, long."""
    return shown(media.melt_media(_media(spark, d).summary, "count"))


@query
def media_heatmap(spark, d):
    """Mean sentiment per month and medium."""
    return shown(media.media_heatmap(_media(spark, d).summary))


@query
def media_volume_bins(spark, d):
    """Volume of each medium in date bins."""
    long = stage(media.melt_media(_media(spark, d).summary, "count"), "media_volume")
    return shown(series.time_bins(long, "count", ["medium"]), 6)


@query
def media_tlcc(spark, d):
    """Pearson and Spearman correlation of mean media sentiment with price."""
    return shown(_tlcc(_media(spark, d).series("norm_sent"), "norm_sent", ["pearson", "spearman"]))


@query
def media_tlcc_volume(spark, d):
    """Pearson and Spearman correlation of total media volume with price."""
    return shown(_tlcc(_media(spark, d).series("count"), "count", ["pearson", "spearman"]))


@query
def media_wtlcc(spark, d):
    """Windowed Spearman correlation of mean media sentiment."""
    return shown(_tlcc(_media(spark, d).series("norm_sent"), "norm_sent", ["spearman"], WINDOW_OFFSETS, sizes=[QUARTER]))


@query
def media_kendall(spark, d):
    """Kendall's tau-b of mean media sentiment with price."""
    return shown(_tlcc(_media(spark, d).series("norm_sent"), "norm_sent", ["kendall"]))


@query
def media_wtlcc_volume(spark, d):
    """Windowed Spearman correlation of total media volume."""
    return shown(_tlcc(_media(spark, d).series("count"), "count", ["spearman"], WINDOW_OFFSETS, sizes=[QUARTER]))


@query
def media_kendall_volume(spark, d):
    """Kendall's tau-b of total media volume with price."""
    return shown(_tlcc(_media(spark, d).series("count"), "count", ["kendall"]))


@query
def media_extremes(spark, d):
    """Largest and smallest correlation of mean media sentiment, for each method."""
    return shown(correlate.correlation_extremes(_tlcc(_media(spark, d).series("norm_sent"), "norm_sent", ["pearson", "spearman"])))


@query
def media_volume_extremes(spark, d):
    """Largest and smallest correlation of total media volume, for each method."""
    return shown(correlate.correlation_extremes(_tlcc(_media(spark, d).series("count"), "count", ["pearson", "spearman"])))


@query
def media_sentiment_box(spark, d):
    """Box-plot numbers of each medium's sentiment."""
    long = stage(media.melt_media(_media(spark, d).summary, "sentiment"), "media_sentiment")
    return shown(stats.box_summary(long, "sentiment", ["medium"]))


@query
def media_sentiment_histogram(spark, d):
    """Days per medium and sentiment at two digits."""
    long = media.melt_media(_media(spark, d).summary, "sentiment")
    return stats.histogram(long.withColumn("sentiment", scores.round_even("sentiment", 2)), "sentiment", ["medium"])


@query
def media_sentiment_bins(spark, d):
    """Sentiment of each medium in date bins."""
    long = stage(media.melt_media(_media(spark, d).summary, "sentiment"), "media_sentiment")
    return shown(series.time_bins(long, "sentiment", ["medium"]), 6)


# Users


@query
def user_retweets(spark, d):
    """Retweets per user, highest first."""
    return users.ranked(users.user_retweets(views.user_posts(spark, d)), "retweets")


@query
def user_tweets(spark, d):
    """Distinct texts per user, highest first."""
    return users.ranked(users.user_tweets(views.user_posts(spark, d)), "tweets")


@query
def top_users(spark, d):
    """The twenty users with the most retweets."""
    return users.ranked(users.user_retweets(views.user_posts(spark, d)), "retweets", 20)


@query
def user_words(spark, d):
    """Mean words per user, highest first."""
    return shown(users.ranked(users.user_words(views.user_posts(spark, d)), "words_avg"))


@query
def user_metrics(spark, d):
    """All metrics per user in one pass."""
    return shown(users.user_metrics(views.user_posts(spark, d)))


def _user_tables(spark, d):
    metrics = stage(users.user_metrics(views.user_posts(spark, d)), "user_metrics")
    return [metrics.select("username", "full_name", m) for m in ("tweets", "retweets", "words_avg")]


@query
def user_metrics_joined(spark, d):
    """The three user tables joined on name, missing names matching."""
    return shown(users.join_user_metrics(*_user_tables(spark, d)))


@query
def user_short_texts(spark, d):
    """Named users with a mean length up to 1.1 times the third quartile."""
    tweets, retweets, words = _user_tables(spark, d)
    joined = users.join_user_metrics(users.named_users(tweets), users.named_users(retweets), words)
    return shown(users.short_text_users(stage(joined, "joined"), 1.1))


@query
def user_plot_area(spark, d):
    """Named users inside the drawn area."""
    metrics = users.named_users(users.user_metrics(views.user_posts(spark, d)))
    return shown(users.plot_area(metrics, (0, 40), (0, 1000)))


@query
def user_metric_boxes(spark, d):
    """Box-plot numbers of the three user metrics."""
    return shown(stats.box_summary(users.metric_rows(*_user_tables(spark, d)), "value", ["metric"]))


@query
def user_words_long(spark, d):
    """Mean lengths in whole words, once per way of drawing."""
    words = users.user_words(views.user_posts(spark, d)).select(F.col("words_avg").cast("int").alias("words_avg"))
    return users.long_metric(words, "words_avg")


# Cleaning


@query
def format_datetimes(spark, d):
    """Raw datetime text in mixed layouts to timestamp, date and flag."""
    return shown(enrich.format_datetimes(views.raw_datetimes(spark, d)))


@query
def datetime_rejects(spark, d):
    """Datetime texts no layout can read."""
    return enrich.datetime_rejects(views.raw_datetimes(spark, d))


@query
def format_pending_datetimes(spark, d):
    """Raw datetimes of which some are done: those keep what they hold, digits included."""
    raw = views.raw_datetimes(spark, d).join(views.table(spark, d, "events").select("event_id", "ts"), "event_id")
    done = F.col("event_id") % 3 == 0
    held = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.lit("20200102"))
    mixed = raw.select("event_id", F.when(done, held).otherwise(F.col("datetime")).alias("datetime"), done.alias("formatted"))
    return shown(enrich.format_datetimes(mixed))


@query
def format_free_datetimes(spark, d):
    """Datetime texts in the free layouts, one after the other."""
    at = F.col("ts").cast("timestamp")
    layouts = [
        "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "MM/dd/yyyy HH:mm:ss", "EEE MMM dd HH:mm:ss Z yyyy",
        "MMM d, yyyy", "EEE, d MMM yyyy HH:mm:ss", "d MMMM yyyy",
    ]
    text_ = F.lit(None).cast("string")
    for k, layout in enumerate(layouts):
        text_ = F.when(F.col("event_id") % len(layouts) == k, F.date_format(at, layout)).otherwise(text_)
    return shown(enrich.format_datetimes(views.table(spark, d, "events").select("event_id", text_.alias("datetime"))))


@query
def datetime_format_check(spark, d):
    """Raw datetimes that already have the standard format, per answer."""
    at = F.col("ts").cast("timestamp")
    raw = views.raw_datetimes(spark, d).join(views.table(spark, d, "events").select("event_id", "ts"), "event_id")
    mixed = raw.withColumn("datetime", F.when(F.col("event_id") % 5 == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("datetime")))
    return mixed.groupBy(dates.has_standard_format("datetime").alias("standard")).agg(F.count("*").alias("rows"))


@query
def word_counts(spark, d):
    """Words per document, only where the count is pending."""
    docs = views.texts(spark, d)
    known = F.when(F.col("doc_id") % 4 == 0, -1)
    return enrich.count_words(docs.withColumn("words", known)).select("doc_id", "words")


@query
def clean_html(spark, d):
    """Pages after the HTML steps for posts."""
    return views.table(spark, d, "pages").select("page_id", text.clean_html("html").alias("text"))


@query
def parsed_texts(spark, d):
    """Documents trimmed and freed of double quotes."""
    return views.texts(spark, d).select("doc_id", text.parse_text("text").alias("text"))


@query
def page_articles(spark, d):
    """Title and paragraphs of every page."""
    return articles.extract_articles(views.table(spark, d, "pages"))


@query
def page_bodies(spark, d):
    """Title and running text of every page, without advertisements, menus and footers."""
    return articles.extract_bodies(views.table(spark, d, "pages"))


@query
def source_datetimes(spark, d):
    """Dates that two kinds of events write as day/month and as month/day, read as each source writes them."""
    at, day_first = F.col("ts").cast("timestamp"), F.col("event_type").isin("view", "error")
    late = F.expr("make_interval(0, event_id % 12)")
    moved = F.date_format(at + late, "yyyy-MM-dd HH:mm:ss").cast("timestamp")
    raw = F.when(day_first, F.date_format(moved, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(moved, "M/d/yyyy HH:mm"))
    rows = views.table(spark, d, "events").select("event_id", "event_type", raw.alias("datetime"))
    return shown(learned.format_by_source(rows, "event_type"))


@query
def source_day_orders(spark, d):
    """Which kinds of events put the day first, with the votes of their unambiguous texts."""
    at, day_first = F.col("ts").cast("timestamp"), F.col("event_type").isin("view", "error")
    raw = F.when(day_first, F.date_format(at, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(at, "M/d/yyyy HH:mm"))
    return learned.learn_day_order(views.table(spark, d, "events").select("event_type", raw.alias("datetime")), "event_type")


@query
def country_names(spark, d):
    """Country name and id for cities that lack them."""
    return enrich.country_names(views.cities(spark, d), views.countries(spark, d))


@query
def pending_countries(spark, d):
    """Rows waiting for a country name, before and after."""
    cities = views.cities(spark, d)
    after = enrich.country_names(cities, views.countries(spark, d))
    return (
        common.pending_counts(cities, "country_name")
        .withColumn("stage", F.lit("before"))
        .unionByName(common.pending_counts(after, "country_name").withColumn("stage", F.lit("after")))
    )


@query
def numeric_ids(spark, d):
    """Identifiers read as longs where they are, NULL elsewhere."""
    ids = views.table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("raw")
    )
    return ids.select("event_id", text.long_or_null("raw").alias("id"))


# Merging

_DOC = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
_DOC_BY_ID = T.StructType([f for f in _DOC.fields if f.name != "text"])


@query
def merge_upsert_text(spark, d):
    """Two document tables folded by text; blanks yield to later values."""
    return merge.merge_upsert(views.two_sources(spark, d), "text", _DOC, ["doc_id"], blank_is_missing=True, trim=True)


@query
def merge_upsert_id(spark, d):
    """Three document tables folded by id."""
    return merge.merge_upsert(views.id_sources(spark, d), "doc_id", _DOC_BY_ID, ["doc_id"])


@query
def master_merge_text(spark, d):
    """The two document tables merged one after the other into a standing master, by text."""
    master = StandingMaster(spark, staged_path(spark, "master-text"), "text", _DOC, 16, blank_is_missing=True, trim=True)
    for source in views.two_sources(spark, d):
        master.merge([source], ["doc_id"])
    return master.read()


@query
def master_merge_id(spark, d):
    """A standing master by id, made of the first document table; the two others come in one batch."""
    master = StandingMaster(spark, staged_path(spark, "master-id"), "doc_id", _DOC_BY_ID, 16)
    first, *others = views.id_sources(spark, d)
    master.merge([first], ["doc_id"])
    master.merge(others, ["doc_id"])
    return master.read()


@query
def master_merge_counts(spark, d):
    """Keys inserted and known keys met by each merge into a standing master, and rows without a key."""
    master = StandingMaster(spark, staged_path(spark, "master-counts"), "text", _DOC, 16, trim=True)
    odd = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    counts = [(k, master.merge([s.withColumn("text", odd)], ["doc_id"])) for k, s in enumerate(views.two_sources(spark, d))]
    return spark.createDataFrame([(k, c["inserted"], c["updated"], c["keyless"]) for k, c in counts], "merge int, inserted long, updated long, keyless long")


@query
def merge_messages(spark, d):
    """Conversation turns folded by text: first speaker and place of each distinct text."""
    turns = views.table(spark, d, "conversations")
    wanted = T.StructType([turns.schema[c] for c in ("text", "conv_id", "turn", "role")])
    return merge.merge_upsert([turns], "text", wanted, ["conv_id", "turn"], trim=True)


@query
def merge_none_text(spark, d):
    """Documents by text, where some texts are the word None, and many rows without a text are alike."""
    docs = views.texts(spark, d).select("doc_id", "lang", "source", "text")
    odd = F.when(F.col("doc_id") % 10 == 0, "None").when(F.col("doc_id") % 10 == 1, None).otherwise(F.col("text"))
    rows = docs.withColumn("text", odd).withColumn("source", F.when(F.col("doc_id") % 4 == 0, "None").otherwise(F.col("source")))
    wanted = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source")])
    return merge.merge_upsert([rows], "text", wanted, ["doc_id"], trim=True)


@query
def merge_report(spark, d):
    """Rows inserted and rows merged per source."""
    return merge.merge_report(views.two_sources(spark, d), "text", _DOC, ["doc_id"], trim=True)


@query
def align_columns(spark, d):
    """Messages under the canonical post columns, missing ones NULL."""
    known = readers.message_rows(views.messages(spark, d)).withColumnRenamed("message_id", "id")
    aligned = common.align(known.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")), schemas.POST)
    return aligned.select("id", "user_id", "username", "datetime", "text", "retweets", "conf")


@query
def schema_columns(spark, d):
    """Names and types of a table's columns, and how many rows have a value in each."""
    items = views.table(spark, d, "lineitem")
    filled = items.agg(*[F.count(c).alias(c) for c in items.columns]).unpivot([], items.columns, "name", "filled")
    return common.describe_columns(items).join(filled, "name")


# Classification


def _scorer():
    return classify.lexicon_scorer(POSITIVE_WORDS, NEGATIVE_WORDS)


def _partly_labelled(spark, d):
    docs = views.texts(spark, d).select("doc_id", "text")
    known = views.table(spark, d, "labels").select(
        "doc_id",
        F.when(F.col("quality") == 1, scores.POSITIVE).otherwise(scores.NEGATIVE).alias("label"),
        F.when(F.col("toxic") == 0, 0.5).alias("conf"),
    )
    return docs.join(known, "doc_id", "left")


@query
def sentences(spark, d):
    """Sentences of every document."""
    return classify.sentence_rows(views.texts(spark, d), "doc_id")


@query
def sentence_scores(spark, d):
    """Label and confidence of every sentence with one."""
    rows = classify.sentence_rows(views.texts(spark, d), "doc_id")
    return shown(classify.score_sentence_rows(rows, _scorer()))


@query
def classify_lexicon(spark, d):
    """Verdict of every document by word lists, in one narrow pass."""
    return shown(classify.classify(views.texts(spark, d).select("doc_id", "text"), _scorer()).drop("text"))


@query
def classify_pending(spark, d):
    """Verdicts only for documents without one."""
    return shown(classify.classify(_partly_labelled(spark, d), _scorer()).drop("text"))


@query
def classify_lexicon_table(spark, d):
    """Verdict of every document by a lexicon table, through joins and aggregates."""
    words = [(w, 1) for w in POSITIVE_WORDS] + [(w, -1) for w in NEGATIVE_WORDS]
    lexicon = spark.createDataFrame(words, "word string, weight int")
    docs = views.texts(spark, d).select("doc_id", "text")
    scored = classify.score_with_lexicon_table(classify.sentence_rows(docs, "doc_id"), lexicon, "doc_id")
    return shown(classify.apply_verdicts(docs, classify.text_verdicts(scored, "doc_id"), "doc_id").drop("text"))


def _learned_weights(spark, d):
    docs = views.texts(spark, d).select("doc_id", "text").join(views.table(spark, d, "labels"), "doc_id")
    return learned.learn_weights(docs.filter("doc_id % 3 <> 1"), F.col("toxic") == 0)


@query
def learned_weights(spark, d):
    """Words that tell hostile documents from others, with their weights, from two thirds of the labels."""
    return shown(_learned_weights(spark, d), 6)


@query
def classify_learned(spark, d):
    """Verdict of every document by a linear classifier learned from the labels."""
    docs = views.texts(spark, d).select("doc_id", "text")
    weights = stage(_learned_weights(spark, d), "weights")
    scored = learned.score_with_weights(classify.sentence_rows(docs, "doc_id"), weights, "doc_id")
    return shown(classify.apply_verdicts(docs, classify.text_verdicts(scored, "doc_id"), "doc_id").drop("text"), 6)


def _with_abbreviations(spark, d):
    """Documents in which some words are written as abbreviations."""
    text_ = F.col("text")
    for word, short in (("the", "etc."), ("que", "etc."), ("und", "etc."), ("of", "e.g."), ("de", "e.g.")):
        text_ = F.replace(text_, F.lit(f" {word} "), F.lit(f" {short} "))
    return views.texts(spark, d).select("doc_id", text_.alias("text"))


@query
def abbreviations(spark, d):
    """Words that the corpus writes as abbreviations, with their scores."""
    return shown(learned.learn_abbreviations(_with_abbreviations(spark, d)), 6)


@query
def whole_sentences(spark, d):
    """Sentences of every document, where full stops of abbreviations end none."""
    docs = _with_abbreviations(spark, d)
    return learned.whole_sentences(docs, "doc_id", stage(learned.learn_abbreviations(docs), "abbreviations"))


def vowel_model():
    """A stand-in for a trained model: more e than a is positive."""

    def predict(batch):
        out = []
        for s in batch:
            e, a = s.count("e"), s.count("a")
            out.append(None if e == a else ("POSITIVE" if e > a else "NEGATIVE", abs(e - a) / (e + a)))
        return out

    return predict


@query
def classify_model(spark, d):
    """Verdict of every document by a Python model in Arrow batches."""
    docs = views.texts(spark, d).select("doc_id", "text")
    return shown(classify.classify(docs, classify.model_scorer(vowel_model)).drop("text"))


@query
def classified_posts_per_label(spark, d):
    """Verdicts of all conversation turns rolled up by label."""
    turns = classify.classify(views.table(spark, d, "conversations"), _scorer())
    return shown(turns.groupBy("role", "label").agg(F.count("*").alias("count"), F.avg("conf").alias("conf")))


# Sources and sinks


@query
def csv_export_and_read(spark, d):
    """Daily rows exported from a view as CSV with a header, and read back."""
    path = staged_path(spark, "daily_csv")
    writers.export_view(rollup.daily_info(views.posts(spark, d)), "daily_info_view", path)
    return shown(readers.read_csv(spark, path, schemas.DAILY_INFO), 10)


def _damaged_csv(spark, d):
    path = staged_path(spark, "damaged_csv")
    fields = F.concat_ws(",", F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"))
    line = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), fields)).otherwise(fields)
    views.table(spark, d, "orders").select(line.alias("value")).write.text(path)
    schema = T.StructType(
        [
            T.StructField("orderkey", T.LongType()),
            T.StructField("priority", T.StringType()),
            T.StructField("price", T.DoubleType()),
        ]
    )
    return path, schema


@query
def csv_drops_malformed(spark, d):
    """CSV rows that fit their schema, from a file in which a fifth does not."""
    path, schema = _damaged_csv(spark, d)
    return shown(readers.read_csv(spark, path, schema, header=False).select("priority", "price"))


@query
def csv_malformed_lines(spark, d):
    """The lines that do not fit, whole."""
    path, schema = _damaged_csv(spark, d)
    return readers.malformed_csv(spark, path, schema, header=False).select("line")


@query
def csv_texts_with_line_breaks(spark, d):
    """Whole documents written as CSV with a header and read back."""
    path = staged_path(spark, "texts_csv")
    writers.export_view(views.texts(spark, d), "documents_view", path)
    return readers.read_csv(spark, path, views.texts(spark, d).schema, multiline=True)


@query
def csv_columns_by_header(spark, d):
    """Two CSV tables whose columns stand in another order, lack one, and hold one more, under one schema."""
    customers = views.table(spark, d, "customer")
    one, two = staged_path(spark, "shuffled_csv"), staged_path(spark, "partial_csv")
    customers.filter("c_custkey % 2 = 0").select("c_mktsegment", "c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(one)
    customers.filter("c_custkey % 2 = 1").select("c_nationkey", "c_name", "c_custkey").write.option("header", True).csv(two)
    schema = T.StructType([customers.schema[c] for c in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")])
    return readers.read_csv(spark, one, schema).unionByName(readers.read_csv(spark, two, schema))


@query
def csv_mixed_headers(spark, d):
    """A folder whose files have three headers (another order, a column less and one more, none that is known), read in one call."""
    customers, root = views.table(spark, d, "customer"), staged_path(spark, "mixed_csv")
    headers = [("c_mktsegment", "c_custkey", "c_name", "c_acctbal"), ("c_nationkey", "c_name", "c_custkey"), ("c_acctbal",)]
    for k, names in enumerate(headers):
        customers.filter(F.col("c_custkey") % 3 == k).select(*names).write.mode("append").option("header", True).csv(root)
    schema = T.StructType([customers.schema[c] for c in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")])
    return readers.read_csv(spark, root, schema)


@query
def headerless_articles(spark, d):
    """Articles appended twice to a headerless CSV, and read back."""
    path = staged_path(spark, "articles_csv")
    pages = articles.extract_articles(views.table(spark, d, "pages"))
    rows = common.align(pages.withColumnRenamed("url", "link"), schemas.ARTICLE)
    writers.append_csv(rows, path)
    writers.append_csv(rows.withColumn("media", F.lit("second run")), path)
    return readers.read_articles(spark, path).select("title", "media", "link", "text")


@query
def found_files(spark, d):
    """Rows of the wanted files among several in nested folders, a year in each."""
    root = staged_path(spark, "files")
    orders = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year")
    )
    orders.repartitionByRange(32, "year").write.partitionBy("year").option("header", True).csv(root)
    files = spark.read.option("header", True).csv(root).filter("year IN (1996, 1997)")
    names = [r.name for r in files.select(F.col("_metadata.file_name").alias("name")).distinct().collect()]
    schema = T.StructType([T.StructField("orderkey", T.LongType()), T.StructField("priority", T.StringType())])
    return readers.find_files(spark, root, names, schema).select("orderkey", "priority")


@query
def json_messages(spark, d):
    """Chat messages written as JSON, read back and flattened."""
    path = staged_path(spark, "messages")
    views.messages(spark, d).write.json(path)
    return shown(readers.message_rows(readers.read_messages(spark, path)))


@query
def json_message_arrays(spark, d):
    """Chat messages in files that hold one JSON array each, read back and flattened."""
    path = staged_path(spark, "message_arrays")
    batch = F.floor(F.col("id") / 500)
    arrays = views.messages(spark, d).groupBy(batch.alias("batch")).agg(F.to_json(F.collect_list(F.struct("_", "id", "date", "message", "from_id", "views", "forwards"))).alias("value"))
    arrays.write.partitionBy("batch").text(path)
    return shown(readers.message_rows(readers.read_messages(spark, f"{path}/*", lines=False)))


def _damaged_messages(spark, d):
    path = staged_path(spark, "damaged_messages")
    whole = F.to_json(F.struct("_", "id", "date", "message", "from_id", "views", "forwards"))
    line = F.when(F.col("id") % 50 == 0, F.concat(F.lit("{broken "), F.col("id"))).otherwise(whole)
    views.messages(spark, d).select(line.alias("value")).write.text(path)
    return path


@query
def json_rejects(spark, d):
    """Lines that are no message."""
    return readers.malformed_messages(spark, _damaged_messages(spark, d))


@query
def json_messages_beside_rejects(spark, d):
    """The messages beside them."""
    return shown(readers.message_rows(readers.read_messages(spark, _damaged_messages(spark, d))))


@query
def messages_incomplete(spark, d):
    """Messages that lack a field of their kind."""
    whole = views.messages(spark, d)
    cut = whole.withColumn("date", F.when(F.col("id") % 9 != 0, F.col("date"))).withColumn(
        "from_id", F.when(F.col("id") % 13 != 0, F.col("from_id"))
    )
    return readers.incomplete_messages(cut).select("id", "date")


@query
def table_version(spark, d):
    """Counted texts written as a new version of their table, and read back."""
    path = staged_path(spark, "version")
    writers.write_version(enrich.count_words(views.texts(spark, d)).select("doc_id", "words"), path)
    return readers.read_table(spark, path)


@query
def json_chart_data(spark, d):
    """Monthly volumes written as chart data and read back."""
    path = staged_path(spark, "chart")
    monthly = rollup.monthly_mean_volume(_analysis(spark, d).daily)
    writers.write_chart_data(monthly, path)
    return shown(spark.read.schema(monthly.schema).json(path))


@query
def written_back(spark, d):
    """A table by language and source, where some rows of two sources lack their word counts: only those partitions are written."""
    path = staged_path(spark, "written-back")
    waits = F.col("source").isin("src1", "src12") & (F.col("doc_id") % 3 > 0)
    counted = F.when(~waits, -1).alias("words")
    views.texts(spark, d).select("doc_id", "text", "lang", "source", counted).write.partitionBy("lang", "source").parquet(path)
    writers.rewrite_pending(spark, path, ["lang", "source"], F.col("words").isNull(), enrich.count_words)
    return readers.read_table(spark, path, ["doc_id", "lang", "source", "words"])


@query
def repeated_batches(spark, d):
    """Two batches of messages, the second of which is written twice."""
    path = staged_path(spark, "batches")
    rows = readers.message_rows(views.messages(spark, d)).select("message_id", "user_id", "views")
    halves = [rows.filter(F.col("message_id") % 2 == half) for half in (0, 1)]
    writers.append_batch(halves[0], path, "first")
    writers.append_batch(halves[1].limit(10), path, "second")
    writers.append_batch(halves[1], path, "second")
    return readers.read_batches(spark, path, rows.schema)


@query
def appended_rows(spark, d):
    """Two batches of messages appended to one table."""
    path = staged_path(spark, "appended")
    rows = readers.message_rows(views.messages(spark, d))
    for half in (0, 1):
        writers.append_rows(rows.filter(F.col("message_id") % 2 == half), path)
    return shown(readers.read_table(spark, path, ["message_id", "user_id", "views"]))
