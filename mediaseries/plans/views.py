"""The test tables seen as posts, quotes, users, texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.readers import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Times are read in UTC, as the session has it."""
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as classified posts. One label is quoted, as classified tables may be."""
    flag = F.col("l_returnflag")
    place = F.col("l_linenumber") % 4
    return table(spark, sf_dir, "lineitem").select(
        F.to_date("l_shipdate").alias("date"),
        F.when(flag == "A", '"POSITIVE"').when(flag == "R", "NEGATIVE").otherwise("NEUTRAL").alias("label"),
        F.when(flag == "N", 0.0).otherwise(F.col("l_discount") * 10).alias("conf"),
        F.when(place == 0, "news").when(place == 1, "reddit").when(place == 2, "twitter").otherwise("telegram").alias("medium"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fine-grained quotes."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"), price.alias("high"), price.alias("low"),
        F.col("o_orderpriority").alias("pair"),
    )


def user_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by customer as posts by user; every fiftieth customer has no username."""
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    return joined.select(
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_custkey").cast("string")).alias("username"),
        F.col("c_name").alias("full_name"),
        F.col("l_partkey").cast("string").alias("text"),
        F.col("l_quantity").cast("long").alias("retweets"),
        F.col("l_linenumber").cast("long").alias("words"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


def two_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents as two tables that each lack a column's values; blanks stand in for some."""
    docs = texts(spark, sf_dir)
    even = docs.filter(F.col("doc_id") % 2 == 0).withColumn("lang", F.lit(None).cast("string"))
    odd = docs.filter(F.col("doc_id") % 2 == 1).withColumn("source", F.lit("")).drop("n_chars")
    return [even, odd]


def id_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Documents as tables that share ids: a master with gaps, one that fills them, one with new rows."""
    docs = texts(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")
    gaps = docs.filter(F.col("doc_id") % 3 != 0).withColumn("lang", F.when(F.col("doc_id") % 3 == 1, F.col("lang")))
    fill = docs.filter(F.col("doc_id") % 2 == 0).select(
        "doc_id", F.concat(F.lit('"'), "lang", F.lit('"')).alias("lang"), F.lit("None").alias("source")
    )
    rest = docs.select("doc_id", F.upper("lang").alias("lang"), "source", (F.col("n_chars") + 1).alias("n_chars"))
    return [gaps, fill, rest]


def raw_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as text in four layouts, one of which nothing can read."""
    at = F.col("ts").cast("timestamp")
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, (F.unix_micros(at) / 1e6).cast("string"))
        .when(kind == 1, F.concat(F.lit('"'), F.date_format(at, "hh:mm a - d MMM yyyy"), F.lit('"')))
        .when(kind == 2, F.date_format(at, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("n/a "), F.col("event_id").cast("string")))
    )
    return table(spark, sf_dir, "events").select("event_id", raw.alias("datetime"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested chat messages."""
    kind = F.when(F.col("event_type") == "error", "MessageService").otherwise("Message")
    peer = F.when(F.col("event_id") % 5 == 0, "PeerChannel").otherwise("PeerUser")
    return table(spark, sf_dir, "events").select(
        kind.alias("_"),
        F.col("event_id").alias("id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"),
        F.col("props").alias("message"),
        F.struct(peer.alias("_"), F.col("user_id")).alias("from_id"),
        (F.col("event_id") % 7).alias("views"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 11).alias("forwards"),
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cities: code from the nation, some already named."""
    named = F.col("c_custkey") % 10 == 0
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lower(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("country_code"),
        F.when(named, "already named").alias("country_name"),
        F.when(named, "000").alias("country_id"),
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as the country table, every fifth one missing."""
    nations = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 5 != 0)
    return nations.select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("alpha_2"),
        F.col("n_name").alias("name"),
        F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("numeric"),
    )
