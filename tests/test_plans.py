"""Plans of registered queries: what must not be in them at any scale."""

import pytest

import __spark_entry__ as entry
from mediaseries.operators import users

SF = "/root/testdata/sf0.001"
PLANNED = [
    "daily_info", "daily_sentiment", "tlcc_spearman", "wtlcc_sentiment", "media_summary", "user_metrics",
    "merge_upsert_text", "classify_lexicon", "country_names", "price_quantiles_by_pair",
]


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_pairing_without_keys(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_roll_up_reads_three_columns_and_combines_before_the_shuffle(spark):
    physical = entry.queries()["daily_info"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_discount:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in physical
    assert physical.index("functions=[count(1)") < physical.index("Exchange") < physical.index("partial_count(1)")
    assert physical.count("Exchange") == 1


def test_merge_is_one_shuffle_behind_a_partial_aggregate(spark):
    from mediaseries.operators import merge
    from mediaseries.plans import queries

    a = spark.range(5).selectExpr("id AS doc_id", "'x' AS text")
    physical = merge.merge_upsert([a, a], "text", queries._DOC, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and "partial_min" in physical


def test_user_sums_never_sort_posts(spark):
    """The one sorting aggregate (over names) stands above hash aggregates of the posts."""
    from mediaseries.operators import users

    posts = spark.createDataFrame([("a", "A", "t", 1, 1)], "username string, full_name string, text string, retweets long, words long")
    physical = users.user_metrics(posts)._jdf.queryExecution().executedPlan().toString()
    for scan in physical.split("Scan ExistingRDD")[:-1]:
        assert "HashAggregate" in scan.rsplit("Exchange", 1)[-1]


def test_user_metrics_scan_posts_once(spark):
    posts = spark.read.parquet(f"{SF}/documents.parquet").selectExpr(
        "source AS username", "lang AS full_name", "text", "n_chars AS retweets", "n_chars AS words"
    )
    plan = users.user_metrics(posts)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("FileScan") == 1
