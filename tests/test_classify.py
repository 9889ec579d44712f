import re

import pytest
from pyspark.sql import functions as F

from mediaseries.operators import articles, classify, enrich

SCORER = classify.lexicon_scorer(["good", "fine"], ["bad"])


def labels(df, by="id"):
    return {r[by]: (r.label, r.conf) for r in df.collect()}


@pytest.fixture
def texts(spark):
    rows = [
        (1, "Good good bad. Bad!"),  # 1/3 positive, 1 negative
        (2, "Nothing to see."),
        (3, ""),
        (4, None),
        (5, "<p>\n<i>"),  # cleans to blanks only
        (6, "Good. Bad."),  # a draw: first label seen
        (7, "Bad. Good."),
        (8, "GOOD. fine bad good. Good good good bad."),
    ]
    return spark.createDataFrame(rows, "id int, text string")


WANT = {
    1: ("NEGATIVE", 1.0),
    2: ("NEUTRAL", 0.0),
    3: (None, None),
    4: (None, None),
    5: ("NEUTRAL", 0.0),
    6: ("POSITIVE", 1.0),
    7: ("NEGATIVE", 1.0),
    8: ("POSITIVE", pytest.approx((1 + 1 / 3 + 0.5) / 3)),
}


def test_verdicts(texts):
    assert labels(classify.classify(texts, SCORER)) == WANT


def test_only_pending_and_idempotent(texts):
    done = texts.withColumn("label", F.lit("KEPT")).withColumn("conf", F.when(F.col("id") == 1, 0.25))
    once = classify.classify(done, SCORER)
    got = labels(once)
    assert got[1] == ("KEPT", 0.25) and got[8] == WANT[8] and got[3] == ("KEPT", None)
    assert labels(classify.classify(once, SCORER)) == got


def test_table_way_agrees(spark, texts):
    lexicon = spark.createDataFrame([("good", 1), ("fine", 1), ("bad", -1)], "word string, weight int")
    scored = classify.score_with_lexicon_table(classify.sentence_rows(texts, "id"), lexicon, "id")
    assert labels(classify.apply_verdicts(texts, classify.text_verdicts(scored, "id"), "id")) == WANT


def test_sentence_rows_keep_order(texts):
    got = classify.sentence_rows(texts.filter("id = 8"), "id").orderBy("pos").collect()
    assert [(r.pos, r.sentence) for r in got] == [(0, "GOOD."), (1, "fine bad good."), (2, "Good good good bad.")]


def test_model_hook(texts):
    def model():
        def predict(batch):
            assert len(batch) <= 2
            return [None if "see" in s else ("POSITIVE" if "ood" in s else "NEGATIVE", 0.5) for s in batch]

        return predict

    got = labels(classify.classify(texts, classify.model_scorer(model, mini_batch=2)))
    assert got[1] == ("POSITIVE", 0.5) and got[2] == ("NEUTRAL", 0.0) and got[4] == (None, None)
    assert got[7] == ("NEGATIVE", 0.5)


def test_three_labels_in_a_table(spark):
    rows = [(1, 0, "NEUTRAL", 0.4), (1, 1, "NEUTRAL", 0.8), (1, 2, "POSITIVE", 0.6), (1, 3, "NEGATIVE", 0.1), (2, 5, "B", 0.3), (2, 4, "A", 0.3)]
    df = spark.createDataFrame(rows, "id int, pos int, label string, conf double")
    assert labels(classify.text_verdicts(df, "id")) == {1: ("NEUTRAL", 0.6), 2: ("A", 0.3)}


def test_no_shuffle(texts):
    plan = classify.classify(texts, SCORER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_articles(spark):
    html = (
        "<html><head><title>A &amp; <b>B</b></title><style>p{}</style><script>x('<p>')</script></head><body>"
        "<nav>menu</nav><!-- no --><h1>Head</h1><p>One\n two &lt;3 &quot;q&quot;</p><p> </p><div>Last<br>line</div><footer>f</footer></body></html>"
    )
    df = spark.createDataFrame([(1, html), (2, "plain"), (3, None)], "id int, html string")
    got = {r.id: (r.title, r.text) for r in articles.extract_articles(df).collect()}
    assert got[1] == ("A & B", 'Head\n\nOne two <3 "q"\n\nLast\n\nline')
    assert got[2] == ("", "plain")
    assert got[3][0] is None


def test_country_names(spark):
    cities = spark.createDataFrame(
        [("fr", None, None), ("DE", None, None), ("xx", None, None), (None, None, None), ("fr", "Mine", "1")],
        "country_code string, country_name string, country_id string",
    )
    countries = spark.createDataFrame([("FR", "France", "250"), ("DE", "Germany", "276")], "alpha_2 string, name string, numeric string")
    got = sorted((tuple(r) for r in enrich.country_names(cities, countries).collect()), key=str)
    assert got == sorted(
        [("fr", "France", "250"), ("DE", "Germany", "276"), ("xx", None, None), (None, None, None), ("fr", "Mine", "1")], key=str
    )
    again = enrich.country_names(enrich.country_names(cities, countries), countries)
    assert sorted((tuple(r) for r in again.collect()), key=str) == got


def test_datetimes_and_rejects(spark):
    df = spark.createDataFrame([(1, "0"), (2, "junk"), (3, None)], "id int, datetime string")
    got = {r.id: (str(r.date), r.formatted) for r in enrich.format_datetimes(df).collect()}
    assert got == {1: ("1970-01-01", True), 2: ("None", False), 3: ("None", False)}
    assert [tuple(r) for r in enrich.datetime_rejects(df).collect()] == [(2, "junk")]
    assert [r.words for r in enrich.count_words(df, "datetime").orderBy("id").collect()] == [1, 1, None]


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda batch: [("POSITIVE", 0.5) for _ in batch]

    df = spark.createDataFrame([(k, "One. Two.") for k in range(64)], "id int, text string").repartition(32)
    scorer = classify.model_scorer(load)
    for _ in range(2):
        assert classify.classify(df, scorer).filter("label = 'POSITIVE'").count() == 64
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) < 64


def test_formatted_rows_are_not_parsed_again(spark):
    df = spark.createDataFrame([(1, "20200102", True), (2, "20200102", False), (3, "2020-01-02 03:04:05", True), (4, "0", None)], "id int, datetime string, formatted boolean")
    got = {r.id: str(r.datetime) for r in enrich.format_datetimes(df).collect()}
    assert got == {1: "None", 2: "1970-08-22 19:08:22", 3: "2020-01-02 03:04:05", 4: "1970-01-01 00:00:00"}


def test_words_and_texts_stay_where_they_lie(spark):
    """A small lexicon meets words in their own task, and texts do not travel to their verdicts; a large one gives the same."""
    docs = spark.createDataFrame([(1, "Good good day. Bad."), (2, "bad bad good."), (3, ""), (4, None), (5, "Neither.")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "word string, weight int")

    def verdicts():
        scored = classify.score_with_lexicon_table(classify.sentence_rows(docs, "doc_id"), lexicon, "doc_id")
        return classify.apply_verdicts(docs, classify.text_verdicts(scored, "doc_id"), "doc_id").drop("text")

    found = verdicts()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\([^)]*word", physical)
    assert not re.search(r"Project \[[^\n]*(?<!\()text#\d+[,\]]", plan)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = sorted(verdicts().collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert sorted(found.collect()) == large
    assert [(r["doc_id"], r["label"]) for r in large] == [(1, "POSITIVE"), (2, "NEGATIVE"), (3, None), (4, None), (5, "NEUTRAL")]
