"""What is learned from the corpus: weights of words, abbreviations, the order of day and month; and bodies of pages."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mediaseries.operators import articles, classify, learned
from mediaseries.plans import views
from mediaseries.session import stage


def weights_of(df):
    return {r["word"]: r["weight"] for r in df.collect()}


def test_weights_are_log_odds(spark):
    rows = [("good day", True)] * 30 + [("good bad", True)] + [("bad day", False)] * 20 + [("Bad good?", False)] + [("unknown", None), (None, True)]
    df = spark.createDataFrame(rows, "text string, p boolean")
    got = weights_of(learned.learn_weights(df, F.col("p")))
    p, n = 32, 21  # a text that is NULL counts as one without words
    def odds(a, b):
        return math.log((a + 0.5) / (p - a + 0.5)) - math.log((b + 0.5) / (n - b + 0.5))
    assert set(got) == {"good", "bad", learned.ALWAYS}
    assert got["good"] == pytest.approx(odds(31, 1)) and got["bad"] == pytest.approx(odds(1, 21))
    assert got[learned.ALWAYS] == pytest.approx(math.log(32.5 / 21.5))
    assert set(weights_of(learned.learn_weights(df, F.col("p"), errors=0))) == {"good", "bad", "day", learned.ALWAYS}
    one = learned.learn_weights(df.where("p"), F.col("p"))
    assert set(weights_of(one)) == {learned.ALWAYS}
    assert weights_of(learned.learn_weights(df.limit(0), F.col("p"))) == {learned.ALWAYS: 0}


def test_scores(spark):
    weights = spark.createDataFrame([("good", 1.0), ("bad", -2.0), (learned.ALWAYS, 0.5)], "word string, weight double")
    rows = [(1, 0, "Good, good bad."), (1, 1, "Bad!"), (1, 2, "Nothing"), (1, 3, "1 2 3"), (2, 0, "good good good GOOD")]
    df = spark.createDataFrame(rows, "id int, pos int, sentence string")
    got = {(r["id"], r["pos"]): (r["label"], r["conf"]) for r in learned.score_with_weights(df, weights, "id").collect()}
    want = {(1, 0): 0.5, (1, 1): -1.5, (1, 2): 0.5, (1, 3): 0.5, (2, 0): 4.5}
    assert got == {k: ("POSITIVE" if s > 0 else "NEGATIVE", pytest.approx(math.tanh(abs(s) / 2))) for k, s in want.items()}


def test_held_out_accuracy(spark):
    """Learned on two thirds of the labelled documents, whole texts; the others are marked by it."""
    d = "/root/testdata/sf0.01"
    docs = views.texts(spark, d).select("doc_id", "text")
    labels = {r["doc_id"]: r["toxic"] for r in views.table(spark, d, "labels").collect()}
    held = [k for k in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    told = docs.join(views.table(spark, d, "labels"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    weights = learned.learn_weights(told, F.col("toxic") == 0)
    scored = learned.score_with_weights(classify.sentence_rows(docs, "doc_id"), weights, "doc_id")
    got = {r["doc_id"]: r["label"] for r in classify.text_verdicts(scored, "doc_id").collect()}
    right = sum((got[k] == "NEGATIVE") == (labels[k] == 1) for k in held) / len(held)
    most = max(sum(labels[k] == t for k in held) for t in (0, 1)) / len(held)
    assert right >= 0.95 > most


def test_abbreviations_stay_whole(spark):
    rng = random.Random(1)
    words = ["market", "price", "rises", "falls", "slowly", "today", "again", "because", "traders", "wait"]
    def sentence():
        return " ".join(rng.choices(words, k=rng.randrange(4, 9))) + rng.choice([".", ".", "!"])
    rows = []
    for k in range(200):
        text = " ".join([sentence(), "We met Dr. Smith today.", sentence(), "Use coins, e.g. market price.", sentence()])
        rows.append((k, text))
    df = spark.createDataFrame(rows, "id int, text string")
    found = learned.learn_abbreviations(df)
    assert {r["word"] for r in found.collect()} == {"dr", "e.g"}
    got = {}
    for r in learned.whole_sentences(df, "id", found).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["pos"], r["sentence"]))
    for k, text in rows:
        assert [p for p, _ in got[k]] == list(range(5)) and " ".join(s for _, s in got[k]) == text
        assert got[k][1][1] == "We met Dr. Smith today." and got[k][3][1] == "Use coins, e.g. market price."


def test_sentences_of_odd_texts(spark):
    rows = [(1, "Ask Dr. Dr. Who. Dr."), (2, ""), (3, None), (4, "No mark"), (5, "Dr. ")]
    df = spark.createDataFrame(rows, "id int, text string")
    short = spark.createDataFrame([("dr", 1.0)], "word string, score double")
    got = sorted((r["id"], r["pos"], r["sentence"]) for r in learned.whole_sentences(df, "id", short).collect())
    assert got == [(1, 0, "Ask Dr. Dr. Who."), (1, 1, "Dr."), (4, 0, "No mark"), (5, 0, "Dr.")]
    assert learned.learn_abbreviations(df.limit(0)).count() == 0
    plain = learned.whole_sentences(df, "id", short.limit(0))
    assert plain.count() == classify.sentence_rows(df, "id").count()


def test_day_order_by_source(spark):
    rows = [
        ("eu", "13/04/2020"), ("eu", "03/04/2020 10:30"), ("eu", "04/25/2020"), ("eu", '"14/04/2020"'),
        ("us", "04/13/2020"), ("us", "03/04/2020"), ("us", "2020-05-06"), ("us", "25/12/2020"), ("us", "1/31/2020"),
        ("none", "03/04/2020"), ("draw", "13/01/2020"), ("draw", "01/13/2020"), ("draw", "02/03/2020"), (None, "13/01/2020"), (None, "01/02/2020"),
        ("eu", "99/99/2020"), ("eu", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, source string, datetime string")
    order = {r["source"]: (r["day_first"], r["day_votes"], r["month_votes"]) for r in learned.learn_day_order(df, "source").collect()}
    assert order == {"eu": (True, 2, 1), "us": (False, 1, 2), "none": (False, 0, 0), "draw": (False, 1, 1), None: (True, 1, 0)}
    got = [str(r["date"]) for r in learned.format_by_source(df, "source").orderBy("k").collect()]
    assert got == [
        "2020-04-13", "2020-04-03", "2020-04-25", "2020-04-14", "2020-04-13", "2020-03-04", "2020-05-06", "2020-12-25", "2020-01-31",
        "2020-03-04", "2020-01-13", "2020-01-13", "2020-02-03", "2020-01-13", "2020-02-01", "None", "None",
    ]


def test_bodies(spark):
    long = " ".join(["word"] * 30)
    links = "".join(f'<li><a class="m" href="/{k}">entry number {k}</a></li>' for k in range(6))
    html = (
        f"<html><title>T</title><body><div><a href='/p'>{long}</a></div><ul>{links}</ul><div>Buy now!</div><h1>A heading of some words</h1><p>{long} <a href='x'>with one link</a></p><p>Short end of it.</p>"
        f"<ul>{links}</ul><div>&copy; someone, some time</div><nav>{long}</nav></body></html>"
    )
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, f"<ul>{links}</ul>"), (5, long)], "id int, html string")
    got = {r["id"]: (r["title"], r["text"]) for r in articles.extract_bodies(df).collect()}
    assert got[1] == ("T", f"A heading of some words\n\n{long} with one link\n\nShort end of it.")
    assert got[2] == (None, None) and got[3] == ("", "") and got[4] == ("", "") and got[5] == ("", long)


def test_bodies_of_pages_leave_menus_and_footers_out(spark):
    pages = views.table(spark, "/root/testdata/sf0.01", "pages")
    both = articles.extract_bodies(pages).join(articles.extract_articles(pages).select("page_id", F.col("text").alias("all")), "page_id").collect()
    kept, ads = 0, 0
    for r in both:
        assert "example.com" not in r["text"].split("\n\n")[-1] and set(r["text"].split("\n\n")) <= {*r["all"].split("\n\n"), ""}
        ads += r["all"].split("\n\n")[0] not in r["text"]
        kept += len(r["text"]) / len(r["all"])
    assert kept / len(both) > 0.9 and ads > 0.5 * len(both)


def test_words_stay_where_small_weights_meet_them(spark):
    rows = spark.createDataFrame([(1, 0, "a a b"), (2, 0, "c"), (2, 1, "b c")], "doc_id long, pos int, sentence string")
    weights = stage(spark.createDataFrame([("a", 1.5), ("b", -1.0), ("", 0.25)], "word string, weight double"), "weights")
    found = learned.score_with_weights(rows, weights, "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["pos"], r["label"]) for r in found.collect()) == [(1, 0, "POSITIVE"), (2, 0, "POSITIVE"), (2, 1, "NEGATIVE")]
    assert "word#" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)
