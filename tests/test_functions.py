import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from mediaseries.functions import dates, scores, text


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_strip_quotes_and_parse_text(spark):
    assert column(spark, ['"POSITIVE"', 'a"b', None], text.strip_quotes) == ["POSITIVE", "ab", None]
    assert column(spark, [' \t"x y"　\n', "\x1fz"], text.parse_text) == ["x y", "z"]
    assert column(spark, ["None", "none", None], text.none_to_null) == [None, "none", None]


WORDS = ["", "one", " two  words ", "a b c", "x\x1cy\x1fz", "tab\tnew\nline\x0bv\x0cf\x85n", "﻿bom ​zero", None]


def test_word_count_is_pythons_split(spark):
    assert column(spark, WORDS, text.word_count) == [None if w is None else len(w.split()) for w in WORDS]


def test_word_count_any_text(spark):
    @settings(max_examples=5, deadline=None)
    @given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), min_size=20, max_size=40))
    def check(values):
        assert column(spark, values, text.word_count) == [len(v.split()) for v in values]
        joined = [v + " " + v for v in values]
        assert column(spark, joined, text.word_count) == [2 * len(v.split()) for v in values]

    check()


def test_clean_html_order_and_dots(spark):
    raw = [
        '<a href="x">here</a> and <a>there</a>',
        "<a href>over\ntwo</a>",  # no closing tag on the line: newlines go last
        "<article>kept</article> <a>x</a>",  # opens on any tag that starts with a
        "&gt;&#x27;&quot;&#x2F;<p></i>&#62;<i>",
        "<a>cr\rlf</a>",
    ]
    assert column(spark, raw, text.clean_html) == [
        "Link. and Link.",
        "<a href>overtwo</a>",
        "Link.",
        "'\"   ",
        "Link.",
    ]


def test_split_sentences(spark):
    raw = ['One. Two! "Three?" four', "a.b 3.5 x", "  ", "", "End.) Next", "Wait... what?! Yes."]
    assert column(spark, raw, text.split_sentences) == [
        ["One.", "Two!", '"Three?"', "four"],
        ["a.b 3.5 x"],
        [],
        [],
        ["End.)", "Next"],
        ["Wait...", "what?!", "Yes."],
    ]


def test_counters_and_ids(spark):
    assert column(spark, ["0", "7", "x", None], text.nonzero_long) == [None, 7, None, None]
    assert column(spark, ["12", "1.5", "x", None], text.long_or_null)[0::2] == [12, None]


def utc(*parts):
    return dt.datetime(*parts, tzinfo=dt.timezone.utc)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("0", utc(1970, 1, 1)),
        ("20180101", utc(1970, 8, 22, 13, 35, 1)),  # any number is seconds, tried first
        ('"1.5e9"', utc(2017, 7, 14, 2, 40)),
        ("-1.25", utc(1969, 12, 31, 23, 59, 58, 750000)),
        ("1e30", None),
        ("12d", None),
        ("nan", None),
        ("03:05 PM - 7 Jan 2018", utc(2018, 1, 7, 15, 5)),
        ("3:05 pm - 07 jan 2018", utc(2018, 1, 7, 15, 5)),
        ("2018-01-07", utc(2018, 1, 7)),
        ("2018-1-7", utc(2018, 1, 7)),
        (' "1.5e9" ', utc(2017, 7, 14, 2, 40)),
        (" 2018-01-07\t", utc(2018, 1, 7)),
        ("2018-01-07 10:11:12", utc(2018, 1, 7, 10, 11, 12)),
        ("2018-01-07T10:11:12+02:00", utc(2018, 1, 7, 8, 11, 12)),
        ("2018-01-07T10:11:12Z", utc(2018, 1, 7, 10, 11, 12)),
        ("2018-01-07 10:11:12+00:00", utc(2018, 1, 7, 10, 11, 12)),
        ("2018-01-07 10:11", utc(2018, 1, 7, 10, 11)),
        ("2018/01/07 10:11", utc(2018, 1, 7, 10, 11)),
        ("1/7/2018 10:11", utc(2018, 1, 7, 10, 11)),
        ("1/7/2018 10:11 PM", utc(2018, 1, 7, 22, 11)),
        ("Sun Jan 07 10:11:12 +0000 2018", utc(2018, 1, 7, 10, 11, 12)),
        ("Sun, 07 Jan 2018 10:11:12 +0100", utc(2018, 1, 7, 9, 11, 12)),
        ("Jan 7, 2018", utc(2018, 1, 7)),
        ("January 7, 2018", utc(2018, 1, 7)),
        ("2018-13-45", None),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_datetime(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string").select(F.unix_micros(dates.parse_datetime("v")).alias("us"))
    got = df.first().us
    assert got == (None if want is None else round(want.timestamp() * 1e6))


def test_standard_format(spark):
    assert column(spark, ["2018-01-07 10:11:12.5", "2018-01-07", None], dates.has_standard_format) == [True, False, None]


def test_scores(spark):
    rows = [("POSITIVE", 0.5), ("NEGATIVE", 0.5), ("NEUTRAL", 0.0), ("NEUTRAL", 0.2), ("POSITIVE", None)]
    df = spark.createDataFrame(rows, "label string, conf double").withColumn("s", scores.signed_score("label", "conf"))
    got = [r.s for r in df.collect()]
    assert got == [0.5, -0.5, 0.0, -0.2, None]
    assert str(got[2]) == "0.0"
    labels = column(spark, [1.0, 0.0, -1.0, None], scores.score_label, "double")
    assert labels == ["POSITIVE", "NEUTRAL", "NEGATIVE", None]
    two = column(spark, [1.0, 0.0, -1.0], lambda c: scores.score_label(c, neutral=False), "double")
    assert two == ["POSITIVE", "NEGATIVE", "NEGATIVE"]


def test_rounding_and_scaling(spark):
    got = column(spark, [0.125, 0.375, 2.5, 0.1 + 0.2, -0.125], lambda c: scores.round_even(c, 2), "double")
    assert got == [0.12, 0.38, 2.5, 0.3, -0.12]
    flat = column(spark, [1.0], lambda c: scores.normalized(c, F.lit(2.0), F.lit(2.0)), "double")
    assert flat == [None]


def test_sentences_of_a_text_that_holds_the_mark(spark):
    assert column(spark, ["One￿ two. Three", None], text.split_sentences, "string") == [["One two.", "Three"], None]
