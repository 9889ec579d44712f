import pytest
from pyspark.sql import types as T

from mediaseries import schemas
from mediaseries.operators import common, merge

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("likes", T.LongType())]
)


def table(spark, rows, columns="n int, id long, text string, lang string, likes long"):
    return spark.createDataFrame(rows, columns)


@pytest.fixture
def sources(spark):
    master = table(spark, [(0, 1, "a", None, 3), (1, 2, "b", "en", None), (2, 9, "a", "fr", 8), (3, None, "z", None, 1)])
    # no likes column, a quoted text, a text None, unknown columns, repeats within one batch
    second = table(
        spark,
        [(0, 1, '"a"', "None", "x"), (1, 3, "c", "", "y"), (2, 3, "c", "de", "y"), (3, None, None, "es", "y"), (4, None, None, "it", "y")],
        "n int, id long, text string, lang string, extra string",
    )
    third = table(spark, [(0, 2, "b", "pt", 5), (1, 3, "c", "nl", 6)])
    return [master, second, third]


def rows(df, by):
    return sorted(df.collect(), key=lambda r: tuple((r[c] is not None, r[c]) for c in by))


def test_by_text(sources):
    got = merge.merge_upsert(sources, "text", SCHEMA, ["n"])
    assert [tuple(r) for r in rows(got, ["text", "lang"])] == [
        (None, None, "es", None),  # rows without the key match nothing
        (None, None, "it", None),
        (1, "a", "fr", 3),
        (2, "b", "en", 5),
        (3, "c", "", 6),
        (None, "z", None, 1),
    ]


def test_blank_yields(sources):
    got = merge.merge_upsert(sources, "text", SCHEMA, ["n"], blank_is_missing=True)
    assert {r.text: r.lang for r in got.collect()}["c"] == "de"
    only = merge.merge_upsert([sources[1].limit(2)], "text", SCHEMA, ["n"], blank_is_missing=True)
    assert {r.text: r.lang for r in only.collect()}["c"] == ""


def test_by_id(sources):
    got = merge.merge_upsert(sources, "id", SCHEMA, ["n"])
    assert [tuple(r) for r in rows(got, ["id", "text", "lang"]) if r.id is not None] == [
        (1, "a", None, 3),
        (2, "b", "en", 5),
        (3, "c", "", 6),
        (9, "a", "fr", 8),
    ]
    assert sum(r.id is None for r in got.collect()) == 3


def test_idempotent(sources):
    once = merge.merge_upsert(sources, "text", SCHEMA, ["n"])
    again = merge.merge_upsert([once, *[s.drop("n") for s in sources]], "text", SCHEMA, ["text"])
    keyed = [tuple(r) for r in rows(once, ["text", "lang"]) if r.text is not None]
    assert [tuple(r) for r in rows(again, ["text", "lang"]) if r.text is not None] == keyed


def test_folding_in_one_pass_is_folding_in_turn(sources):
    whole = merge.merge_upsert(sources, "text", SCHEMA, ["n"])
    first = merge.merge_upsert(sources[:2], "text", SCHEMA, ["n"]).selectExpr("0 AS n", "*")
    turn = merge.merge_upsert([first, sources[2]], "text", SCHEMA, ["n"])
    by = ["text", "lang"]
    assert rows(whole, by) == rows(turn, by)


def test_rows_without_key_are_never_lost(spark):
    same = table(spark, [(0, None, None, "en", 1)] * 3 + [(0, None, "x", "en", 1)] * 2)
    got = merge.merge_upsert([same], "text", SCHEMA, ["n"])
    assert sorted((r.text or "", r.lang, r.likes) for r in got.collect()) == [("", "en", 1)] * 3 + [("x", "en", 1)]
    assert tuple(merge.merge_report([same], "text", SCHEMA, ["n"]).first()) == (0, 4, 1)


def test_report(sources):
    got = merge.merge_report(sources, "text", SCHEMA, ["n"])
    assert [tuple(r) for r in rows(got, ["source"])] == [(0, 3, 1), (1, 3, 2), (2, 0, 2)]


def test_align(spark):
    df = table(spark, [("7", "x", "oops")], "id string, text string, other string")
    got = common.align(df, schemas.POST)
    assert got.columns == schemas.POST.names and len(got.columns) == 37
    row = got.first()
    assert (row.id, row.text, row.username) == (7, "x", None)
    bad = common.align(table(spark, [("7x",)], "id string"), schemas.POST).first()
    assert bad.id is None


def test_hot_text_is_reduced_where_it_lies(spark):
    """A third of all rows share one text; they leave each map task as one row."""
    df = spark.range(0, 30000, 1, 6).selectExpr(
        "id AS n", "id", "CASE WHEN id % 3 = 0 THEN 'spam' ELSE concat('t', id) END AS text", "IF(id = 29997, 'en', NULL) AS lang", "id AS likes"
    )
    got = merge.merge_upsert([df], "text", SCHEMA, ["n"])
    assert got.count() == 20001
    assert tuple(got.filter("text = 'spam'").first()) == (0, "spam", "en", 0)


def test_the_text_none_keeps_its_key(spark):
    rows = spark.createDataFrame([("None", "None", 0), ("None", "x", 1), (None, "None", 2), (None, "None", 3)], "text string, lang string, n int")
    wanted = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    got = sorted((tuple(r) for r in merge.merge_upsert([rows], "text", wanted, ["n"]).collect()), key=str)
    assert got == [("None", "x"), (None, None), (None, None)]
    kept = sorted((tuple(r) for r in merge.merge_upsert([rows], "text", wanted, ["n"], none_is_missing=[False]).collect()), key=str)
    assert kept == [("None", "None"), (None, "None"), (None, "None")]
