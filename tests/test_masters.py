"""The standing master, tables rewritten where rows wait, and batches that can be repeated."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from mediaseries.operators import enrich
from mediaseries.operators.merge import merge_upsert
from mediaseries.sources import readers, writers
from mediaseries.sources.masters import StandingMaster

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("likes", T.LongType())]
)


def tables(spark, seed, count=4, rows=40):
    rng = random.Random(seed)
    return [
        spark.createDataFrame(
            [
                (n, rng.choice([None, *range(12)]), rng.choice([None, "a", "b ", '"c"', "None", ""]), rng.choice([None, "", "en", "None"]), rng.choice([None, 1, 2]))
                for n in range(rows)
            ],
            "n int, id long, text string, lang string, likes long",
        )
        for _ in range(count)
    ]


def sorted_rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("key", ["id", "text"])
@pytest.mark.parametrize("blank", [False, True])
def test_many_merges_give_the_rows_of_one_pass(spark, tmp_path, key, blank):
    sources = tables(spark, 5)
    master = StandingMaster(spark, str(tmp_path / "m"), key, SCHEMA, 4, blank_is_missing=blank, trim=True)
    assert master.version() is None and master.read().count() == 0
    master.merge(sources[:1], ["n"])
    master.merge(sources[1:3], ["n"])
    counts = master.merge(sources[3:], ["n"])
    want = merge_upsert(sources, key, SCHEMA, ["n"], blank, True)
    assert master.version() == 3 and sorted_rows(master.read()) == sorted_rows(want)
    before = merge_upsert(sources[:3], key, SCHEMA, ["n"], blank, True)
    last = merge_upsert(sources[3:], key, SCHEMA, ["n"], blank, True).where(F.col(key).isNotNull())
    known = {r[key] for r in before.collect()}
    assert counts["updated"] == sum(r[key] in known for r in last.collect()) and counts["inserted"] + counts["updated"] == last.count()
    assert counts["keyless"] == merge_upsert(sources[3:], key, SCHEMA, ["n"], blank, True).where(F.col(key).isNull()).count()
    assert sorted_rows(master.read(2)) == sorted_rows(before)


def test_a_merge_moves_only_its_batch(spark, tmp_path):
    first, second, *_ = tables(spark, 6)
    master = StandingMaster(spark, str(tmp_path / "m"), "text", SCHEMA, 4)
    master.merge([first], ["n"])
    batch = merge_upsert([second], "text", SCHEMA, ["n"])
    physical = master.merged(batch)._jdf.queryExecution().executedPlan().toString()
    old, new = physical.split("FullOuter", 1)[1].split("Exchange", 1)
    assert "Bucketed: true" in old and "SelectedBucketsCount: 4 out of 4" in old  # the master's side ends before any exchange
    assert "Bucketed" not in new and "hashpartitioning(text" in new


def test_another_session_registers_the_files(spark, tmp_path):
    sources = tables(spark, 7)
    path = str(tmp_path / "m")
    master = StandingMaster(spark, path, "id", SCHEMA, 4)
    master.merge(sources[:2], ["n"])
    rows = sorted_rows(master.read())
    spark.sql(f"DROP TABLE {master._name(1)}")
    again = StandingMaster(spark, path, "id", SCHEMA, 4)
    assert sorted_rows(again.read()) == rows
    assert "Bucketed: true" in again.merged(again.keyed())._jdf.queryExecution().executedPlan().toString()
    again.merge(sources[2:], ["n"])
    assert sorted_rows(again.read()) == sorted_rows(merge_upsert(sources, "id", SCHEMA, ["n"]))


def test_a_merge_that_fails_leaves_the_master(spark, tmp_path):
    first, second, *_ = tables(spark, 8)
    master = StandingMaster(spark, str(tmp_path / "m"), "id", SCHEMA, 4)
    master.merge([first], ["n"])
    rows = sorted_rows(master.read())
    fails = second.withColumn("lang", F.raise_error(F.lit("no source")).cast("string"))
    with pytest.raises(Exception):
        master.merge([fails], ["n"])
    (tmp_path / "m" / "keyed" / "v000002").mkdir()  # what a merge that ended half-way leaves
    assert master.version() == 1 and sorted_rows(master.read()) == rows
    master.merge([second], ["n"])
    assert master.version() == 3 and sorted_rows(master.read()) == sorted_rows(merge_upsert([first, second], "id", SCHEMA, ["n"]))
    with pytest.raises(ValueError):
        master.drop(3)
    master.drop(1)
    assert not (tmp_path / "m" / "keyed" / "v000001").exists() and sorted_rows(master.read()) == sorted_rows(merge_upsert([first, second], "id", SCHEMA, ["n"]))


def test_an_empty_batch(spark, tmp_path):
    first, *_ = tables(spark, 9)
    master = StandingMaster(spark, str(tmp_path / "m"), "id", SCHEMA, 4)
    assert master.merge([first.limit(0)], ["n"]) == {"inserted": 0, "updated": 0, "keyless": 0}
    master.merge([first], ["n"])
    assert master.merge([first.limit(0)], ["n"])["inserted"] == 0
    assert sorted_rows(master.read()) == sorted_rows(merge_upsert([first], "id", SCHEMA, ["n"]))


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_only_partitions_with_pending_rows_are_written(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(k, f"w {'x ' * k}", p, None if p in ("late", None) and k % 2 else -1) for k, p in enumerate(["done", "late", None, "odd/ = name"] * 6)]
    spark.createDataFrame(rows, "k int, text string, part string, words int").write.partitionBy("part").parquet(str(path))
    before = files(path)
    got = writers.rewrite_pending(spark, str(path), ["part"], F.col("words").isNull(), enrich.count_words).collect()
    assert {(r["part"], r["waiting"]) for r in got} == {("late", 6)}
    after = files(path)
    for name in before:
        assert (name in after and after[name] == before[name]) == (not name.startswith("part=late"))
    want = [(k, t, p, -1 if n is not None else k + 1) for k, t, p, n in rows]
    assert sorted_rows(readers.read_table(spark, str(path), ["k", "text", "part", "words"])) == sorted(map(str, want))
    assert writers.rewrite_pending(spark, str(path), ["part"], F.col("words").isNull(), enrich.count_words).count() == 0
    assert files(path) == after


def test_pending_rows_of_the_null_partition(spark, tmp_path):
    path = tmp_path / "t"
    rows = [(k, "a b", k % 2 or None, "x", None if k == 4 else 7) for k in range(8)]
    spark.createDataFrame(rows, "k int, text string, p int, q string, words int").write.partitionBy("p", "q").parquet(str(path))
    before = files(path)
    writers.rewrite_pending(spark, str(path), ["p", "q"], F.col("words").isNull(), enrich.count_words)
    assert {n for n in before if n in files(path)} == {n for n in before if n.startswith("p=1")}
    got = {r["k"]: (r["p"], r["words"]) for r in readers.read_table(spark, str(path)).collect()}
    assert got == {k: (k % 2 or None, 2 if k == 4 else 7) for k in range(8)}
    with pytest.raises(ValueError):
        lost = spark.range(1).select(F.lit(None).cast("int").alias("words"), F.lit(1).alias("p"))
        lost.write.partitionBy("p").parquet(str(tmp_path / "u"))
        writers.rewrite_pending(spark, str(tmp_path / "u"), ["p"], F.col("words").isNull(), lambda df: df.drop("words"))


def test_partitions_without_pending_rows_are_pruned(spark, tmp_path):
    """The scan behind the rewriting leaves out the partitions it does not need while it runs."""
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 10 AS part", "if(id = 7, null, 1) AS words").write.partitionBy("part").parquet(path)
    seen = []

    def fill(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df.fillna(0, ["words"])

    writers.rewrite_pending(spark, path, ["part"], F.col("words").isNull(), fill)
    assert "dynamicpruning" in seen[0]


def test_batches_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "t")
    one, two = spark.range(5), spark.range(10, 13)
    for _ in range(2):
        writers.append_batch(one, path, "2020-01-01")
        writers.append_batch(two, path, "2")
    kept = files(tmp_path / "t")
    writers.append_batch(two.limit(1), path, "2")
    got = sorted(tuple(r) for r in readers.read_batches(spark, path, one.schema).collect())
    assert got == [(k, "2020-01-01") for k in range(5)] + [(10, "2")]
    assert {n: t for n, t in files(tmp_path / "t").items() if "2020" in n} == {n: t for n, t in kept.items() if "2020" in n}
    writers.append_batch(two.limit(0), path, "2")
    assert readers.read_batches(spark, path, one.schema).count() == 5
    for name in ("a/b", "", "x=1"):
        with pytest.raises(ValueError):
            writers.append_batch(one, path, name)
    with pytest.raises(ValueError):
        writers.append_batch(one.withColumn("batch", F.lit(1)), path, "b")


def test_a_batch_that_fails_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append_batch(spark.range(5), path, "b")
    with pytest.raises(Exception):
        writers.append_batch(spark.range(5).select(F.raise_error(F.lit("no rows")).cast("long").alias("id")), path, "b")
    assert readers.read_batches(spark, path, spark.range(1).schema).count() == 5
    writers.append_batch(spark.range(2), path, "b")
    assert readers.read_batches(spark, path, spark.range(1).schema).count() == 2
