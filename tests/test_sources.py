import datetime as dt
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from mediaseries import schemas, session
from mediaseries.operators import common
from mediaseries.sources import readers, writers

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("v", T.DoubleType())])


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_drops_malformed_whatever_is_selected(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,v\n1,"a, ""b""",1.5\nx,b,2\n3,c,zz\n4,d\n5,e,5,6\n6,,\n')
    good = readers.read_csv(spark, path, SCHEMA)
    assert sorted(tuple(r) for r in good.collect()) == [(1, 'a, "b"', 1.5), (6, None, None)]
    assert good.count() == 2 and good.select("name").count() == 2
    bad = readers.malformed_csv(spark, path, SCHEMA)
    assert sorted(r.line for r in bad.select("line").collect()) == ["3,c,zz", "4,d", "5,e,5,6", "x,b,2"]


def test_rows_of_strings_can_be_counted(spark, tmp_path):
    texts = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    path = write(tmp_path / "a.csv", "a,b\n1,2\n3\n4,5,6\n7,8\n")
    assert readers.read_csv(spark, path, texts).count() == 2 and readers.malformed_csv(spark, path, texts).count() == 2


def test_found_by_name(spark, tmp_path):
    for name in ("x/wanted.csv", "y/z/other.csv", "y/second.csv"):
        write(tmp_path / name, f"id,name,v\n1,{name},2\n")
    got = readers.find_files(spark, str(tmp_path), ["wanted.csv", "second.csv"], SCHEMA).collect()
    assert sorted(r.file for r in got) == ["second.csv", "wanted.csv"]


def message(**over):
    base = {
        "_": "Message", "id": 1, "date": "2020-01-02T03:04:05+00:00", "message": "hi\nyou",
        "from_id": {"_": "PeerUser", "user_id": 7}, "views": 0, "forwards": 3,
    }
    return {**base, **over}


@pytest.mark.parametrize("lines", [True, False])
def test_messages(spark, tmp_path, lines):
    data = [
        message(),
        message(id=2, _="MessageService"),
        message(id=3, from_id={"_": "PeerChannel", "channel_id": 1}),
        message(id=4, views=9, forwards=None),
        {"_": "Message", "id": 5},
    ]
    text = "\n".join(json.dumps(m) for m in data) if lines else json.dumps(data)
    raw = readers.read_messages(spark, write(tmp_path / "m.json", text), lines)
    got = sorted(tuple(r) for r in readers.message_rows(raw).collect())
    assert [(r[0], r[2:]) for r in got] == [
        (1, (dt.date(2020, 1, 2), "hi\nyou", 7, None, 3)),
        (4, (dt.date(2020, 1, 2), "hi\nyou", 7, 9, None)),
    ]
    assert [r.id for r in readers.incomplete_messages(raw).collect()] == [5]


def test_headerless_append(spark, tmp_path):
    path = str(tmp_path / "articles")
    row = spark.createDataFrame([("t", "m", "d", "x", "l", "i", 'line one\nline "two", end', None)], schemas.ARTICLE)
    writers.append_csv(row, path)
    writers.append_csv(row, path)
    got = [tuple(r) for r in readers.read_articles(spark, path).collect()]
    assert got == [tuple(row.first())] * 2


def test_view_export_and_json(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), '"POSITIVE"', 3, 0.5)], schemas.DAILY_INFO)
    writers.export_view(df, "exported", str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), schemas.DAILY_INFO).collect() == df.collect()
    assert spark.table("exported").count() == 1
    writers.write_chart_data(df, str(tmp_path / "json"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "json")).collect() == df.collect()


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(10).withColumnRenamed("id", "k").selectExpr("k", "k * 2 AS v")
    writers.write_version(df, path)
    with pytest.raises(AnalysisException):
        writers.write_version(df, path)
    writers.append_rows(df, path)
    assert readers.read_table(spark, path, ["v"]).count() == 20
    got = [tuple(r) for r in common.describe_columns(df).orderBy("position").collect()]
    assert got == [(0, "k", "bigint"), (1, "v", "bigint")]


def test_csv_columns_go_by_their_names(spark, tmp_path):
    path = write(tmp_path / "a.csv", "v,extra,id\n1.5,x,1\nbad,y,2\n2.5,z,3\n")
    assert sorted(tuple(r) for r in readers.read_csv(spark, path, SCHEMA).collect()) == [(1, None, 1.5), (3, None, 2.5)]
    assert [r.line for r in readers.malformed_csv(spark, path, SCHEMA).collect()] == ["bad,y,2"]
    other = write(tmp_path / "b.csv", "name,id\nn,7\n")
    both = readers.read_csv(spark, path, SCHEMA).unionByName(readers.read_csv(spark, other, SCHEMA))
    assert sorted((tuple(r) for r in both.collect()), key=str) == [(1, None, 1.5), (3, None, 2.5), (7, "n", None)]


def test_every_file_goes_by_its_own_header(spark, tmp_path):
    root = tmp_path / "own headers"
    write(root / "1.csv", "id,name,v\n1,a,1\nx,bad,1\n")
    write(root / "2 {x}.csv", "name,id,v\nb,2,2\n")
    write(root / "3.csv", '\ufeff"v","extra, one",id,id\r\n3,"x,y",3,33\r\n')
    write(root / "4[a].csv", "unknown,others\np,q\n")
    write(root / "5.csv", "")
    write(root / "6.csv", "\n\nid\n6\n")
    write(root / "7.csv", "name,id,v\n")
    want = [(1, "a", 1.0), (2, "b", 2.0), (3, None, 3.0), (6, None, None), (None, None, None)]
    for path in (str(root), [str(root / "1.csv"), str(root / "[2-7]*")]):
        assert sorted(map(str, map(tuple, readers.read_csv(spark, path, SCHEMA).collect()))) == sorted(map(str, want))
    assert [r.line for r in readers.malformed_csv(spark, str(root), SCHEMA).collect()] == ["x,bad,1"]
    headers = {r["file"].rsplit("/")[-1]: r["header"] for r in readers.file_headers(spark, str(root)).collect()}
    assert len(headers) == 6 and headers["1.csv"] == "id,name,v" and headers["6.csv"] == "id"
    plan = readers.read_csv(spark, str(root), SCHEMA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 5  # a scan for each distinct header


def test_headers_of_files_that_share_a_partition(spark, tmp_path):
    """Also where the session packs files together all the same, every file's header is found."""
    for k in range(30):
        write(tmp_path / f"{k}.csv", f"id,c{k % 3}\n{k},x\n")
    lines = spark.read.text(str(tmp_path)).selectExpr("value", "_metadata.file_path AS file").coalesce(1)
    assert lines.mapInArrow(readers._first_lines(False), "file string, header string").count() == 30
    assert readers.file_headers(spark, str(tmp_path)).count() == 30
    assert sorted(r.id for r in readers.read_csv(spark, str(tmp_path), SCHEMA).collect()) == list(range(30))


def test_large_files_are_not_read_for_their_headers(spark, tmp_path):
    spark.range(400_000).selectExpr("id", "id % 7 AS v", "'some name' AS name").coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    assert [r["header"] for r in readers.file_headers(spark, str(tmp_path / "t")).collect()] == ["id,v,name"]
    got = readers.read_csv(spark, str(tmp_path / "t"), SCHEMA)
    assert got.count() == 400_000 and got.where("v is null or name <> 'some name'").count() == 0


def test_folders_without_lines(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert readers.read_csv(spark, str(tmp_path / "none"), SCHEMA).collect() == []
    write(tmp_path / "blank" / "1.csv", "\n \n")
    write(tmp_path / "blank" / "2.csv", "")
    for found in (readers.read_csv(spark, str(tmp_path / "blank"), SCHEMA), readers.find_files(spark, str(tmp_path), ["absent.csv"], SCHEMA)):
        assert found.collect() == []
    with pytest.raises(AnalysisException):
        readers.read_csv(spark, str(tmp_path / "absent"), SCHEMA)


def test_csv_texts_over_several_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'line one\nline "two"\r\nthree, ', 0.5), (2, None, None)], SCHEMA)
    writers.export_view(df, "lines", str(tmp_path / "t"))
    got = readers.read_csv(spark, str(tmp_path / "t"), SCHEMA, multiline=True).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in df.collect())


def test_found_files_drop_malformed(spark, tmp_path):
    write(tmp_path / "x" / "one.csv", "v,id,name\n2,1,a\nzz,2,b\n")
    assert [tuple(r)[:3] for r in readers.find_files(spark, str(tmp_path), ["one.csv"], SCHEMA).collect()] == [(1, "a", 2.0)]


def test_malformed_messages(spark, tmp_path):
    path = write(tmp_path / "m.json", json.dumps(message()) + "\n{nonsense\n")
    assert [r.line for r in readers.malformed_messages(spark, path).collect()] == ["{nonsense"]
    assert readers.read_messages(spark, path).count() == 1


def test_stage_uses_the_named_folder(spark, tmp_path):
    old = spark.conf.get("spark.checkpoint.dir", None)
    staged = session.stage(spark.range(5), "numbers")
    assert staged.count() == 5
    folder = session.shared_dir(spark)
    assert folder
    if old:
        assert folder == old.rstrip("/")
    assert all(folder.split(":")[-1] in f for f in staged.inputFiles())


def test_staged_tables_go_with_their_scope(spark):
    with session.staging(spark):
        path = session.stage(spark.range(5), "numbers").inputFiles()[0]
        assert spark.read.parquet(path).count() >= 0
    with pytest.raises(AnalysisException):
        spark.read.parquet(path).count()
