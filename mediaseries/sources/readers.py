"""Readers. Every reader takes an explicit schema."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from ..functions.dates import parse_datetime
from ..functions.text import nonzero_long
from ..schemas import ARTICLE, MESSAGE
from ..session import stage
from .writers import BATCH

BAD = "_corrupt"


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, or only some of its columns."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The batches of a table with the name of each row's, as ``append_batch`` writes them."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())])).parquet(path)


def _all_asked(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All rows. Parsers skip columns nobody asks for and then miss faults in them; this filter asks, and no optimizer sees through it."""
    return df.filter(F.hash(*[F.col(f"`{n}`").isNull() for n in names]) >= F.lit(-(1 << 31)))


def _options(reader: DataFrameReader, header: bool, multiline: bool) -> DataFrameReader:
    return reader.option("header", header).option("multiLine", multiline).option("escape", '"')


def _first_lines(alone: bool):
    """The first line with anything in it of each file, from parts of files. A part that is one file's ``alone`` is not read on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for file, line in zip(batch.column("file").to_pylist(), batch.column("value")):
                if file not in seen and line.as_py().strip("\ufeff \t\r"):
                    seen.add(file)
                    yield pa.record_batch([pa.array([file]), pa.array([line.as_py()])], ["file", "header"])
                    if alone:
                        return

    return run


def file_headers(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """file, header: the first line with anything in it of every text file under ``path``; files without one have no row.

    Only beginnings of files are read: each part of a file is a partition of its own meanwhile, and a task ends with its first line.
    Should files turn up without a line, the parts are read once more to their ends. ``options`` are those
    of Spark's file readers, such as recursiveFileLookup.
    """
    paths = [path] if isinstance(path, str) else list(path)
    files = spark.read.format("binaryFile").options(**options).load(paths).where("length > 0").select("path").count()
    conf = "spark.sql.files.openCostInBytes"
    before, most = spark.conf.get(conf, None), spark.conf.get("spark.sql.files.maxPartitionBytes")
    most = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(most)
    lines = spark.read.options(**options).text(paths).where("_metadata.file_block_start = 0")
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    spark.conf.set(conf, str(most + 1))
    try:
        found = stage(lines.mapInArrow(_first_lines(True), "file string, header string"), "headers")
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    return found if found.count() == files else stage(lines.mapInArrow(_first_lines(False), "file string, header string"), "headers")


def _names(header: str) -> list[str]:
    """Column names of a header line."""
    return [n.strip() for n in next(csv.reader([header.removeprefix("\ufeff").rstrip("\r")], doublequote=True))]


def _held(names: Sequence[str], schema: T.StructType) -> T.StructType:
    """The columns of a file with this header: those of ``schema`` by name, each once, others as strings under names of their own."""
    types, fields = {f.name: f.dataType for f in schema.fields}, []
    for at, name in enumerate(names):
        known = name in types and all(f.name != name for f in fields)
        fields.append(T.StructField(name if known else f"_{at}_{name}", types[name] if known else T.StringType()))
    return T.StructType(fields)


def _plain(path: str) -> str:
    """A path of a file's metadata, as readers take it: no escapes, and nothing that counts as a pattern."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", unquote(path))


def _csv(spark: SparkSession, path, schema: T.StructType, header: bool, multiline: bool, **options) -> DataFrame:
    """Rows with a column that holds the raw line where a row does not fit the schema.

    A header says what the columns of its file are: they may come in any order, further ones are read over and missing ones are
    NULL. Files of one header are one scan.
    """

    def scan(files, held: T.StructType) -> DataFrame:
        audited = T.StructType([*held.fields, T.StructField(BAD, T.StringType())])
        reader = _options(spark.read.options(**options), header, multiline).schema(audited).option("enforceSchema", True)
        rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).csv(files)
        asked = _all_asked(rows, held.names)
        out = [F.col(f"`{f.name}`") if f.name in held.names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        return asked.select(*out, BAD, F.col("_metadata.file_name").alias("_file"))

    if not header:
        return scan(path, schema)
    found = file_headers(spark, path, **options)
    groups = found.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    options = {}  # they have found the files; from here on files go by their paths
    rows = spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(BAD, T.StringType()), T.StructField("_file", T.StringType())]))
    for k, group in enumerate(groups):
        part = scan([_plain(f) for f in group["files"]], _held(_names(group["header"]), schema))
        rows = part if not k else rows.unionByName(part)
    return rows


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, header: bool = True, multiline: bool = False
) -> DataFrame:
    """CSV rows that fit the schema; malformed ones are dropped, whatever columns a query keeps.

    Every file goes by its own header, in one call: the plan has a scan for each distinct header, united by name. A file
    that has none of the columns gives rows of NULLs; files and folders without a line give no rows; of columns that bear one name
    the first counts. A path that does not exist is an error. With ``multiline`` texts may run over several lines, and a
    file is one task.
    """
    return _csv(spark, path, schema, header, multiline).filter(F.col(BAD).isNull()).drop(BAD, "_file")


def malformed_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, header: bool = True, multiline: bool = False
) -> DataFrame:
    """The rows ``read_csv`` drops: what could be read of them, and the raw ``line``."""
    found = _csv(spark, path, schema, header, multiline).filter(F.col(BAD).isNotNull())
    return found.withColumnRenamed(BAD, "line").drop("_file")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The headerless files of crawled articles. A text may run over several lines, so a file is one task."""
    return read_csv(spark, path, ARTICLE, header=False, multiline=True)


def find_files(
    spark: SparkSession, root: str, names: Sequence[str], schema: T.StructType, header: bool = True, multiline: bool = False
) -> DataFrame:
    """CSV rows of the named files, wherever they lie under ``root``, with the file each came from.

    The names prune files while they are listed; rows that do not fit the schema are dropped.
    """
    plain = [re.sub(r"([\\{}\[\]*?,])", r"\\\1", n) for n in names]
    found = _csv(spark, root, schema, header, multiline, recursiveFileLookup=True, pathGlobFilter="{" + ",".join(plain) + "}")
    return found.filter(F.col(BAD).isNull()).drop(BAD).withColumnRenamed("_file", "file")


def _messages(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    audited = T.StructType([*MESSAGE.fields, T.StructField(BAD, T.StringType())])
    return spark.read.schema(audited).option("multiLine", not lines).option("columnNameOfCorruptRecord", BAD).json(path)


def read_messages(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Exported chat messages as nested rows; what is no message goes to ``malformed_messages``.

    ``lines=True`` reads one message per line, which Spark splits at any size.
    ``lines=False`` reads files that each hold one JSON array; such a file is one task.
    """
    found = _messages(spark, path, lines)
    return _all_asked(found, MESSAGE.names).filter(F.col(BAD).isNull()).drop(BAD)


def malformed_messages(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """The raw ``line`` (or file) of what ``read_messages`` leaves out."""
    found = _messages(spark, path, lines)
    return _all_asked(found, MESSAGE.names).filter(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def message_rows(messages: DataFrame) -> DataFrame:
    """Messages of users, flat. Counters of zero are missing values; nothing aborts on a missing field."""
    wanted = (F.col("_") == "Message") & (F.col("from_id._") == "PeerUser")
    at = parse_datetime(F.col("date"))
    return messages.filter(wanted).select(
        F.col("id").alias("message_id"),
        at.alias("datetime"),
        F.to_date(at).alias("date"),
        F.col("message").alias("text"),
        F.col("from_id.user_id").alias("user_id"),
        nonzero_long("views").alias("views"),
        nonzero_long("forwards").alias("forwards"),
    )


def incomplete_messages(messages: DataFrame) -> DataFrame:
    """Messages that lack a field every one of their kind should have."""
    missing = F.col("from_id._").isNull()
    for field in ("id", "date", "message"):
        missing = missing | F.col(field).isNull()
    nameless = (F.col("from_id._") == "PeerUser") & F.col("from_id.user_id").isNull()
    return messages.filter(F.col("_").isNull() | ((F.col("_") == "Message") & (missing | nameless)))
