"""A standing master table: bucketed by its key, so that a merge moves only what is new.

A version is a folder of bucket files. A merge folds its batch by key, brings that to the master's buckets and joins
there; the master itself is read where it lies, without an exchange, and what comes out is already dealt by bucket when it is written
as the next version. Rows without a key match nothing: each merge puts its own in a folder beside the
buckets. A version counts once its mark is written, so a merge that fails leaves the master as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.merge import fill_gaps, merge_upsert
from ..session import hadoop_path, stage


class StandingMaster:
    """A master under ``path``, with one row per ``key`` and the columns of ``schema``.

    ``buckets`` is fixed with the first version: take the master's size at its largest by that of a task. The rules for missing
    values are those of ``merge_upsert``, and any number of merges gives the rows that one pass over all sources gives.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: str,
        schema: T.StructType,
        buckets: int = 200,
        blank_is_missing: bool = False,
        trim: bool = False,
        none_is_missing: bool = True,
    ):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets
        self.blank_is_missing, self.trim, self.none_is_missing = blank_is_missing, trim, none_is_missing

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/v{version:06d}"

    def _versions(self, kind: str) -> list[int]:
        store, where = hadoop_path(self.spark, f"{self.path}/{kind}")
        return sorted(int(f.getPath().getName()[1:]) for f in store.listStatus(where)) if store.exists(where) else []

    def version(self) -> int | None:
        """The number of the latest finished version, None before the first."""
        return max(self._versions("done"), default=None)

    def _name(self, version: int) -> str:
        return f"master_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_v{version:06d}"

    def keyed(self, version: int | None = None) -> DataFrame:
        """The rows with a key, as a bucketed table. A session that does not know it yet registers the files."""
        version = self.version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        if not self.spark.catalog.tableExists(self._name(version)):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(
                f"CREATE TABLE {self._name(version)} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self._folder('keyed', version)}'"
            )
        return self.spark.table(self._name(version))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, those without a key too."""
        version = self.version() if version is None else version
        rows = self.keyed(version)
        lone = [self._folder("lone", v) for v in self._versions("done") if version is not None and v <= version]
        return rows.unionByName(self.spark.read.schema(self.schema).parquet(*lone)) if lone else rows

    def merged(self, batch: DataFrame, version: int | None = None) -> DataFrame:
        """The master's keyed rows with a folded batch: gaps are filled, new keys added; _known says whether the master had the key, _met whether the batch did."""
        strings = {f.name for f in self.schema.fields if isinstance(f.dataType, T.StringType)}
        old = self.keyed(version).withColumn("_known", F.lit(True)).alias("m")
        new = batch.where(F.col(self.key).isNotNull()).withColumn("_met", F.lit(True)).alias("i")
        joined = old.join(new, F.col(f"m.{self.key}") == F.col(f"i.{self.key}"), "full_outer")
        filled = [
            fill_gaps(F.col(f"m.`{f.name}`"), F.col(f"i.`{f.name}`"), self.blank_is_missing and f.name in strings).alias(f.name)
            for f in self.schema.fields
        ]
        return joined.select(*filled, F.col("_known").isNotNull().alias("_known"), F.col("_met").isNotNull().alias("_met"))

    def merge(self, sources: Sequence[DataFrame], order: Sequence[str]) -> dict[str, int]:
        """Fold ``sources``, earlier ones first, behind the master, and write the next version.

        Returns how many keys were inserted and how many known ones were met, and how many rows had no key. The
        counts are taken while the version is written.
        """
        now = self.version()
        batch = merge_upsert(sources, self.key, self.schema, order, self.blank_is_missing, self.trim, self.none_is_missing)
        batch = stage(batch, "master-batch")
        following = max([*self._versions("keyed"), *self._versions("lone"), 0]) + 1
        seen, lone = Observation(), Observation()
        rows = self.merged(batch, now).observe(
            seen, F.count_if(~F.col("_known")).alias("inserted"), F.count_if(F.col("_known") & F.col("_met")).alias("updated")
        )
        writer = rows.select(*self.schema.names).write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        writer.option("path", self._folder("keyed", following)).saveAsTable(self._name(following))
        batch.where(F.col(self.key).isNull()).observe(lone, F.count("*").alias("keyless")).write.parquet(self._folder("lone", following))
        store, mark = hadoop_path(self.spark, self._folder("done", following))
        store.create(mark).close()
        return {**seen.get, **lone.get}

    def drop(self, version: int) -> None:
        """Remove the bucket files of an older version. Its rows without a key belong to later ones too, and stay."""
        if version == self.version():
            raise ValueError("the latest version stays")
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(version)}")
        store, where = hadoop_path(self.spark, self._folder("keyed", version))
        store.delete(where, True)
