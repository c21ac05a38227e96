"""A stored table that takes change sets bucket by bucket, each batch once.

Rows lie in buckets of their key.  A change set rewrites the buckets it touches into a new
version; the log then names the version of each of them, so readers see all of a batch or
nothing, buckets that no key falls into keep their files, and a batch that is replayed
after a failure is recognised by its stream and epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.changeset import apply_change_set
from larder.session import cut_lineage

LOG = "version long, stream string, epoch long, bucket int, n long"


class StoredTable:
    """``key`` is the column whose buckets (``buckets`` of them, fixed at creation) hold the rows."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.path, self.key = spark, path, key

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str = "id", buckets: int = 64) -> StoredTable:
        table = cls(rows.sparkSession, path, key)
        rows.limit(0).write.parquet(f"{path}/shape")
        rows.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/buckets")
        table._write(rows, list(range(buckets)), "", -1, buckets)
        return table

    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/buckets").first()["buckets"]

    def bucket_of(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def log(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows as of the last batch in the log, of some buckets or all."""
        newest = self.log().where("bucket >= 0").groupBy("bucket").agg(F.max(F.struct("version", "n")).alias("last")).collect()  # a row a bucket
        shape = self.spark.read.parquet(f"{self.path}/shape")
        paths = [f"{self.path}/data/version={r['last']['version']}/bucket={r['bucket']}" for r in newest if r["last"]["n"] and (buckets is None or r["bucket"] in buckets)]
        if not paths:
            return shape
        return self.spark.read.schema(shape.schema).parquet(*paths)

    def _write(self, rows: DataFrame, touched: list[int], stream: str, epoch: int, buckets: int) -> None:
        version = (self.log().agg(F.max("version")).first()[0] or 0) + 1
        placed = rows.withColumn("bucket", self.bucket_of(F.col(self.key), buckets))
        target = f"{self.path}/data/version={version}"  # what a broken-off run left there is not in the log
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        every = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        try:
            written = self.spark.read.parquet(target).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        except AnalysisException as e:  # all touched buckets are empty now
            if "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            written = every.where("false").withColumn("n", F.lit(0).cast("long"))
        entries = every.join(written, "bucket", "left").select(
            F.lit(version).cast("long").alias("version"), F.lit(stream).alias("stream"), F.lit(epoch).cast("long").alias("epoch"), "bucket", F.coalesce("n", F.lit(0)).alias("n")
        )
        self._enter(entries)

    def _enter(self, entries: DataFrame) -> None:
        entries.coalesce(1).write.mode("append").parquet(f"{self.path}/log")  # one file: all of it or nothing

    def applied(self, stream: str, epoch: int) -> bool:
        return self.log().where((F.col("stream") == stream) & (F.col("epoch") == epoch)).limit(1).count() > 0

    def apply(self, changes: DataFrame, new_rows: DataFrame, epoch: int, stream: str = "changes", order: list[Column] | None = None) -> int:
        """Apply a change set as ``apply_change_set`` does; returns the number of buckets rewritten.

        A batch (stream, epoch) in the log changes nothing any more.  A batch without
        changes is logged as well.
        """
        if self.applied(stream, epoch):
            return 0
        buckets = self.buckets()
        changes, _ = cut_lineage(changes)
        made = F.col("insight_id") if "insight_id" in new_rows.columns else F.lit(None).cast("string")
        created = changes.where("op = 'create'").select("candidate_id").join(new_rows.select("candidate_id", made.alias("__id")), "candidate_id")
        keys = changes.where("op in ('update', 'delete')").select(F.col("insight_id").alias("__id")).union(created.select("__id"))
        touched = sorted(r["bucket"] for r in keys.select(self.bucket_of(F.col("__id"), buckets).alias("bucket")).distinct().collect())  # at most ``buckets``
        if touched:
            self._write(apply_change_set(self.rows(touched), changes, new_rows, self.key, order), touched, stream, epoch, buckets)
        else:
            self._note(stream, epoch)
        return len(touched)

    def _note(self, stream: str, epoch: int) -> None:
        none = self.spark.range(1).select(F.lit(0).cast("long").alias("version"), F.lit(stream).alias("stream"), F.lit(epoch).cast("long").alias("epoch"), F.lit(-1).alias("bucket"), F.lit(0).cast("long").alias("n"))
        self._enter(none)


def change_handler(table: StoredTable, build: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], stream: str) -> Callable[[DataFrame, int], None]:
    """A handler for ``stream_apply``: (rows, stored rows) become a change set, applied once per epoch."""

    def handle(rows: DataFrame, epoch: int) -> None:
        if not table.applied(stream, epoch):
            changes, new_rows = build(rows, table.rows())
            table.apply(changes, new_rows, epoch, stream)

    return handle
