"""Running tables: counts and distinct counts kept as mergeable states of batches.

A day's rows become a small state of their own; a reader merges the states, so older rows are
not read again.  Counts are exact and may be taken back (rows with sign -1).  Distinct values are
kept as the ``k`` smallest of their hashes: below k values the count is exact, beyond it the
standard error is 1 / sqrt(k - 2).  Both depend only on the rows, so states of any split of the
input, merged in any order, equal the state of one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HASH_DIGITS = 15  # hexadecimal digits of a value's hash: 60 bits


def value_hash(value: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text; null for null."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, HASH_DIGITS), 16, 10).cast("long")


def merge_states(states: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """One state of several: counts are added, of the hashes the ``k`` smallest stay.

    Sums and distinct hashes combine before the shuffle, and the rank is limited in each task
    first, so a key with a third of all rows sends k rows a task.
    """
    merged = states.groupBy(*keys, "metric", "hash").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "metric").orderBy("hash"))
    small = merged.where("hash IS NOT NULL").withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")
    return merged.where("hash IS NULL AND n <> 0").unionByName(small)


def state_of(rows: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), k: int = 1024, sign: str | None = None) -> DataFrame:
    """(keys..., metric, hash, n): the state of some rows; metric ``count`` and one per distinct column.

    ``sign`` names a column of 1 and -1; a value seen cannot be taken back from a distinct
    count, so the two exclude each other.  Null keys are keys, null values are not counted,
    no rows give an empty state.
    """
    if sign and distinct:
        raise ValueError("distinct counts cannot take rows back")
    none = F.lit(None).cast("long")
    parts = [F.struct(F.lit("count").alias("metric"), none.alias("hash"), (F.col(sign).cast("long") if sign else F.lit(1).cast("long")).alias("n"))]
    parts += [F.struct(F.lit(c).alias("metric"), value_hash(F.col(c)).alias("hash"), F.lit(0).cast("long").alias("n")) for c in distinct]
    long = rows.select(*keys, F.explode(F.array(*parts)).alias("__part")).select(*keys, "__part.*")
    return merge_states(long.where("metric = 'count' OR hash IS NOT NULL"), keys, k)


def read_state(state: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), k: int = 1024) -> DataFrame:
    """(keys..., count, n_<column>...) of a merged state."""

    def estimate(column: str) -> Column:
        mine = F.col("metric") == column
        kept = F.count(F.when(mine, F.col("hash")))
        largest = F.max(F.when(mine, F.col("hash"))).cast("double")
        scaled = F.round(F.lit(float(k - 1)) * F.lit(float(16**HASH_DIGITS)) / (largest + 1.0)).cast("long")
        return F.when(kept < k, kept).otherwise(scaled).alias(f"n_{column}")

    counts = F.coalesce(F.sum(F.when(F.col("metric") == "count", F.col("n"))), F.lit(0)).alias("count")
    return state.groupBy(*keys).agg(counts, *map(estimate, distinct))


class RunningTable:
    """States by batch under ``path``; a batch written again replaces itself.

    ``fold`` merges the batches there are into one; a batch already folded changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], distinct: Sequence[str] = (), k: int = 1024) -> None:
        self.spark, self.path, self.keys, self.distinct, self.k = spark, path, list(keys), list(distinct), k

    def _read(self, folder: str, **options: str) -> DataFrame | None:
        try:
            return self.spark.read.options(**options).parquet(f"{self.path}/{folder}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def _folds(self) -> list[tuple[int, list[str]]]:
        """(version, batches folded into it), newest last; a row a fold."""
        log = self._read("folds")
        return [] if log is None else [(r["version"], r["batches"]) for r in log.orderBy("version").collect()]

    def add(self, rows: DataFrame, batch: str, sign: str | None = None) -> bool:
        """Put a batch's state in place; False where it is folded already."""
        folds = self._folds()
        if folds and batch in folds[-1][1]:
            return False
        state_of(rows, self.keys, self.distinct, self.k, sign).write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")
        return True

    def _parts(self) -> tuple[DataFrame | None, list[str]]:
        folds = self._folds()
        done = folds[-1][1] if folds else []
        base = self._read(f"base/version={folds[-1][0]}") if folds else None
        fresh = self._read("batches")
        if fresh is None:
            return base, done
        fresh = fresh.withColumn("batch", F.col("batch").cast("string"))
        names = sorted(r["batch"] for r in fresh.select("batch").distinct().collect())  # a row a batch
        fresh = fresh.where(~F.col("batch").isin(done)).drop("batch") if done else fresh.drop("batch")
        return (fresh if base is None else base.unionByName(fresh)), sorted({*done, *names})

    def state(self) -> DataFrame | None:
        """The merged state of all batches; None before the first one."""
        parts, _ = self._parts()
        return None if parts is None else merge_states(parts, self.keys, self.k)

    def fold(self) -> None:
        """Merge base and batches into a new base; the log names it last, so a broken-off fold is not seen."""
        parts, batches = self._parts()
        if parts is None:
            return
        version = max([v for v, _ in self._folds()], default=0) + 1
        merge_states(parts, self.keys, self.k).write.mode("overwrite").parquet(f"{self.path}/base/version={version}")
        self.spark.createDataFrame([(version, batches)], "version int, batches array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/folds")

    def read(self) -> DataFrame:
        state = self.state()
        if state is None:
            raise ValueError("no batch has been added")
        return read_state(state, self.keys, self.distinct, self.k)
