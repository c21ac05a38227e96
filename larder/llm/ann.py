"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected and ordered along several Hilbert curves, each on directions and with
a grid shift of its own.  Spark range-partitions the orderings into windows of about equal
size; a query is scored exactly against the windows next to its own place on every curve,
and the curves' lists are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import cut_lineage
from larder.llm.hilbert import curve_keys
from larder.llm.topk import best_first, exact_topk, matrix, usable

DIMS, BITS = 8, 7


def _keyed(batches: Iterator[pa.RecordBatch], longest: float, curves: int, seed: int) -> Iterator[pa.RecordBatch]:
    """One row per (vector, curve) with its key.

    Candidates get the extra coordinate sqrt(1 - |x|^2 / longest^2) and queries zero, so that
    the largest inner product is the nearest point on the sphere whatever the lengths.
    """
    for b in batches:
        sizes = pa.compute.list_value_length(b.column("vector")).to_numpy(zero_copy_only=False)
        for width in np.unique(sizes):
            part = b.filter(pa.array(sizes == width))
            x, asks = matrix(part.column("vector")).astype(np.float64), part.column("asks").to_numpy(zero_copy_only=False)
            length = np.linalg.norm(x, axis=1)
            scale = np.where(asks, length, longest)
            extra = np.where(asks, 0, np.sqrt(np.maximum(0, 1 - (length / longest) ** 2)))
            keys = curve_keys(np.column_stack([x / scale[:, None], extra]), curves, DIMS, BITS, seed)
            n = len(part)
            names = part.schema.names
            for c in range(curves):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(n, width, np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(keys[c])], [*names, "width", "curve", "key"])


def _rerank(t: pa.Table, k: int, queries_at_once: int) -> pa.Table:
    """Exact scores of a window's queries against its rows; each query's k best."""
    asks = t.column("asks").to_numpy()
    q, s = t.filter(pa.array(asks)), t.filter(pa.array(~asks)).sort_by("vec_id")
    out: list[list[np.ndarray]] = [[], [], [], []]
    if len(q) and len(s):
        shard, s_ids, s_rows = matrix(s.column("vector")).astype(np.float64), s.column("vec_id").to_numpy(), s.column("row").to_numpy()
        vectors, q_ids, q_rows = matrix(q.column("vector")).astype(np.float64), q.column("vec_id").to_numpy(), q.column("row").to_numpy()
        for at in range(0, len(q), queries_at_once):
            scores = vectors[at : at + queries_at_once] @ shard.T
            kth = min(k, scores.shape[1] - 1)  # one more than k: the query's own row may be among them
            least = -np.partition(-scores, kth, axis=1)[:, kth]
            # a matrix product may round copies differently: whatever is as near but for rounding is summed again
            slack = 1e-12 * np.maximum(1, np.abs(scores).max(axis=1))
            row, col = np.nonzero(scores >= (least - slack)[:, None])
            other = q_rows[at + row] != s_rows[col]
            row, col = row[other], col[other]
            exact = np.einsum("ij,ij->i", vectors[at + row], shard[col])
            order = np.lexsort((s_ids[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, exact = row[best], col[best], exact[best]
            for column, values in zip(out, (q_ids[at + row], exact, s_ids[col], s_rows[col]), strict=True):
                column.append(values)
    whole = [np.concatenate(c) if c else np.empty(0, d) for c, d in zip(out, (np.int64, np.float64, np.int64, np.int64), strict=True)]
    return pa.table(dict(zip(("query_id", "score", "vec_id", "vec_row"), whole, strict=True)))


def taking_part(vectors: DataFrame, asks: Column, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, vector, asks): vectors that are finite and not zero."""
    v = F.col(vector_col)
    return vectors.where(F.col(id_col).isNotNull() & usable(v, zero=False)).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks")
    )


def windows(taking: DataFrame, rows: int, k: int, curves: int, window_rows: int, seed: int) -> DataFrame:
    """Candidates and queries with their window number along each curve.

    Of more than k + 1 copies of a vector only those with the smallest ids can be among any
    query's k best, so only those are candidates; all others still ask.
    """
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id", "row"))
    base = taking.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("row", "vec_id", "vector", F.lit(False).alias("asks"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(taking.agg(F.max(F.sqrt(square))).first()[0] or 1.0)
    both = base.union(taking.where("asks").select("row", "vec_id", "vector", F.lit(True)))
    kind = both.schema["vector"].dataType.simpleString()
    keyed = both.mapInArrow(partial(_keyed, longest=longest, curves=curves, seed=seed), f"row long, vec_id long, vector {kind}, asks boolean, width int, curve int, key long")
    ranged = keyed.repartitionByRange(max(1, ceil(rows * curves / window_rows)), "width", "curve", "key", "vec_id", "row")
    return ranged.withColumn("window", F.spark_partition_id())


def reach_for(placed: DataFrame, exact: DataFrame, wanted: float) -> int:
    """Windows to each side that hold ``wanted`` of the exact neighbours of sample queries."""
    seen = placed.select("row", "curve", "asks", "window")
    near = (
        exact.join(seen.where("asks").select(F.col("row").alias("query_row"), "curve", F.col("window").alias("own")), "query_row")
        .join(seen.where("not asks").select(F.col("row").alias("vec_row"), "curve", "window"), ["vec_row", "curve"])
        .groupBy("query_row", "vec_row").agg(F.min(F.abs(F.col("window") - F.col("own"))).alias("away"))
    )
    counts = {r["away"]: r["count"] for r in near.groupBy("away").count().collect()}  # at most one row per window
    total, reached = sum(counts.values()), 0
    for away in sorted(counts):
        reached += counts[away]
        if reached >= wanted * total:
            return int(away)
    return 0


def approximate_topk(
    vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = 8,
    window_rows: int = 2048, sample_queries: int = 96, wanted: float = 0.95, reach: int | None = None, seed: int = 7, queries_at_once: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest found by inner product.

    ``asks``: which rows are queries; candidates are all rows but the query's own.  ``reach``
    windows to each side are searched on each curve; None measures it: the exact neighbours
    of about ``sample_queries`` queries (by hash; this bound is fixed) are looked up on the
    curves, and the least reach holding ``wanted`` of them is taken, at every input size.

    Rows whose id or vector is null, and vectors that are zero or hold null or non-finite
    components, take no part; vectors of different lengths are never compared; copies are
    candidates like any other; ties go to the smaller vec_id; with fewer than k rows found
    fewer are returned; empty tables give no rows.
    """
    stored, n = cut_lineage(taking_part(vectors, asks, id_col, vector_col))
    placed, _ = cut_lineage(windows(stored, n, k, curves, window_rows, seed))
    if reach is None:
        n_asks = max(1, stored.where("asks").count())
        share = min(1.0, sample_queries / n_asks)
        sampled = F.col("asks") & (F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        exact = exact_topk(stored.select("row", "vector", sampled.alias("s")), F.col("s"), k=k, id_col="row", vector_col="vector")
        reach = reach_for(placed, exact.select(F.col("query_id").alias("query_row"), F.col("vec_id").alias("vec_row")), wanted)
    near = F.explode(F.sequence(F.col("window") - reach, F.col("window") + reach))
    cells = placed.where("not asks").unionByName(placed.where("asks").withColumn("window", near))

    def rerank(t: pa.Table) -> pa.Table:
        return _rerank(t, k, queries_at_once)

    found = cells.drop("key").groupBy("width", "curve", "window").applyInArrow(rerank, "query_id long, score double, vec_id long, vec_row long")
    rank = F.row_number().over(best_first(k))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
