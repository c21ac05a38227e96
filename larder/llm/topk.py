"""Exact top-k inner products: tiles of queries and shards, selection per tile, merge trees."""

from __future__ import annotations

from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import cut_lineage

EXACT = float(1 << 53)
FOUND = "query_id long, score {kind}, vec_id long"


def usable(vector: Column, zero: bool = True) -> Column:
    """Vectors that take part: not null, no null or non-finite component; ``zero``: all-zero ones too."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fits = vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))
    return fits if zero else fits & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_of_tile(scores: np.ndarray, vec_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores, ties to smaller vec_id.

    ``vec_ids`` is ascending, so among equal scores the leftmost columns win.  Partial
    selection finds the k-th score, and only columns reaching it are looked at again.
    """
    n = scores.shape[1]
    if n > k:
        kth = np.partition(scores, n - k, axis=1)[:, n - k]
        above = scores > kth[:, None]
        level = scores == kth[:, None]
        keep = above | (level & (np.cumsum(level, axis=1) <= (k - above.sum(axis=1))[:, None]))
    else:
        keep = np.ones(scores.shape, bool)
    row, col = np.nonzero(keep)
    order = np.lexsort((vec_ids[col], -scores[row, col], row))
    return row[order], col[order]


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products; integer matrices by floating point where every partial sum is exact."""
    if queries.dtype.kind == "i":
        most = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * queries.shape[1]
        if most < EXACT:
            return (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    return queries @ shard.T


def _tile(t: pa.Table, k: int, queries_at_once: int, kind: str) -> pa.Table:
    """Partial top lists of one tile; its rows are shard rows and queries (``asks``)."""
    asks = t.column("asks").to_numpy()
    q, s = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
    s = s.sort_by("vec_id")
    out: list[list[np.ndarray]] = [[], [], []]
    if len(q) and len(s):
        q_ids, s_ids, shard = q.column("vec_id").to_numpy(), s.column("vec_id").to_numpy(), matrix(s.column("vector"))
        q_rows, s_rows = q.column("row").to_numpy(), s.column("row").to_numpy()
        vectors = matrix(q.column("vector"))
        for at in range(0, len(q), queries_at_once):
            scores = products(vectors[at : at + queries_at_once], shard)
            extra = k + 1  # the query's own row may be among them
            row, col = best_of_tile(scores, s_ids, extra)
            other = q_rows[at + row] != s_rows[col]
            row, col = row[other], col[other]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[place < k], col[place < k]
            for column, values in zip(out, (q_ids[at + row], scores[row, col], s_ids[col]), strict=True):
                column.append(values)
    value = np.int64 if kind == "long" else np.float64
    whole = [np.concatenate(c) if c else np.empty(0, d) for c, d in zip(out, (np.int64, value, np.int64), strict=True)]
    return pa.table({"query_id": whole[0].astype(np.int64), "score": whole[1].astype(value), "vec_id": whole[2].astype(np.int64)})


def best_first(k: int) -> Window:
    return Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")


def merge_tree(found: DataFrame, k: int, lists: int, fan: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of each query's lists.

    ``found`` has a column ``part``; ``fan`` lists merge into one per level, so a merging
    task reads at most ``fan`` * k rows of a query however many tiles there were.
    """
    while lists > fan:
        lists = ceil(lists / fan)
        found = found.withColumn("part", F.floor(F.col("part") / fan))
        merged = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id"))
        found = found.withColumn("rank", merged).where(F.col("rank") <= k).drop("rank")
    return found.withColumn("rank", F.row_number().over(best_first(k))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_topk(
    vectors: DataFrame, asks: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    kind: str = "double", shard_rows: int = 16_384, query_rows: int = 4_096, queries_at_once: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row.

    ``asks``: which rows of ``vectors`` are queries; candidates are all rows but the query's
    own row (a copy with the same id is another row).  ``vector_col`` is an array of ``kind``
    ("double", or "long" for integer products).  Rows whose id or vector is null, or whose
    vector has a null or non-finite component, take no part; vectors of different lengths
    are never compared; with fewer than k candidates all are returned; ties go to the
    smaller vec_id; empty tables give no rows.

    Rows are cut into shards and queries into blocks, of about ``shard_rows`` and
    ``query_rows``; a tile is one pair of them, a task of bounded size.
    """
    v = F.col(vector_col)
    row = F.monotonically_increasing_id().alias("row")
    taking = vectors.where(F.col(id_col).isNotNull() & usable(v)).select(row, F.col(id_col).cast("long").alias("vec_id"), v.cast(f"array<{kind}>").alias("vector"), F.coalesce(asks, F.lit(False)).alias("asks"))
    stored, n = cut_lineage(taking)
    shards = max(1, ceil(n / shard_rows))
    blocks = max(1, ceil(stored.where("asks").count() / query_rows))
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    span = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    base = stored.select(deal(shards).alias("shard"), span(blocks).alias("block"), "row", "vec_id", "vector", F.lit(False).alias("asks"))
    queries = stored.where("asks").select(span(shards).alias("shard"), deal(blocks).alias("block"), "row", "vec_id", "vector", F.lit(True).alias("asks"))
    tiles = base.union(queries).withColumn("width", F.size("vector")).groupBy("shard", "block", "width")

    def tile(key: tuple, t: pa.Table) -> pa.Table:
        out = _tile(t, k, queries_at_once, kind)
        return out.append_column("part", pa.array(np.full(len(out), key[0].as_py(), np.int32)))

    found = tiles.applyInArrow(tile, FOUND.format(kind=kind) + ", part int")
    return merge_tree(found, k, shards)
