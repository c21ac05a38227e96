"""A stored vector index: trained cells, short codes, exact reranking, and upkeep by deltas.

Rows lie in one folder per batch and cell.  A search ranks the codes of the cells next to
its queries by table look-ups, and the few best of each by their exact distance; how many cells and candidates that takes is measured for a wanted recall.
Upserts and deletions append a batch; neighbour lists are brought up to date from it alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder import cut_lineage
from larder.functions.binding import bind
from larder.operators.vectors import comparable, knn_join, rows_matrix

MOST_CELLS = 4096  # the cells are a table every task holds: at most so many vectors
CODE_WORDS = 256
DIGITS = 9  # of a distance; equal in them are ties, which smaller ids win: sums of equal vectors differ in their last bits
ROW = "id long, server string, vector array<double>, code binary, cell int, far double, deleted boolean"


@dataclass(frozen=True)
class Cells:
    """Centroids of the cells, and a codebook of 256 words for each stretch of a vector."""

    centroids: np.ndarray
    books: list[np.ndarray]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Euclidean distance of each row to each centroid."""
        square = (x * x).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1)
        return np.sqrt(np.maximum(0.0, square - 2 * (x @ self.centroids.T)))

    def stretches(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.books), axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([nearest(part, book) for part, book in zip(self.stretches(x), self.books, strict=True)]).astype(np.uint8)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """(rows, stretches, words): inner products of each row's stretches with all words."""
        return np.stack([np.pad(part @ book.T, ((0, 0), (0, CODE_WORDS - len(book)))) for part, book in zip(self.stretches(x), self.books, strict=True)], axis=1)


def estimates(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows): inner products as the codes tell them."""
    return sum(tables[:, m, codes[:, m]] for m in range(codes.shape[1]))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def _fit(batches: Iterator[pa.RecordBatch], cells: int, code_bytes: int, seed: int) -> Iterator[pa.RecordBatch]:
    parts = [rows_matrix(b.column("vector")) for b in batches if len(b)]
    if parts:
        x, rng = np.concatenate(parts), np.random.default_rng(seed)
        found = [(-1, k_means(x, cells, rng))]
        found += [(m, k_means(part, CODE_WORDS, rng)) for m, part in enumerate(np.array_split(x, min(code_bytes, x.shape[1]), axis=1))]
        for m, centres in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(centres), m, np.int32)), pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(centres.tolist(), pa.list_(pa.float64()))], ["book", "number", "vector"])


def _placed(batches: Iterator[pa.RecordBatch], cells: Cells) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            x = rows_matrix(b.column("vector"))
            far = cells.distances(x)
            extra = [pa.array([c.tobytes() for c in cells.codes(x)], pa.binary()), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1)), pa.array(np.zeros(len(b), bool))]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, "code", "cell", "far", "deleted"])


@dataclass(frozen=True)
class Settings:
    """How many cells a query looks into, and how many of their rows are ranked exactly."""

    probes: int
    candidates: int


class VectorIndex:
    """Vectors of one length, by cosine; ids are unique (of repeated ones in a batch one counts).

    Null vectors, and such with null or non-finite components or another length, take no
    part; a zero vector is as far from everything as a right angle.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    # -- building and upkeep

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "logo_id", vector_col: str = "embedding", server_col: str | None = None, cells: int | None = None,
              sample_rows: int = 20_000, code_bytes: int = 16, seed: int = 5) -> VectorIndex:
        """Train on about ``sample_rows`` vectors (by hash of the id) and write batch 0; every vector is indexed."""
        index = cls(vectors.sparkSession, path)
        rows = unit_rows(vectors, id_col, vector_col, server_col)
        n = rows.count()
        k = cells or max(1, min(MOST_CELLS, int(n**0.5)))
        share = min(1.0, sample_rows / max(n, 1))
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("id", "vector")
        fitted = sample.repartition(1).sortWithinPartitions("id").select("vector").mapInArrow(partial(_fit, cells=k, code_bytes=code_bytes, seed=seed), "book int, number int, vector array<double>")
        fitted.write.parquet(f"{path}/cells")
        index.append(rows)
        return index

    def cells(self) -> Cells:
        rows = self.spark.read.parquet(f"{self.path}/cells").orderBy("book", "number").collect()  # MOST_CELLS and 256 a stretch at most
        books: dict[int, list] = {}
        for r in rows:
            books.setdefault(r["book"], []).append(r["vector"])
        return Cells(np.array(books.pop(-1, [[0.0]])), [np.array(books[m]) for m in sorted(books)])

    def batches(self) -> int:
        """Number of batches written."""
        try:
            return (self.spark.read.parquet(f"{self.path}/log").agg(F.max("batch")).first()[0] or 0) + 1
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def append(self, rows: DataFrame) -> int:
        """Write ``unit_rows`` as the next batch, a file per cell; returns its number.

        The log names a batch only once it is whole, so a batch that was broken off is
        written over.
        """
        batch = self.batches()
        width = self.width()
        if width is not None:
            rows = rows.where(F.size("vector") == width)
        placed = rows.dropDuplicates(["id"]).mapInArrow(partial(_placed, cells=self.cells()), ROW)
        return self._write(placed, batch)

    def _write(self, placed: DataFrame, batch: int) -> int:
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/rows/batch={batch}")
        self.spark.range(1).select(F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/log")
        return batch

    def width(self) -> int | None:
        first = self.spark.read.parquet(f"{self.path}/cells").where("book = -1").select(F.size("vector")).first()
        return first[0] if first else None

    def upsert(self, vectors: DataFrame, id_col: str = "logo_id", vector_col: str = "embedding", server_col: str | None = None) -> int:
        return self.append(unit_rows(vectors, id_col, vector_col, server_col))

    def delete(self, ids: DataFrame, id_col: str = "logo_id") -> int:
        """Mark ids as gone."""
        gone = self.rows().join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
        return self._write(gone.withColumn("deleted", F.lit(True)).select("id", "server", "vector", "code", "cell", "far", "deleted"), self.batches())

    def batch_rows(self) -> DataFrame:
        whole = self.spark.read.schema(f"{ROW}, batch int").option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={b}" for b in range(self.batches())])
        return whole

    def rows(self) -> DataFrame:
        """The rows as they are now: the last of each id, without the deleted.

        Only ids of later batches are looked at to find out what they replace.
        """
        whole = self.batch_rows()
        if self.batches() == 1:
            return whole.drop("batch", "deleted")
        later = whole.where("batch > 0").groupBy("id").agg(F.max("batch").alias("newest"))
        return whole.join(later, "id", "left").where((F.col("batch") == F.coalesce("newest", F.lit(0))) & ~F.col("deleted")).drop("batch", "newest", "deleted")

    # -- searching

    def search(self, queries: DataFrame, settings: Settings, k: int = 100, id_col: str = "logo_id", vector_col: str = "embedding", server_col: str | None = None,
               block_rows: int = 32_768, query_rows: int = 32_768) -> DataFrame:
        """(query_id, neighbor_id, distance, rank): the k nearest found, the query's own id left out.

        Rows are dealt into blocks and queries into chunks.  A task goes through the cells of
        its block, ranks the best candidates of each exactly and hands on the k best a query:
        a vector is sent once for every chunk or block, never once for every cell.
        """
        cells = self.cells()
        asked = unit_rows(queries, id_col, vector_col, server_col).where(F.size("vector") == self.width())
        rows = self.rows().select("id", "server", "vector", "code", "cell")
        sizes = rows.groupBy("server").agg(F.count(F.lit(1)).alias("n"))
        parts = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.least(F.ceil(F.col(n) / 2048), F.lit(4))).cast("int")
        tiles = asked.groupBy("server").agg(F.count(F.lit(1)).alias("m")).join(sizes, "server").select("server", parts("n", block_rows).alias("blocks"), parts("m", query_rows).alias("chunks"))
        tiles, _ = cut_lineage(tiles)
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
        keys = ["server", "block", "chunk"]
        q = asked.join(tiles, "server").withColumn("chunk", deal("chunks")).withColumn("block", upto("blocks")).select(*keys, "id", "vector")
        r = rows.join(tiles, "server").withColumn("block", deal("blocks")).withColumn("chunk", upto("chunks")).select(*keys, "id", "vector", "code", "cell")
        found = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(partial(_nearest_found, cells=cells, settings=settings, k=k), "query_id long, neighbor_id long, distance double")
        return first_k(found, k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The k nearest of ``unit_rows`` by the exact join."""
        rows = self.rows().select(F.col("id").alias("logo_id"), "server", F.col("vector").alias("embedding"))
        return knn_join(queries.select(F.col("id").alias("logo_id"), "server", F.col("vector").alias("embedding")), rows, k, server_col="server", digits=DIGITS)

    def calibrate(self, k: int = 100, wanted: float = 0.95, sample_queries: int = 96, seed: int = 3) -> Settings:
        """The least settings that would find ``wanted`` of the exact neighbours of sample queries.

        About ``sample_queries`` indexed vectors (by hash of the id) ask all rows exactly.
        For each of their neighbours it is seen how near its cell is, and how many rows its
        code's estimate puts before it.
        """
        rows = self.rows()
        share = min(1.0, sample_queries / max(1, rows.count()))
        picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("id", "server", "vector")
        asks = picked.collect()  # about sample_queries vectors
        if not asks:
            return Settings(1, k)
        cells, ids, servers = self.cells(), np.array([r["id"] for r in asks]), np.array([r["server"] for r in asks])
        x = np.array([r["vector"] for r in asks])
        tops = rows.mapInArrow(partial(_sample_best, x=x, ids=ids, servers=servers, cells=cells, k=k), "query int, id long, product double, estimate double, near int")
        best = tops.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("product"), "id"))).where(F.col("rank") <= k).collect()  # k a sample query
        if not best:
            return Settings(1, k)
        query, estimate = np.array([r["query"] for r in best]), np.array([r["estimate"] for r in best])
        before = rows.mapInArrow(partial(_before, x=x, ids=ids, servers=servers, cells=cells, query=query, estimate=estimate), "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
        ahead = np.zeros(len(best), np.int64)
        for r in before.collect():
            ahead[r["at"]] = r["n"]
        each = 1 - (1 - wanted) / 2  # both must hold
        place = lambda values: int(np.sort(values)[min(len(values) - 1, ceil(each * len(values)) - 1)]) + 1
        return Settings(place(np.array([r["near"] for r in best])), max(k, place(ahead)))


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, server_col: str | None) -> DataFrame:
    """(id, server, vector) with vectors of length one; what cannot be compared is left out."""
    def unit(v: Column) -> Column:
        return bind(F.sqrt(dot(v, v)), lambda size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(0.0)))

    # bound, so that the length is worked out once a vector and not once a component
    v = bind(F.transform(F.col(vector_col), lambda x: x.cast("double")), unit)
    server = F.coalesce(F.col(server_col), F.lit("")) if server_col else F.lit("")
    kept = vectors.where(F.col(id_col).isNotNull() & comparable(F.col(vector_col)))
    return kept.select(F.col(id_col).cast("long").alias("id"), server.alias("server"), v.alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def first_k(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("distance", DIGITS), "neighbor_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def code_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _nearest_found(q: pa.Table, r: pa.Table, cells: Cells, settings: Settings, k: int) -> pa.Table:
    """The k best rows of a block for each query of a chunk, among the cells next to it."""
    out: list[list[np.ndarray]] = [[], [], []]
    if len(q) and len(r):
        r = r.select(["id", "vector", "code", "cell"]).sort_by([("cell", "ascending"), ("id", "ascending")])
        ids, y, codes = r.column("id").to_numpy(), rows_matrix(r.column("vector")), code_matrix(r.column("code"))
        present, begins = np.unique(r.column("cell").to_numpy(), return_index=True)
        ends = np.append(begins[1:], len(ids))
        q_ids, x = q.column("id").to_numpy(), rows_matrix(q.column("vector"))
        for at in range(0, len(q), 512):
            some, mine = x[at : at + 512], q_ids[at : at + 512]
            near = np.argsort(cells.distances(some), axis=1, kind="stable")[:, : settings.probes]
            visit = np.zeros((len(some), len(cells.centroids)), bool)
            np.put_along_axis(visit, near, True, axis=1)
            tables = cells.tables(some) if (ends - begins).max() > settings.candidates else None
            best, who = np.full((len(some), k), -np.inf), np.full((len(some), k), -1)
            for cell, a, b in zip(present, begins, ends, strict=True):
                asks = np.flatnonzero(visit[:, cell])
                if len(asks):
                    product = some[asks] @ y[a:b].T
                    product[mine[asks][:, None] == ids[a:b]] = -np.inf
                    if b - a > settings.candidates:
                        guess = np.where(np.isfinite(product), estimates(tables[asks], codes[a:b]), -np.inf)
                        least = np.partition(guess, b - a - settings.candidates, axis=1)[:, [b - a - settings.candidates]]
                        product[guess < least] = -np.inf
                    # of equal products the smaller id, which stands first
                    told = np.round(product, DIGITS) - np.arange(b - a) * 1e-14
                    first = np.argpartition(-told, min(k, b - a) - 1, axis=1)[:, :k]
                    both = np.concatenate([best[asks], np.take_along_axis(product, first, axis=1)], axis=1)
                    whose = np.concatenate([who[asks], ids[a:b][first]], axis=1)
                    order = np.lexsort((whose, -np.round(both, DIGITS)), axis=1)[:, :k]
                    best[asks], who[asks] = np.take_along_axis(both, order, axis=1), np.take_along_axis(whose, order, axis=1)
            row, col = np.nonzero(np.isfinite(best))
            for column, values in zip(out, (mine[row], who[row, col], (1 - best[row, col]) / 2), strict=True):
                column.append(values)
    kinds = (np.int64, np.int64, np.float64)
    return pa.table(dict(zip(("query_id", "neighbor_id", "distance"), [np.concatenate(c) if c else np.empty(0, d) for c, d in zip(out, kinds, strict=True)], strict=True)))


def _apart(b: pa.RecordBatch, ids: np.ndarray, servers: np.ndarray) -> np.ndarray:
    """(queries, rows): pairs that do not count, of one id or two servers."""
    return (ids[:, None] == b.column("id").to_numpy()) | (servers[:, None] != np.array(b.column("server").to_pylist()))


def _sample_best(batches: Iterator[pa.RecordBatch], x: np.ndarray, ids: np.ndarray, servers: np.ndarray, cells: Cells, k: int) -> Iterator[pa.RecordBatch]:
    order = np.argsort(np.argsort(cells.distances(x), axis=1, kind="stable"), axis=1)
    tables = cells.tables(x)
    for b in batches:
        if len(b):
            products = x @ rows_matrix(b.column("vector")).T
            products[_apart(b, ids, servers)] = -np.inf
            take = min(k, products.shape[1])
            query, row = np.nonzero((products >= np.partition(products, products.shape[1] - take, axis=1)[:, [products.shape[1] - take]]) & np.isfinite(products))
            guess = estimates(tables, code_matrix(b.column("code")))[query, row]
            columns = [query.astype(np.int32), b.column("id").to_numpy()[row], products[query, row], guess, order[query, b.column("cell").to_numpy()[row]].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "id", "product", "estimate", "near"])


def _before(batches: Iterator[pa.RecordBatch], x: np.ndarray, ids: np.ndarray, servers: np.ndarray, cells: Cells, query: np.ndarray, estimate: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many rows each neighbour's query estimates to be nearer than it."""
    tables, count = cells.tables(x), np.zeros(len(query), np.int64)
    for b in batches:
        if len(b):
            guess = estimates(tables, code_matrix(b.column("code")))
            guess[_apart(b, ids, servers)] = -np.inf
            for q in np.unique(query):
                mine = np.flatnonzero(query == q)
                count[mine] += len(b) - np.searchsorted(np.sort(guess[q]), estimate[mine], "right")
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(query), dtype=np.int32)), pa.array(count)], ["at", "n"])


def refresh_lists(index: VectorIndex, lists: DataFrame, since: int, k: int) -> DataFrame:
    """Neighbour lists (query_id, neighbor_id, distance, rank) as a fresh exact search would give them.

    ``lists`` are those before batch ``since``.  Ids of the later batches, and lists that
    hold an id which changed or went, are searched again.  All other lists can only gain: they
    look for changed vectors no further than their k-th neighbour.
    """
    rows, _ = cut_lineage(index.rows())
    changed = index.batch_rows().where(F.col("batch") >= since).select("id").distinct()
    lost = lists.join(changed.select(F.col("id").alias("neighbor_id")), "neighbor_id", "left_semi").select(F.col("query_id").alias("id"))
    due, _ = cut_lineage(changed.union(lost).distinct())
    again = index.exact(rows.join(due, "id", "left_semi"), k).select("query_id", "neighbor_id", "distance")

    kept = lists.join(due.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "neighbor_id", "distance")
    bounds = kept.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("worst"))
    asked = rows.join(due, "id", "left_anti").join(bounds, "id", "left").withColumnsRenamed({"id": "logo_id", "vector": "embedding"})
    new = rows.join(changed, "id", "left_semi").withColumnsRenamed({"id": "logo_id", "vector": "embedding"})
    gained = knn_join(asked, new, k, server_col="server", digits=DIGITS, within="worst").select("query_id", "neighbor_id", "distance")
    return first_k(again.union(kept).union(gained), k)
