"""Nearest neighbours over embeddings and the label vote built on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import cut_lineage, fixed
from larder.functions import text
from larder.functions.measures import vec_unit
from larder.operators.joins import annotation_neighbors_join, threshold_join
from larder.operators.ranking import best_per

UNKNOWN = "UNKNOWN"


def vec_normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, vec_unit(F.col(column)))


def comparable(vector: Column) -> Column:
    """Vectors without null or non-finite components that are not null or empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def rows_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return _unit(rows_matrix(column).astype(np.float64))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


QUERY_SLICE, INDEX_SLICE = 512, 4096  # queries and vectors whose distances are held at once
TILE_FLOATS = 1 << 22  # components of all vectors of a block, or of a chunk of queries


@dataclass(frozen=True)
class Pivots:
    """Unit vectors of the cells' pivots, the radius of each cell, and its blocks: the first and how many."""

    vectors: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def needed(self, far: np.ndarray, worst: np.ndarray, digits: int, probes: int | None) -> np.ndarray:
        """(queries, cells): whether a cell may hold one no further than ``worst``, or is among the ``probes`` next."""
        if probes is not None:
            return far.argsort(axis=1, kind="stable").argsort(axis=1) < probes
        return far - self.radius <= np.sqrt(4 * np.maximum(worst + 10.0**-digits, 0.0))[:, None] + 1e-7

    def blocks_of(self, cells: np.ndarray) -> np.ndarray:
        """The blocks that hold some rows of ``cells``."""
        return np.unique(np.concatenate([np.empty(0, np.int32), *(np.arange(f, f + n, dtype=np.int32) for f, n in zip(self.first[cells], self.blocks[cells], strict=True))]))


def _parts(rows: int, most: int) -> int:
    """Into how many parts so many rows are dealt: none over ``most``, and a few for the cores."""
    return max(-(-rows // most), min(-(-rows // 2048), 4))


def _dealt(pivots: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: cells over ``most`` are cut, others share a block with cells next to them."""
    first, blocks, left = np.zeros(len(sizes), np.int32), np.ones(len(sizes), np.int32), np.ones(len(sizes), bool)
    at, block, held = 0, 0, 0
    for _ in sizes:
        left[at] = False
        if held and held + sizes[at] > most:
            block, held = block + 1, 0
        first[at], blocks[at] = block, max(1, -(-sizes[at] // most))
        block, held = block + blocks[at] - 1, held + sizes[at] if blocks[at] == 1 else most
        at = int(np.argmax(np.where(left, pivots @ pivots[at], -np.inf)))
    return first, blocks


def _in_cells(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), INDEX_SLICE):
            b = batch.slice(at, INDEX_SLICE)
            far = _far(_units(b.column("embedding")), pivots)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1))], [*b.schema.names, "cell", "far"])


def _visits(batches: Iterator[pa.RecordBatch], pivots: Pivots, digits: int, probes: int | None, home: bool | None) -> Iterator[pa.RecordBatch]:
    """Adds ``blocks`` to look into: those of the own cell (``home``), else of the needed cells, all or (False) without the own one's."""
    for batch in batches:
        for at in range(0, len(batch), INDEX_SLICE):
            b = batch.slice(at, INDEX_SLICE)
            own = b.column("cell").to_numpy()
            if home:
                blocks = [pivots.blocks_of(c) for c in own[:, None]]
            else:
                needed = pivots.needed(_far(_units(b.column("embedding")), pivots.vectors), b.column("worst").to_numpy(), digits, probes)
                blocks = [pivots.blocks_of(np.flatnonzero(some)) for some in needed]
            if home is False:
                blocks = [np.setdiff1d(found, pivots.blocks_of(c)) for found, c in zip(blocks, own[:, None], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.list_(pa.int32()))], [*b.schema.names, "blocks"])


def _nearest(x: np.ndarray, own: np.ndarray, worst: np.ndarray, ids: np.ndarray, y: np.ndarray, parts: list[tuple[int, int, int]],
             pivots: Pivots, k: int, digits: int, probes: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the ``k`` best rows of each query no further than ``worst``, self excluded.

    ``parts``: (cell, begin, end) of the rows, ids ascending in each.
    """
    far, slack = _far(x, pivots.vectors), 10.0**-digits
    probed = None if probes is None else pivots.needed(far, worst, digits, probes)
    middle = far.mean(axis=0)
    row, who, away = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for cell, begin, end in sorted(parts, key=lambda part: middle[part[0]]):
        visit = probed[:, cell] if probed is not None else far[:, cell] - pivots.radius[cell] <= np.sqrt(4 * np.maximum(worst + slack, 0.0)) + 1e-7
        asks = np.flatnonzero(visit)
        if not len(asks):
            continue
        told = (1.0 - x[asks] @ y[begin:end].T) / 2.0
        low, high = np.searchsorted(ids[begin:end], own[asks]), np.searchsorted(ids[begin:end], own[asks], "right")
        for i in np.flatnonzero(high > low):
            told[i, low[i] : high[i]] = np.nan
        take = told <= worst[asks][:, None] + slack
        many = np.flatnonzero(np.count_nonzero(take, axis=1) > 4 * k + 64)
        if len(many):
            # only what ties with the k-th of this part in all digits, and of ties the smaller ids, which stand first
            some = np.round(told[many], digits)
            kth = np.partition(some, k - 1, axis=1)[:, k - 1 : k]
            less, tied = some < kth, some == kth
            take[many] = take[many] & (less | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - np.count_nonzero(less, axis=1)[:, None])))
        at, col = np.divmod(np.flatnonzero(take), end - begin)
        if not len(at):
            continue
        row, who, away = np.concatenate([row, asks[at]]), np.concatenate([who, ids[begin + col]]), np.concatenate([away, told[at, col]])
        order = np.lexsort((who, np.round(away, digits), row))
        row, who, away = row[order], who[order], away[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        full = place == k - 1
        worst = worst.copy()
        worst[row[full]] = np.minimum(worst[row[full]], away[full])
        row, who, away = row[place < k], who[place < k], away[place < k]
    return row, who, away


def _tile(q: pa.Table, r: pa.Table, pivots: Pivots, k: int, digits: int, probes: int | None) -> pa.Table:
    """The ``k`` best rows of a block for each query of a chunk."""
    out: list[list[np.ndarray]] = [[], [], []]
    if len(q) and len(r):
        r = r.select(["neighbor_id", "embedding", "cell"]).sort_by([("cell", "ascending"), ("neighbor_id", "ascending")])
        q = q.select(["query_id", "embedding", "cell", "worst"]).sort_by("cell")
        ids, y = r.column("neighbor_id").to_numpy(), _units(r.column("embedding"))
        cells, begins = np.unique(r.column("cell").to_numpy(), return_index=True)
        ends = np.append(begins[1:], len(ids))
        parts = [(c, at, min(at + INDEX_SLICE, b)) for c, a, b in zip(cells.tolist(), begins.tolist(), ends.tolist(), strict=True) for at in range(a, b, INDEX_SLICE)]
        for at in range(0, len(q), QUERY_SLICE):
            some = q.slice(at, QUERY_SLICE)
            own = some.column("query_id").to_numpy()
            row, who, away = _nearest(_units(some.column("embedding")), own, some.column("worst").to_numpy(), ids, y, parts, pivots, k, digits, probes)
            for column, values in zip(out, (own[row], who, away), strict=True):
                column.append(values)
    kinds = (np.int64, np.int64, np.float64)
    return pa.table(dict(zip(("query_id", "neighbor_id", "distance"), [np.concatenate(c) if c else np.empty(0, d) for c, d in zip(out, kinds, strict=True)], strict=True)))


_HITS = "query_id long, neighbor_id long, distance double"


def knn_join(queries: DataFrame, index: DataFrame, k: int = fixed.DEFAULT_NEIGHBORS, id_col: str = "logo_id",
             vector_col: str = "embedding", server_col: str | None = None, cells: int | None = None,
             block_rows: int | None = None, query_rows: int | None = None, probes: int | None = None, digits: int = 12,
             within: str | None = None) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the ``k`` nearest by cosine, self removed.

    Exact without comparing everything: index rows go to the cell of their nearest pivot.
    A query first searches around its own cell, which bounds its k-th distance; by the triangle
    inequality only cells with ``d(query, pivot) - radius <= bound`` can still hold a
    neighbour, and those are searched next.  Cells next to each other share a block of at most
    ``block_rows``, larger ones are cut into several, and the queries of a block into chunks of
    about ``query_rows`` (by default as many as have ``TILE_FLOATS`` components): a task compares two
    bounded matrices cell by cell and emits at most ``k`` rows per query.  A query is sent
    once for every block, never once for every cell.  ``probes=n`` searches only the n nearest
    cells (approximate).  ``within`` names a column of the queries: only rows no further than
    that are wanted (null: all), which takes the place of the first search.

    Null vectors and ids, and vectors with null or non-finite components, take no part; only
    vectors of the commonest length are compared; zero vectors are at a right angle to all.
    Distances that are equal in ``digits`` digits are ties, which smaller ids win (sums of
    equal vectors differ in their last bits).
    """
    index, queries = (df.where(F.col(id_col).isNotNull() & comparable(F.col(vector_col))) for df in (index, queries))
    width = index.groupBy(F.size(vector_col).alias("width")).count().orderBy(F.desc("count"), "width").first()
    if width is None:
        return index.sparkSession.createDataFrame([], f"{_HITS}, rank int")
    index, queries = (df.where(F.size(vector_col) == width["width"]) for df in (index, queries))
    most = max(1024, TILE_FLOATS // width["width"])
    block_rows, query_rows = block_rows or most, query_rows or most
    server = F.col(server_col).cast("string") if server_col else F.lit("")
    real = [F.col(vector_col) if dict(df.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>") for df in (index, queries)]
    base = index.select(F.col(id_col).cast("long").alias("neighbor_id"), server.alias("server"), real[0].alias("embedding"))
    worst = F.coalesce(F.col(within).cast("double") if within else F.lit(None), F.lit(float("inf")))
    asked = queries.select(F.col(id_col).cast("long").alias("query_id"), server.alias("server"), real[1].alias("embedding"), worst.alias("worst"))
    total = base.count()
    n_cells = cells or max(1, int(total**0.5 / 4))
    # the pivots: about a quarter of the root of the index
    chosen = base.orderBy(F.xxhash64("neighbor_id"), "neighbor_id").limit(n_cells).select("embedding").collect()
    vectors = _unit(np.array([r["embedding"] for r in chosen], dtype=np.float64))

    def in_cells(rows: DataFrame) -> DataFrame:
        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        return cut_lineage(rows.mapInArrow(partial(_in_cells, pivots=vectors), f"{schema}, cell int, far double"))[0]

    placed, located = in_cells(base), in_cells(asked).drop("far")
    stats = {r["cell"]: (r["radius"], r["n"]) for r in placed.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([stats.get(c, (None, 0))[1] for c in range(len(vectors))])
    first, blocks = _dealt(vectors, sizes, -(-total // _parts(total, block_rows)))
    pivots = Pivots(vectors, np.array([stats.get(c, (-np.inf, 0))[0] for c in range(len(vectors))]), first, blocks)
    of_cell = lambda values: F.get(F.lit(values.tolist()), F.col("cell"))
    index_side = placed.withColumn("block", (of_cell(first) + F.pmod(F.xxhash64("neighbor_id"), of_cell(blocks))).cast("int")).drop("far")

    def search(rows: DataFrame, home: bool | None) -> DataFrame:
        """The best of the blocks that the queries in ``rows`` visit, see ``_visits``.

        Index rows are sent once, or once for every ``query_rows`` visits of their block.
        """
        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        visits, _ = cut_lineage(rows.mapInArrow(partial(_visits, pivots=pivots, digits=digits, probes=probes, home=home), f"{schema}, blocks array<int>"))
        counts = {r["block"]: r["count"] for r in visits.select(F.explode("blocks").alias("block")).groupBy("block").count().collect()}
        chunks = F.get(F.lit([_parts(counts.get(b, 0), query_rows) for b in range(int((first + blocks).max()))]), F.col("block"))
        keys = ["server", "block", "chunk"]
        spread = visits.withColumn("block", F.explode("blocks")).withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks).cast("int"))
        held = index_side.where(chunks > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        run = partial(_tile, pivots=pivots, k=k, digits=digits, probes=probes)
        return spread.select(*keys, "query_id", "embedding", "cell", "worst").groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, _HITS)

    if probes is not None or within is not None:
        return _first_k(search(located, None), k, digits)
    own, _ = cut_lineage(_first_k(search(located, True), k, digits))
    bound = own.groupBy("query_id").agg(F.max("distance").alias("found"), F.count(F.lit(1)).alias("n"))
    reach = F.when(F.col("n") >= k, F.col("found")).otherwise(F.lit(float("inf")))
    others = search(located.join(bound, "query_id", "left").withColumn("worst", F.coalesce(reach, F.lit(float("inf")))).drop("found", "n"), False)
    return _first_k(own.drop("rank").unionByName(others), k, digits)


def _first_k(hits: DataFrame, k: int, digits: int) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("query_id").orderBy(F.round("distance", digits), "neighbor_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_due(logos: DataFrame, day_offset: int = 7, now: Column | None = None) -> DataFrame:
    """Unannotated logos whose neighbours were never or too long ago computed.

    ``neighbors_updated_at`` is a timestamp column.
    """
    now = F.current_timestamp() if now is None else now
    limit = now - F.make_interval(days=F.lit(day_offset))
    stale = F.col("neighbors_updated_at").isNull() | (F.col("neighbors_updated_at") < limit)
    return logos.where(F.col("completed_at").isNull() & stale)


def knn_refresh(logos: DataFrame, embeddings: DataFrame, k: int = fixed.DEFAULT_NEIGHBORS, day_offset: int = 7,
                now: Column | None = None, **options: object) -> DataFrame:
    """Neighbours of the logos that are due."""
    due = knn_due(logos, day_offset, now).select(F.col("id").alias("logo_id"))
    return knn_join(embeddings.join(due, "logo_id", "left_semi"), embeddings, k, **options)


def nested_neighbors(hits: DataFrame, now: Column | None = None) -> DataFrame:
    """Per query the stored form: ids, distances (nearest first) and a time."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "distance")))
    out = hits.groupBy("query_id").agg(pairs.alias("p"))
    return out.select(
        F.col("query_id").alias("logo_id"), F.transform("p", lambda x: x["neighbor_id"]).alias("logo_ids"),
        F.transform("p", lambda x: x["distance"]).alias("distances"), (F.current_timestamp() if now is None else now).alias("updated_at"),
    )


def vote_weights(neighbors: DataFrame, weights: str = "distance", query: str = "logo_id") -> DataFrame:
    """Adds ``weight``: 1/distance, or with exact hits 1 for those and 0 for the rest.

    ``neighbors``: (query, neighbor_id, distance); at most k rows per query.
    """
    if weights == "uniform":
        return neighbors.withColumn("weight", F.lit(1.0))
    if weights != "distance":
        raise ValueError(f"unknown weights: {weights}")
    from pyspark.sql.window import Window

    has_zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy(query)) == 1
    return neighbors.withColumn(
        "weight", F.when(has_zero, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("distance")))
    )


def knn_vote(neighbors: DataFrame, logos: DataFrame, weights: str | None = "distance", query: str = "logo_id") -> DataFrame:
    """(query, label_type, label_value, proba); unlabelled neighbours vote UNKNOWN.

    ``weights=None`` expects a ready ``weight`` column (custom weighting).
    """
    from pyspark.sql.window import Window

    rows = annotation_neighbors_join(neighbors, logos)
    if weights is not None:
        rows = vote_weights(rows, weights, query)
    sums = rows.groupBy(query, "label_type", "label_value").agg(F.sum("weight").alias("w"))
    return sums.withColumn("proba", F.col("w") / F.sum("w").over(Window.partitionBy(query))).drop("w")


def knn_classify(votes: DataFrame, thresholds: DataFrame, default: float = fixed.DEFAULT_LOGO_THRESHOLD, query: str = "logo_id") -> DataFrame:
    """Best known label at or above its threshold."""
    known = votes.where(F.col("label_type") != UNKNOWN)
    best = best_per(known, [query], [F.col("proba").desc(), F.col("label_type").asc(), F.col("label_value").asc_nulls_first()])
    return threshold_join(best, thresholds, default).where(F.col("proba") >= F.col("threshold"))


def logo_predictions(labelled: DataFrame, confidence: Column, is_annotation: bool = False) -> DataFrame:
    """Labelled logos to predictions; only brand and label types with a value produce one.

    ``labelled``: (logo_id, label_type, label_value, barcode, server_type, source_image,
    bounding_box, model_version[, username]).
    """
    rows = labelled.where(F.col("label_type").isin("brand", "label") & F.col("label_value").isNotNull())
    brand = F.col("label_type") == "brand"
    data = [F.col("logo_id"), F.col("bounding_box")]
    if is_annotation:
        data += [F.col("username"), F.lit(True).alias("is_annotation")]
    return rows.select(
        "barcode", "server_type", "source_image", F.col("label_type").alias("type"),
        F.when(brand, text.tag(F.col("label_value"))).otherwise(F.col("label_value")).alias("value_tag"),
        F.when(brand, F.col("label_value")).alias("value"),
        F.lit(False).alias("automatic_processing"), F.lit("universal-logo-detector").alias("predictor"),
        F.col("model_version").alias("predictor_version"), confidence.cast("double").alias("confidence"),
        F.to_json(F.struct(*data)).alias("data"),
    )


def annotated_logo_predictions(logos: DataFrame) -> DataFrame:
    """Human-annotated logos to certain predictions."""
    rows = logos.where(F.col("annotation_type").isNotNull()).select(
        F.col("id").alias("logo_id"), F.col("annotation_type").alias("label_type"), F.col("taxonomy_value").alias("label_value"),
        "barcode", "server_type", "source_image", "bounding_box", "model_version", "username",
    )
    return logo_predictions(rows, F.lit(1.0), is_annotation=True)


def image_fingerprint_fill(images: DataFrame, hashes: DataFrame, overwrite: bool = False) -> DataFrame:
    """Store 64-bit image hashes ``(id, bits)``; existing ones stay unless ``overwrite``."""
    from larder.functions.measures import phash_int

    new = hashes.select("id", phash_int(F.col("bits")).alias("__new"))
    old = F.col("fingerprint")
    joined = images.join(new, "id", "left")
    value = F.coalesce(F.col("__new"), old) if overwrite else F.coalesce(old, F.col("__new"))
    return joined.withColumn("fingerprint", value).drop("__new")


def vector_upsert(incoming: DataFrame, logos: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``action`` per incoming embedding: insert, update or not_found."""
    known = logos.select(F.col("id").alias("logo_id"), F.lit(True).alias("__logo"))
    have = stored.select("logo_id", F.lit(True).alias("__stored"))
    out = incoming.join(known, "logo_id", "left").join(have, "logo_id", "left")
    action = F.when(F.col("__logo").isNull(), "not_found").when(F.col("__stored").isNull(), "insert").otherwise("update")
    return out.withColumn("action", action).drop("__logo", "__stored")


