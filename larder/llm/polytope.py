"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated at random (three rounds of sign flips and a fast Hadamard transform);
its hash is the nearest of the 2d signed axes.  Several hashes joined are a bucket, several
tables of buckets make a pair meet.  A vector lies in its own bucket of each table and also
asks in the buckets next nearest to it (multiprobe).  Pairs that meet are verified by their
cosine; buckets, not pairs, travel through the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import cut_lineage
from larder.llm.components import components
from larder.llm.topk import matrix, usable

MOST_TABLES = 64
CHOICES = 3  # nearest axes of one hash that probes may take
PAIRS_AT_ONCE = 1 << 16
SMALL_RUN = 96  # buckets up to this many rows are verified together, larger ones by matrix products


@dataclass(frozen=True)
class Plan:
    """``hashes`` cross-polytopes in ``dims`` dimensions a table, the last in its first ``last`` ones."""

    dims: int
    hashes: int
    last: int
    tables: int
    asks: int  # buckets a vector looks into: its own and the probes
    seed: int

    @property
    def axes(self) -> list[int]:
        return [self.dims] * (self.hashes - 1) + [self.last]


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        pair = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def signs(plan: Plan, table: int, number: int) -> np.ndarray:
    """The three sign flips of one rotation."""
    return np.random.default_rng([plan.seed, table, number]).choice([-1.0, 1.0], (3, plan.dims))


def bucket_keys(x: np.ndarray, plan: Plan, first: int = 0) -> np.ndarray:
    """(rows, tables, asks) bucket numbers of unit vectors, nearest first; [:, :, 0] is the own bucket.

    ``first``: the number of the first table.
    """
    n = len(x)
    wide = np.zeros((n, plan.dims))
    wide[:, : x.shape[1]] = x
    out = np.empty((n, plan.tables, plan.asks), np.int64)
    size = int(np.prod([2 * a for a in plan.axes]))
    for t in range(plan.tables):
        codes, costs = [], []
        for k, axes in enumerate(plan.axes):
            y = wide
            for flip in signs(plan, first + t, k):
                y = hadamard(y * flip)
            y = y[:, :axes]
            far = np.abs(y)
            r = min(CHOICES, axes)
            near = np.argsort(-far, axis=1, kind="stable")[:, :r]
            height = np.take_along_axis(far, near, 1)
            codes.append(2 * near + (np.take_along_axis(y, near, 1) < 0))
            costs.append(height[:, :1] - height)
        ways = np.array(list(product(*[range(c.shape[1]) for c in codes])))
        code, cost = np.zeros((n, len(ways)), np.int64), np.zeros((n, len(ways)))
        for k, axes in enumerate(plan.axes):
            code = code * (2 * axes) + codes[k][:, ways[:, k]]
            cost += costs[k][:, ways[:, k]]
        cheapest = np.argsort(cost, axis=1, kind="stable")[:, : plan.asks]
        found = np.take_along_axis(code, cheapest, 1)
        out[:, t, : found.shape[1]] = t * size + found
        out[:, t, found.shape[1] :] = -1  # fewer ways than asks: buckets of nobody
    return out


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(pairs, tables): whether two rows' keys meet, one in its own bucket."""
    return (a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)


@lru_cache(maxsize=64)
def choose(rows: int, width: int, cosine: float, wanted: float, asks: int, seed: int) -> Plan:
    """Hashes so that a table has about four buckets a row; tables so that ``wanted`` of all pairs at ``cosine`` meet.

    Meeting is measured on random pairs at exactly that cosine, the hardest ones; it depends on the number of rows and the width alone, so every task
    finds the same plan.
    """
    dims = 8
    while dims < width:
        dims *= 2
    bits, whole = ceil(log2(max(rows, 4))) + 2, int(log2(2 * dims))
    hashes, rest = divmod(bits, whole)
    last = 2 ** (rest - 1) if rest else dims
    hashes += rest > 0
    if hashes > 4:
        hashes, last = 4, dims
    rng = np.random.default_rng([seed, width])
    a, b = (unit(rng.standard_normal((1500, width))) for _ in range(2))
    b = unit(b - (a * b).sum(axis=1)[:, None] * a) if width > 1 else a
    b = cosine * a + np.sqrt(1 - cosine**2) * b if width > 1 else a
    tables, met = 0, np.zeros(len(a), bool)
    while tables < MOST_TABLES and met.mean() < wanted:
        tables += 1  # tables are seeded by their number: those so far stay as they are
        one = [bucket_keys(x, Plan(dims, hashes, last, 1, asks, seed), tables - 1) for x in (a, b)]
        met |= meet(*one)[:, 0]
    return Plan(dims, hashes, last, tables, asks, seed)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their magnitude."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keyed(batches: Iterator[pa.RecordBatch], rows: int, cosine: float, wanted: float, asks: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Adds ``width`` and ``keys`` (tables x asks, flattened)."""
    for b in batches:
        sizes = pa.compute.list_value_length(b.column("vector")).to_numpy(zero_copy_only=False)
        for width in np.unique(sizes):
            part = b.filter(pa.array(sizes == width))
            plan = choose(rows, int(width), cosine, wanted, asks, seed)
            for at in range(0, len(part), 2048):
                some = part.slice(at, 2048)
                keys = bucket_keys(unit(matrix(some.column("vector")).astype(np.float64)), plan).reshape(len(some), -1)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.ravel())
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(some), width, np.int32)), lists], [*some.schema.names, "width", "keys"])


def run_pairs(first: np.ndarray, size: np.ndarray, base: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (left, right) of places inside runs whose ``base`` rows come first; left is a base row.

    Runs start at ``first`` and are ``size`` long; at most about ``PAIRS_AT_ONCE`` pairs come at once.
    """
    left = np.concatenate([np.arange(f, f + b) for f, b in zip(first, base, strict=True)]) if len(first) else np.empty(0, np.int64)
    partners = np.repeat(first + size, base) - left - 1
    ends = np.cumsum(partners)
    at = 0
    while at < len(left):
        begin = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + PAIRS_AT_ONCE, "right")))
        n = partners[at:stop]
        l = np.repeat(left[at:stop], n)
        yield l, l + 1 + np.arange(len(l)) - np.repeat(np.cumsum(n) - n, n)
        at = stop


def verified(x: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float, known: np.ndarray | None = None) -> np.ndarray:
    """Which pairs of unit rows have the cosine; sums near the limit are made again in one fixed way."""
    value = np.einsum("ij,ij->i", x[left], x[right]) if known is None else known
    near = np.flatnonzero(np.abs(value - cosine) < 1e-9)
    if len(near):
        value = value.copy()
        value[near] = np.einsum("ij,ij->i", x[left[near]], x[right[near]])
    return value >= cosine


def close_pairs(x: np.ndarray, first: np.ndarray, size: np.ndarray, base: np.ndarray, chunk: np.ndarray, mixed: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs of all runs.  ``mixed`` runs hold two chunks of a bucket, of which only pairs across count."""
    small = size <= SMALL_RUN
    for left, right in run_pairs(first[small], size[small], base[small]):
        ok = verified(x, left, right, cosine)
        ok &= ~(np.repeat(mixed, size)[left] & (chunk[left] == chunk[right]))
        yield left[ok], right[ok]
    for f, n, b, cross in zip(first[~small], size[~small], base[~small], mixed[~small], strict=True):
        for at in range(0, b, 256):
            rows = np.arange(f + at, f + min(at + 256, b))
            products = x[rows] @ x[f : f + n].T
            row, col = np.nonzero(products >= cosine - 1e-9)
            left, right = rows[row], f + col
            ok = (left < right) & verified(x, left, right, cosine, products[row, col])
            if cross:
                ok &= chunk[left] != chunk[right]
            yield left[ok], right[ok]


def first_meeting(keys: np.ndarray, left: np.ndarray, right: np.ndarray, key: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether this bucket is the first in which a pair meets, so that it counts once.

    Tables are ordered; inside one table the two own buckets are, by number.
    """
    a, b = keys[left], keys[right]
    out = ~(meet(a, b) & (np.arange(keys.shape[1]) < table[:, None])).any(axis=1)
    at = np.arange(len(left))
    own_a, own_b = a[at, table, 0], b[at, table, 0]
    both = (a[at, table] == own_b[:, None]).any(axis=1) & (b[at, table] == own_a[:, None]).any(axis=1)
    return out & (~both | (key == np.minimum(own_a, own_b)))


def join_labels(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Labels (places of roots) after linking the pairs."""
    while True:
        a, b = label[left], label[right]
        apart = a != b
        if not apart.any():
            return label
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _links(t: pa.Table, cosine: float, asks: int) -> pa.Table:
    """(id, links, root) of the rows of some buckets: links that meet here first, and a spanning forest."""
    t = t.sort_by([("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("asking", "ascending"), ("row", "ascending")])
    row, ids, weight, key, low, high, chunk = (t.column(c).to_numpy() for c in ("row", "id", "weight", "key", "low", "high", "chunk"))
    asking = t.column("asking").to_numpy(zero_copy_only=False)
    x = unit(matrix(t.column("vector")).astype(np.float64))
    keys = matrix(t.column("keys")).reshape(len(t), -1, asks)
    starts = np.ones(len(t), bool)
    starts[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(t)))
    base = np.add.reduceat((~asking).astype(np.int64), first)
    _, place = np.unique(row, return_inverse=True)  # a row lies in several buckets
    label, count = np.arange(place.max() + 1), np.zeros(place.max() + 1)
    table = np.argmax((keys == key[:, None, None]).any(axis=2), axis=1)
    for left, right in close_pairs(x, first, size, base, chunk, (low != high)[first], cosine):
        for at in range(0, len(left), PAIRS_AT_ONCE):
            l, r = left[at : at + PAIRS_AT_ONCE], right[at : at + PAIRS_AT_ONCE]
            once = first_meeting(keys, l, r, key[l], table[l])
            l, r = l[once], r[once]
            count += np.bincount(place[l], weight[r], len(count)) + np.bincount(place[r], weight[l], len(count))
            label = join_labels(label, place[l], place[r])
    some = np.zeros(len(label), np.int64)
    some[place] = np.arange(len(t))  # a place's row of the table
    linked = np.flatnonzero(count)
    return pa.table({"row": row[some[linked]], "id": ids[some[linked]], "links": count[linked].astype(np.int64), "root": ids[some[label[linked]]]})


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
    wanted: float = 0.98, probes: int = 4, tile_rows: int = 1024, cell_rows: int = 4096, seed: int = 13,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Pairs of at least ``cosine`` are linked if they meet in a bucket; the number of tables
    is chosen so that pairs at exactly that cosine meet with a chance of ``wanted``, nearer
    ones more surely.  ``n_links``: other rows linked directly; ``component_id``: the
    smallest id reachable; ``kept``: the id is that one.

    Equal vectors are one candidate with their number as weight, and always linked.  Rows
    of a bucket of more than ``tile_rows`` are dealt into chunks and meet as pairs of
    chunks, so no task holds a whole hot bucket; what leaves a task is a count and one
    spanning link a row.

    Rows whose vector is null, zero or holds null or non-finite components link with
    nothing: n_links 0, their own component.  Vectors of different lengths are never
    linked.  Rows of one id are one node of the link graph, each with links of its own; a
    row without an id links with nothing and has no component (kept is null).  An empty
    table gives no rows.
    """
    v = F.col(vector_col)
    fits = F.col(id_col).isNotNull() & usable(v, zero=False)
    digest = lambda k: F.when(fits, F.xxhash64(v, F.lit(k)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, v).alias("vector"), digest(1).alias("h1"), digest(2).alias("h2"))
    rows, _ = cut_lineage(rows)
    distinct = rows.where("vector is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.any_value("vector").alias("vector"))
    distinct, n = cut_lineage(distinct.withColumn("row", F.monotonically_increasing_id()))
    asks = probes + 1
    kind = distinct.schema["vector"].dataType.simpleString()
    hashed = distinct.select("row", "id", "weight", "vector").mapInArrow(
        partial(_keyed, rows=n, cosine=cosine, wanted=wanted, asks=asks, seed=seed), f"row long, id long, weight long, vector {kind}, width int, keys array<long>"
    )
    hashed, _ = cut_lineage(hashed)
    places = hashed.select("row", "width", F.posexplode("keys").alias("pos", "key")).where("key >= 0")
    places = places.select("row", "width", "key", (F.col("pos") % asks > 0).alias("asking"))
    buckets = places.groupBy("width", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("asking")).alias("own")).where("n > 1 and own > 0")
    chunks = F.ceil(F.col("n") / tile_rows).cast("int")
    met = places.join(buckets, ["width", "key"]).select("row", "width", "key", "asking", chunks.alias("chunks"))
    met, _ = cut_lineage(met.withColumn("chunk", F.pmod(F.xxhash64("row", "key"), F.col("chunks")).cast("int")))
    copies = met.agg(F.sum(F.col("chunks").cast("long"))).first()[0] or 0
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("row", "key", "asking", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    cell = F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(1, ceil(copies / cell_rows)))).alias("cell")
    found = dealt.join(hashed, "row").select("*", cell).groupBy("width", "cell").applyInArrow(
        lambda t: _links(t, cosine, asks), "row long, id long, links long, root long"
    )
    found, _ = cut_lineage(found)
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    counts = distinct.select("row", "h1", "h2", "id", "weight").join(links, "row", "left").select("h1", "h2", "id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own, _ = cut_lineage(rows.drop("vector").join(counts, ["h1", "h2"], "left").select("vec_id", "id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    copies_of = own.where("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    of = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).union(copies_of))
    least = F.coalesce("root", "vec_id")
    return own.join(of.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", "n_links", least.alias("component_id"), (F.col("vec_id") == least).alias("kept"))
