"""Pairing images by their 64-bit fingerprints.

Two hashes that differ in at most d bits agree in some m - d of m parts of the bits, so they
meet under the key of those parts.  The number of parts follows the number of hashes: more
parts make longer keys, and so fewer chance meetings, for more keys a hash.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder import cut_lineage

BITS = 64


def masks_for(hashes: int, distance: int, most_masks: int = 128, crowd: int = 64) -> list[int]:
    """Masks of which any two hashes within ``distance`` bits agree under one.

    Parts are added until a key holds about ``crowd`` of evenly spread hashes, as long as
    there are at most ``most_masks`` masks.
    """
    best: list[int] = []
    for parts in range(distance + 1, BITS + 1):
        cuts = [round(k * BITS / parts) for k in range(parts + 1)]
        whole = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
        found = [sum(c) for c in combinations(whole, parts - distance)]
        if best and len(found) > most_masks:
            break
        best = found
        if hashes / 2 ** min(m.bit_count() for m in found) <= crowd:
            break
    return best


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def close_of(hashes: np.ndarray, weight: np.ndarray, part: np.ndarray, masks: np.ndarray, mask: int, distance: int, mixed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the hashes of one key: pairs that meet under no earlier mask, and a spanning forest.

    ``mixed``: the rows are two parts of a key, of which only pairs across count.
    """
    n = len(hashes)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, n, 512):
        rows = np.arange(at, min(at + 512, n))
        apart = hashes[rows, None] ^ hashes
        near = (np.bitwise_count(apart) <= distance) & (rows[:, None] < np.arange(n))
        if mixed:
            near &= part[rows, None] != part
        a, b = np.nonzero(near)
        for earlier in masks[:mask]:
            kept = (apart[a, b] & earlier) != 0
            a, b = a[kept], b[kept]
        a = rows[a]
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
    return links, root


def _pairs(t: pa.Table, masks: np.ndarray, distance: int) -> pa.Table:
    """(hash, links, other) of the keys of a cell."""
    t = t.sort_by([("mask", "ascending"), ("key", "ascending"), ("low", "ascending"), ("high", "ascending"), ("hash", "ascending")])
    mask, key, low, high, part, weight = (t.column(c).to_numpy() for c in ("mask", "key", "low", "high", "part", "weight"))
    stored = t.column("hash").to_numpy()
    hashes = stored.view(np.uint64)
    new = np.ones(len(t), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    starts = np.flatnonzero(new)
    links, other = np.zeros(len(t), np.int64), stored.copy()
    for s, e in zip(starts, np.append(starts[1:], len(t)), strict=True):
        if e - s > 1:
            links[s:e], root = close_of(hashes[s:e], weight[s:e], part[s:e], masks, int(mask[s]), distance, bool(low[s] != high[s]))
            other[s:e] = stored[s:e][root]
    kept = np.flatnonzero(links)
    return pa.table({"hash": stored[kept], "links": links[kept], "other": other[kept]})


def least_reachable(links: DataFrame) -> DataFrame:
    """(node, root): the least node each linked node reaches, by repeated minima.

    Every round a node takes the least root around it and then its root's root, so the
    number of rounds follows the logarithm of the longest path.
    """
    edges, n = cut_lineage(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).where("x <> y").distinct())
    roots, _ = cut_lineage(edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")))
    moved = n
    while moved:
        around = edges.join(roots.select(F.col("node").alias("y"), F.col("root").alias("near")), "y").groupBy(F.col("x").alias("node")).agg(F.min("near").alias("near"))
        # what a node sees, its root sees too
        told = roots.join(around, "node").groupBy(F.col("root").alias("node")).agg(F.min("near").alias("near"))
        lower = around.union(told).groupBy("node").agg(F.min("near").alias("near"))
        taken = roots.join(lower, "node", "left").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        taken, _ = cut_lineage(taken)
        jumped = taken.join(taken.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.least("root", "further").alias("root"), "was")
        found, _ = cut_lineage(jumped)
        moved = found.where("root <> was").limit(1).count()
        roots = found.select("node", "root")
    return roots


def fingerprint_duplicates(images: DataFrame, distance: int = 4, id_col: str = "id", hash_col: str = "fingerprint", tile_rows: int = 2048, cell_rows: int = 8192) -> DataFrame:
    """(id, class_id, n_links) of every image with a fingerprint.

    Linked are images whose fingerprints differ in at most ``distance`` bits; the class is
    the smallest id reachable over links, ``n_links`` the number of images linked directly.
    Equal fingerprints are one candidate with a weight; the rows of a crowded key are dealt
    into parts and meet as pairs of parts, so a task holds a bounded number of them.  Images
    without an id or fingerprint are left out; rows of one id are images of their own.
    """
    rows = images.where(F.col(id_col).isNotNull() & F.col(hash_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(hash_col).cast("long").alias("hash"))
    rows, _ = cut_lineage(rows)
    distinct, n = cut_lineage(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")))
    masks = masks_for(n, distance)
    keyed = distinct.select("hash", "weight", F.posexplode(F.array(*[F.col("hash").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("mask", "key"))
    crowded = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile_rows).cast("int")
    met, _ = cut_lineage(keyed.join(crowded, ["mask", "key"]).select("hash", "weight", "mask", "key", parts.alias("parts"), F.pmod(F.xxhash64("hash"), parts).cast("int").alias("part")))
    copies = met.agg(F.sum(F.col("parts").cast("long"))).first()[0] or 0
    dealt = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("hash", "weight", "mask", "key", "part", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"))
    cell = F.pmod(F.xxhash64("mask", "key", "low", "high"), F.lit(max(1, ceil(copies / cell_rows))))
    table = np.array(masks, np.uint64)
    found = dealt.withColumn("cell", cell).groupBy("cell").applyInArrow(lambda t: _pairs(t, table, distance), "hash long, links long, other long")
    found, _ = cut_lineage(found)
    links = found.groupBy("hash").agg(F.sum("links").alias("links"))
    of = least_reachable(found.select(F.col("hash").alias("a"), F.col("other").alias("b")))
    named = distinct.join(of.withColumnRenamed("node", "hash"), "hash", "left").withColumn("root", F.coalesce("root", "hash"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    whole = named.join(classes, "root").join(links, "hash", "left").select("hash", "class_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.join(whole, "hash").select("id", "class_id", "n_links")
