"""Prefix trie of conversations by fixed-length block hashing.

Turns are cut into blocks of a fixed number.  Conversations are grouped by the digests of
their successive blocks first: a block that all conversations behind a prefix share gives
its turns' nodes at once.  Only where several different blocks follow the same prefix are
turn boundaries told apart, and there on the distinct blocks, not on the conversations.

A prefix is named by the exclusive or of digests of its (position, role, text), twice 64
bits, so that running over a conversation needs no order but that of its blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import cut_lineage
from larder.llm.prefix import running_before

NODE = ["depth", "a", "b"]
BUCKET_BLOCKS = 1024  # blocks of a conversation that are run over together


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, d1, d2, size): turns in order, null turn numbers first, as digests and code points.

    Turns of one number are ordered by their digests.  Rows are range-partitioned by the
    order itself, so a conversation of any length is many tasks.  Null roles and texts are
    empty; rows without a conversation are left out.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(F.lit(1), role, text).alias("d1"), F.xxhash64(F.lit(2), role, text).alias("d2"), F.length(text).cast("long").alias("size"),
    )
    dealt, _ = cut_lineage(rows.repartitionByRange("conv", "turn", "d1", "d2").withColumn("part", F.spark_partition_id()))
    placed = running_before(dealt.withColumn("one", F.lit(1)), ["conv"], "part", [F.asc_nulls_first("turn"), "d1", "d2"], "one", "before")
    return placed.select("conv", (F.col("before") + 1).alias("pos"), "d1", "d2", "size")


def share_beginnings(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns, conversations): each conversation begins with the first turns of its group's head.

    Conversation c keeps its own turns after its first h = crc32(c) % ``most``; before them
    come the first h turns of conversation c - c % ``group`` (all if it has fewer).  The
    head's few turns meet at most 2 * ``group`` conversations.
    """
    counts, _ = cut_lineage(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    h = F.crc32(F.col("conv").cast("string")) % most
    heads = counts.where(F.col("conv") % group == 0).select(F.col("conv").alias("head"), F.col("n").alias("head_n"))
    plan = counts.select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("head")).join(heads, "head", "left")
    plan = plan.select("conv", "head", "h", F.least("h", F.coalesce("head_n", F.lit(0))).alias("m"))
    first = turns.where((F.col("conv") % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv", "head")
    before = plan.join(first, "head").where("pos <= h").select("conv", "pos", "d1", "d2", "size")
    after = turns.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "d1", "d2", "size")
    return before.union(after), counts.select("conv")


def blocks_of(turns: DataFrame, block: int) -> DataFrame:
    """(conv, k, turns, xa, xb, size, pa, pb, before): a conversation's blocks; p. and before tell of all earlier ones."""
    salted = turns.select("conv", F.floor((F.col("pos") - 1) / block).alias("k"), F.struct("pos", F.xxhash64(F.lit(3), "pos", "d1", "d2").alias("a"), F.xxhash64(F.lit(4), "pos", "d1", "d2").alias("b"), "size").alias("t"))
    blocks = salted.groupBy("conv", "k").agg(F.array_sort(F.collect_list("t")).alias("turns"), F.bit_xor("t.a").alias("xa"), F.bit_xor("t.b").alias("xb"), F.sum("t.size").alias("size"))
    blocks = blocks.withColumn("bucket", F.floor(F.col("k") / BUCKET_BLOCKS))
    over = lambda w: [F.coalesce(f(c).over(w), F.lit(0)) for f, c in ((F.bit_xor, "xa"), (F.bit_xor, "xb"), (F.sum, "size"))]
    totals = blocks.groupBy("conv", "bucket").agg(F.bit_xor("xa").alias("xa"), F.bit_xor("xb").alias("xb"), F.sum("size").alias("size"))
    sa, sb, ss = over(Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("conv", "bucket", sa.alias("sa"), sb.alias("sb"), ss.alias("ss"))
    ia, ib, isize = over(Window.partitionBy("conv", "bucket").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    joined = blocks.join(starts, ["conv", "bucket"])
    return joined.select("conv", "k", "turns", "xa", "xb", "size", F.col("sa").bitwiseXOR(ia).alias("pa"), F.col("sb").bitwiseXOR(ib).alias("pb"), (F.col("ss") + isize).alias("before"))


BLOCK = ["k", "pa", "pb", "xa", "xb"]


def nodes_in(turns: Column, pa_: Column, pb: Column, before: Column) -> Column:
    """The prefixes ending inside a block: (depth, a, b, up_a, up_b, size, before)."""
    fold = lambda part, name, start: F.aggregate(part, start, lambda x, t: x.bitwiseXOR(t[name]))

    def node(t: Column, i: Column) -> Column:
        upto, above = F.slice(turns, 1, i + 1), F.slice(turns, 1, i)
        return F.struct(
            t["pos"].alias("depth"), fold(upto, "a", pa_).alias("a"), fold(upto, "b", pb).alias("b"), fold(above, "a", pa_).alias("up_a"), fold(above, "b", pb).alias("up_b"),
            t["size"].alias("size"), F.aggregate(above, before, lambda s, x: s + x["size"]).alias("before"),
        )

    return F.transform(turns, node)


def spread(groups: DataFrame, values: list[str], merged: list[Column]) -> DataFrame:
    """Nodes with the values of the distinct blocks they lie in.

    ``groups``: one row per distinct block behind a prefix (``BLOCK``, turns, before) with
    ``values``.  The block of a prefix that no other follows is all its nodes' only one;
    the others are taken apart, and nodes that siblings share ``merged``.
    """
    alone = groups.groupBy("k", "pa", "pb").agg(F.count(F.lit(1)).alias("siblings"), F.any_value(F.struct("xa", "xb", "turns", "before", *values)).alias("x")).where("siblings = 1")
    alone = alone.select("k", "pa", "pb", "x.*")
    apart = groups.join(alone.select(*BLOCK), BLOCK, "left_anti")
    taken = lambda df: df.select(F.explode(nodes_in(F.col("turns"), F.col("pa"), F.col("pb"), F.col("before"))).alias("node"), *values).select("node.*", *values)
    fixed = [F.any_value(c).alias(c) for c in ("up_a", "up_b", "size", "before")]
    refined = taken(apart).groupBy(*NODE).agg(*fixed, *merged)
    return taken(alone).select(*refined.columns).union(refined)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv) rows to (node, first conv, joined ids); a node may take several segments."""
    for batch in batches:
        if not len(batch):
            continue
        depth, a, b, conv = (batch.column(c).to_numpy() for c in (*NODE, "conv"))
        new = np.ones(len(batch), bool)
        new[1:] = (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        ids = [str(c) for c in conv.tolist()]
        joined = [",".join(ids[i:j]) for i, j in zip(at, [*at[1:], len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (depth, a, b, conv)] + [pa.array(joined)], [*NODE, "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments to each node's SHA-256; only one digest is open at a time."""
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])
    open_, digest = None, None
    for batch in batches:
        done = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if node == open_:
                digest.update(b",")
            else:
                if open_ is not None:
                    done.append((*open_, digest.hexdigest()))
                open_, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*open_, digest.hexdigest())], schema=schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends): SHA-256 of each node's ending conversations, ascending, comma-joined.

    The ids are joined in range-partitioned pieces; the last step only streams bytes.
    """
    pieces = ends.select(*NODE, "conv").repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInArrow(_segments, "depth long, a long, b long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashes, "depth long, a long, b long, ends string")


def prefix_trie(turns: DataFrame, conversations: DataFrame, block: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per node.

    ``turns``: (conv, pos from 1, d1, d2, size); ``conversations``: (conv), those without
    turns included.  A node is a distinct beginning; its conv_id is its smallest member.
    Subtree sums come from the members alone: what all turns below weigh less what each
    conversation weighs where it is a node's smallest member (``own``), so no node is
    joined with its ancestors.  Without conversations there is no root and no row.
    """
    blocks, _ = cut_lineage(blocks_of(turns, block))
    whole = blocks.groupBy("conv").agg(F.sum(F.size("turns")).cast("long").alias("depth"), F.bit_xor("xa").alias("a"), F.bit_xor("xb").alias("b"), F.sum("size").alias("total"))
    zero = lambda *names: [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]
    ends, _ = cut_lineage(conversations.join(whole, "conv", "left").select("conv", *zero("depth", "a", "b", "total")))

    groups = blocks.groupBy(*BLOCK).agg(F.any_value("turns").alias("turns"), F.any_value("before").alias("before"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("low"))
    groups, _ = cut_lineage(groups)
    found = spread(groups, ["n", "low"], [F.sum("n").alias("n"), F.min("low").alias("low")])
    root = ends.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low")).where("n > 0")
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b")]
    root = root.select(*none, *[F.lit(None).cast("long").alias(c) for c in ("up_a", "up_b")], *[F.lit(0).cast("long").alias(c) for c in ("size", "before")], "n", "low")
    nodes, _ = cut_lineage(found.union(root))
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count(F.lit(1)).alias("kids"))
    nodes, _ = cut_lineage(nodes.join(kids, NODE, "left").withColumn("kids", F.coalesce("kids", F.lit(0))))

    own = nodes.groupBy(F.col("low").alias("conv")).agg(F.sum("size").alias("own"), F.count_if(F.col("kids") == 0).alias("leaf"))
    worth = ends.join(own, "conv", "left").select("conv", "total", *zero("own", "leaf"))
    worth, _ = cut_lineage(worth)
    sums = ["total", "own", "leaf"]
    added = [F.sum(c).alias(c) for c in sums]
    least = F.min(F.struct("conv", F.col("total").alias("total0"), F.col("own").alias("own0"))).alias("least")
    weighed = blocks.join(worth, "conv").groupBy(*BLOCK).agg(F.any_value("turns").alias("turns"), F.any_value("before").alias("before"), *added, least)
    weighed, _ = cut_lineage(weighed)
    below = spread(weighed, [*sums, "least"], [*added, F.min("least").alias("least")]).select(*NODE, *sums, "least")
    below = below.union(worth.agg(*added, least).where("least is not null").select(*none, *sums, "least"))

    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("low").alias("parent"))
    out = nodes.join(up, ["depth", "up_a", "up_b"], "left").join(below, NODE).join(end_digests(ends), NODE, "left")
    smallest = F.col("least.total0") - F.col("before") - F.col("least.own0")
    saved = F.col("total") - F.col("n") * F.col("before") - F.col("own") - smallest
    return out.select(
        F.col("low").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.greatest("leaf", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
