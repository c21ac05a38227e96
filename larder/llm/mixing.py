"""Mixing sources to target weights by proportionate-fair scheduling.

A source's text is a queue of blocks of ``block_chars`` characters.  With weight w of a total
W, its block j may be sent from slot floor(j W / w) on and must be sent before slot
ceil((j + 1) W / w); each slot goes to the eligible block with the earliest deadline.  As the
rates sum to one, no deadline is missed, so after every slot each source that still has text
is less than one block away from its weight, however long the schedule: nothing is rounded.

The one long schedule is worked out in spans, each by itself.  At slot t a source has sent
floor(t w / W) blocks or one more.  Giving the one more to the earliest deadlines is a state
from which no deadline is missed either (a block sent too early can change places with an
earlier one), and two such states lead to the same choices once the blocks they differ in are
due.  So a span starts one span early in that state and keeps its second half; with spans as
long as the longest time between release and deadline, that is the schedule begun at slot 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.prefix import running_before

#: Slots decided in one inner fold; what it chose is appended at once.
STEP = 64


def weights(sizes: DataFrame, targets: DataFrame | None, block_chars: int) -> DataFrame:
    """(queue, weight, total, blocks, ends): the weights as given, and the slot by which a queue is sent.

    ``sizes``: (queue, size).  ``targets``: (queue, weight), positive whole numbers; queues
    left out get weight 1.  Without targets the weight is the square root of the size, which
    draws small sources forward without forgetting the large ones.
    """
    if targets is None:
        weighted = sizes.withColumn("weight", F.greatest(F.floor(F.sqrt("size")), F.lit(1)).cast("long"))
    else:
        given = targets.where("weight > 0").groupBy(F.coalesce(F.col("queue"), F.lit("")).alias("queue")).agg(F.sum("weight").cast("long").alias("given"))
        weighted = sizes.join(given, "queue", "left").withColumn("weight", F.coalesce("given", F.lit(1).cast("long")))
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))  # one row per queue
    counted = weighted.withColumns({"total": total, "blocks": F.expr(f"(size + {block_chars - 1}) div {block_chars}")})
    return counted.select("queue", "weight", "total", "blocks", F.expr("(blocks * total + weight - 1) div weight").alias("ends"))


def schedule(weighted: DataFrame, span: int = 1024) -> DataFrame:
    """(queue, block, release, deadline, slot) of all blocks released while two queues have blocks left.

    Earliest deadline first; ties go to the first queue by name.  A span of at least ``span``
    slots is one row with an entry per queue, and spans run side by side.  Of the last queue
    alone nothing is left to decide (see ``alone``).
    """
    entry = F.struct("queue", "weight", "blocks", "ends")
    queues = weighted.agg(F.sort_array(F.collect_list(entry)).alias("queues"), F.max("total").alias("total"), F.min("weight").alias("least"))
    shaped = queues.where("size(queues) > 1").withColumns(
        {
            "span": F.greatest(F.expr("total div least + 2"), F.lit(span).cast("long")),
            "both": F.expr("sort_array(transform(queues, q -> q.ends), false)[1]"),
        }
    )
    parts = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = shaped.withColumn("nth", F.explode(F.expr("sequence(CAST(0 AS BIGINT), both div span + 1)"))).repartition(parts, "nth")
    late = "((({0}) + 1) * total + q.weight - 1) div q.weight"
    begun = f"""transform(queues, (q, i) -> struct({late.format('(first * q.weight) div total')} AS deadline, i AS i,
        (first * q.weight) div total AS sent, (first * q.weight) % total > 0 AS part))"""
    ahead = "slice(array_sort(transform(filter(begun, b -> b.part), b -> struct(b.deadline AS deadline, b.i AS i))), 1, CAST(first - aggregate(begun, CAST(0 AS BIGINT), (n, b) -> n + b.sent) AS INT))"
    sent = f"transform(begun, b -> b.sent + IF(array_contains(transform({ahead}, a -> a.i), b.i), 1, 0))"
    starts = spans.withColumn("first", F.expr("greatest(nth - 1, 0) * span")).withColumn("begun", F.expr(begun)).withColumn("sent", F.expr(sent))
    ready = f"""filter(transform(queues, (q, i) -> struct({late.format('now.sent[i]')} AS deadline, i AS i,
        (now.sent[i] * total) div q.weight <= t AS open)), b -> b.open)"""
    pick = f"array_min(transform({ready}, b -> struct(b.deadline AS deadline, b.i AS i))).i"
    none = "CAST(array() AS ARRAY<STRUCT<i: INT, block: BIGINT>>)"
    step = f"""aggregate(sequence(from, least(from + {STEP - 1}, (nth + 1) * span - 1)), struct(state.sent AS sent, {none} AS picks),
        (now, t) -> transform(array({pick}), p -> struct(transform(now.sent, (n, i) -> IF(i = p, n + 1, n)) AS sent, concat(now.picks, array(struct(p AS i, now.sent[p] AS block))) AS picks))[0])"""
    fold = f"""aggregate(sequence(first, (nth + 1) * span - 1, CAST({STEP} AS BIGINT)), struct(sent AS sent, {none} AS picks),
        (state, from) -> transform(array({step}), done -> struct(done.sent AS sent, concat(state.picks, done.picks) AS picks))[0], state -> state.picks)"""
    picked = starts.withColumn("picks", F.expr(fold)).select("queues", "total", "first", "nth", "span", F.posexplode("picks").alias("pos", "pick"))
    slots = picked.withColumn("slot", F.expr("first + pos")).where("slot >= nth * span").withColumn("q", F.expr("queues[pick.i]"))
    return slots.where("pick.block < q.blocks").select(
        F.expr("q.queue AS queue"), F.expr("pick.block AS block"),
        F.expr("(pick.block * total) div q.weight AS release"), F.expr(f"{late.format('pick.block')} AS deadline"), "slot",
    )


def alone(weighted: DataFrame) -> DataFrame:
    """(queue, weight, total, alone): a block released from slot ``alone`` on has no rival left.

    Such blocks are sent in the last slot before their deadline: in order, each in its own
    slot, and after all others.
    """
    ends = F.sort_array(F.collect_list("ends").over(Window.partitionBy(F.lit(0))), asc=False)  # one entry per queue
    return weighted.select("queue", "weight", "total", F.coalesce(F.get(ends, F.lit(1)), F.lit(0)).alias("alone"))


def mix(
    docs: DataFrame, targets: DataFrame | None = None, block_chars: int = 65_536, span: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False,
) -> DataFrame:
    """(doc_id, source, block, release, deadline, slot, offset) of every row, none left out.

    Sorting by (slot, offset) is the mixture: ``offset`` is the place inside the source's
    block.  A source's documents queue in order of a digest of their id and text; a document
    lies in the block where it begins, however long it is.  When a source runs dry its later
    slots stay empty and the others close ranks in the same order; work grows with the slots,
    empty ones too, until only one source is left.

    Null sources queue under the empty name, null ids and texts digest as empty ones, null and
    empty texts count one character; equal rows follow each other; an empty table gives no
    rows.  With ``carry`` the input row comes along whole as struct ``doc`` (so that no column
    name can clash).  A source with a third of all rows is cut into digest buckets.
    """
    digest = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    columns: list[Column] = [
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"),
        F.greatest(F.coalesce(F.length(text_col), F.lit(0)), F.lit(1)).cast("long").alias("size"), digest.alias("digest"),
    ]
    digits = 0
    rows = docs.count()
    while 8192 * 16**digits < rows:
        digits += 1
    queued = docs.select(*columns, *([F.struct("*").alias("doc")] if carry else []), F.substring(digest, 1, digits).alias("bucket"))
    sizes = queued.groupBy("queue").agg(F.sum("size").alias("size"))
    weighted = weights(sizes, targets, block_chars)
    placed = running_before(queued, ["queue"], "bucket", ["digest", "size"], "size", "before").withColumn("block", F.expr(f"before div {block_chars}"))
    timed = placed.join(alone(weighted), "queue").withColumns(
        {"release": F.expr("(block * total) div weight"), "deadline": F.expr("((block + 1) * total + weight - 1) div weight")}
    )
    at = timed.join(schedule(weighted, span).select("queue", "block", "slot"), ["queue", "block"], "left")
    return at.select(
        "doc_id", F.col("queue").alias("source"), "block", "release", "deadline",
        F.when(F.col("release") >= F.col("alone"), F.col("deadline") - 1).otherwise(F.col("slot")).alias("slot"),
        F.expr(f"before % {block_chars}").alias("offset"), *(["doc"] if carry else []),
    )
