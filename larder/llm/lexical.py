"""Ranked lexical search by MaxScore with pair bounds.

The index holds, per block of documents, the impacts of every query term and, for pairs of
common terms that some query holds, the intersection list with the largest joint impact.
A query's terms are paired; a pair adds at most the larger of its two maxima and its joint
maximum, which is less than their sum wherever no document has both at their best.  The
bounds order the lists: those that together cannot lift a document over the threshold are
only looked up for documents that the others brought in, and blocks whose bounds stay
under the threshold are never opened.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import cut_lineage
from larder.llm.topk import best_first

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = re.compile(WORD)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)
BLOCK_DOCS = 4096
SEED_BLOCKS = 16  # one block in so many is searched first, for thresholds
DOCS, NO = -1, -1  # list "terms": the block's document ids; no second term


def terms_of(text: Column) -> Column:
    """Terms of a text in order, with repeats; null has none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array())


def query_blocks(items: DataFrame, id_col: str, text_col: str, most_items: int, most_chars: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Lists of (item, distinct terms), each of at most ``most_items`` items and about ``most_chars`` characters of terms.

    Rows of one id are one item with the terms of all; items without terms find nothing.
    """
    held = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.explode(F.array_distinct(terms_of(F.col(text_col)))).alias("term")).distinct()
    block, chars = [], 0
    for row in held.groupBy("item").agg(F.sort_array(F.collect_list("term")).alias("terms")).orderBy("item").toLocalIterator():
        size = sum(map(len, row["terms"]))
        if block and (len(block) >= most_items or chars + size > most_chars):
            yield block
            block, chars = [], 0
        block.append((row["item"], row["terms"]))
        chars += size
    if block:
        yield block


def _counted(batches: Iterator[pa.RecordBatch], numbers: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, terms, tfs): a document's number of terms, and the query terms in it."""
    for b in batches:
        n, ends, terms, tfs = [], [0], [], []
        for text in b.column("text"):
            words = WORDS.findall((text.as_py() or "").translate(LOWERED))
            held = Counter([k for k in map(numbers.get, words) if k is not None])
            n.append(len(words))
            terms.extend(held)
            tfs.extend(held.values())
            ends.append(len(terms))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])


@dataclass
class Statistics:
    """What scores need of the corpus; ``weights`` by term number."""

    docs: int
    length: int
    weights: np.ndarray

    def impacts(self, term: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.docs) // self.length
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def statistics(counted: DataFrame, n_terms: int) -> Statistics:
    """Counts over all documents; what comes to the driver is a number per query term."""
    whole = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    docs, length = whole[0] or 0, whole[1] or 0
    weights = np.zeros(n_terms, np.int64)
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * docs + 2).cast("double") / (2 * F.col("df") + 1)))
    for row in df.select("term", weight.cast("long").alias("w")).collect():
        weights[row["term"]] = row["w"]
    return Statistics(docs, max(length, 1), weights)


LISTS = "block long, first int, second int, docs array<int>, impacts array<long>, top long"


def _lists(batches: Iterator[pa.RecordBatch], stats: Statistics, pairs: np.ndarray, block_docs: int) -> Iterator[pa.RecordBatch]:
    """Posting lists, pair lists and document ids of blocks of at most ``block_docs`` documents."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for at in range(0, len(batch), block_docs):
            yield from index_block(batch.slice(at, block_docs), number, stats, pairs)
            number += 1


def index_block(b: pa.RecordBatch, number: int, stats: Statistics, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    sizes = pa.compute.list_value_length(b.column("terms")).to_numpy()
    doc = np.repeat(np.arange(len(b), dtype=np.int32), sizes)
    term, tf = b.column("terms").flatten().to_numpy(), b.column("tfs").flatten().to_numpy()
    impact = stats.impacts(term, tf, b.column("n").to_numpy()[doc])
    order = np.lexsort((doc, term))
    term, doc, impact = term[order], doc[order], impact[order]
    bounds = np.searchsorted(term, np.arange(len(stats.weights) + 1))
    rows: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for t in np.unique(term):
        rows.append((int(t), NO, doc[bounds[t] : bounds[t + 1]], impact[bounds[t] : bounds[t + 1]]))
    for x, y in pairs:
        i, j = slice(bounds[x], bounds[x + 1]), slice(bounds[y], bounds[y + 1])
        both, at_x, at_y = np.intersect1d(doc[i], doc[j], assume_unique=True, return_indices=True)
        if len(both):
            rows.append((int(x), int(y), both, impact[i][at_x] + impact[j][at_y]))
    if rows:
        rows.append((DOCS, NO, np.arange(len(b), dtype=np.int32), b.column("doc_id").to_numpy()))
    for at in range(0, len(rows), 512):
        some = rows[at : at + 512]
        ends = np.cumsum([0] + [len(r[2]) for r in some]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(some), number, np.int64)), pa.array([r[0] for r in some], pa.int32()), pa.array([r[1] for r in some], pa.int32()),
                pa.ListArray.from_arrays(ends, np.concatenate([r[2] for r in some])), pa.ListArray.from_arrays(ends, np.concatenate([r[3] for r in some])),
                pa.array([int(r[3].max()) for r in some], pa.int64()),
            ],
            ["block", "first", "second", "docs", "impacts", "top"],
        )


List = tuple[np.ndarray, np.ndarray, int]


@dataclass
class Block:
    """One block's lists by term and by pair."""

    doc_ids: np.ndarray
    terms: dict[int, List] = field(default_factory=dict)
    pairs: dict[tuple[int, int], List] = field(default_factory=dict)

    def bound(self, unit: tuple[int, ...]) -> int:
        """The most a document can get from a term or a pair."""
        tops = [self.terms[t][2] for t in unit]
        if len(unit) == 1:
            return tops[0]
        return max(*tops, self.pairs[unit][2] if unit in self.pairs else 0)


def paired(terms: list[int], pairs: set[tuple[int, int]]) -> list[tuple[int, ...]]:
    """A query's terms as the pairs that have lists, and single terms."""
    out, left = [], set(terms)
    for x in terms:
        for y in terms:
            if x in left and y in left and (x, y) in pairs:
                out.append((x, y))
                left -= {x, y}
    return out + [(t,) for t in terms if t in left]


def search_block(block: Block, units: list[tuple[int, ...]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the block that may be among a query's k best: scores of at least ``least`` and at least the block's k-th.

    Units are opened from the largest bound down.  ``rest`` bounds what the unopened can
    add: once it is under the threshold no document outside the candidates can enter, and
    candidates that cannot reach the threshold with it are let go.
    """
    present = [u for u in (tuple(t for t in u if t in block.terms) for u in units) if u]
    ranked = sorted(((block.bound(u), u) for u in present), reverse=True)
    rest = sum(b for b, _ in ranked)
    score = np.zeros(len(block.doc_ids), np.int64)
    least = max(least, 1)
    for unit in present:  # k documents that have both terms get that much at least
        joint = block.pairs[unit][1] if unit in block.pairs else ()
        if len(joint) >= k:
            least = max(least, int(np.partition(joint, len(joint) - k)[len(joint) - k]))
    candidates = None
    for bound, unit in ranked:
        if candidates is None and rest < least:
            candidates = np.flatnonzero(score)
        if candidates is not None:
            candidates = candidates[score[candidates] + rest >= least]
            if not len(candidates):
                break
        rest -= bound
        for t in unit:
            docs, impacts, _ = block.terms[t]
            if candidates is None:
                score[docs] += impacts
            elif len(docs):
                at = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
                score[candidates] += np.where(docs[at] == candidates, impacts[at], 0)
        if candidates is None and len(score) > k:
            least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
    found = np.flatnonzero(score >= least) if candidates is None else candidates[score[candidates] >= least]
    return found, score[found]


def _search(t: pa.Table, queries: list[tuple[int, list[tuple[int, ...]]]], least: dict[int, int], k: int) -> pa.Table:
    first, second = t.column("first").to_pylist(), t.column("second").to_pylist()
    tops, docs, impacts = t.column("top").to_pylist(), t.column("docs"), t.column("impacts")
    block = Block(np.empty(0, np.int64))
    for i, (x, y) in enumerate(zip(first, second, strict=True)):
        values = impacts[i].values.to_numpy()
        if x == DOCS:
            block.doc_ids = values
            continue
        entry = (docs[i].values.to_numpy(), values, tops[i])
        if y == NO:
            block.terms[x] = entry
        else:
            block.pairs[x, y] = entry
    out: list[list[np.ndarray]] = [[], [], []]
    for item, units in queries:
        found, scores = search_block(block, units, k, least.get(item, 1))
        if len(found) > k:  # whatever ties with the k-th has stayed
            best = np.lexsort((block.doc_ids[found], -scores))[:k]
            found, scores = found[best], scores[best]
        for column, values in zip(out, (np.full(len(found), item, np.int64), block.doc_ids[found], scores), strict=True):
            column.append(values)
    whole = [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]
    return pa.table(dict(zip(("query_id", "vec_id", "score"), whole, strict=True)))


def common_pairs(queries: list[list[int]], weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs to index: each query's terms from the commonest, two by two, first the smaller number."""
    out = set()
    for terms in queries:
        by_weight = sorted(terms, key=lambda t: (weights[t], t))
        out |= {tuple(sorted(p)) for p in zip(by_weight[::2], by_weight[1::2], strict=False)}
    return sorted(out)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    most_items: int = 512, most_chars: int = 1 << 20, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Every document counts for the statistics and is indexed, whole; of a document only the
    terms that some query holds are kept.  Queries are handled in blocks of bounded size;
    a first search of every sixteenth block of documents gives each query a threshold that
    the search of all blocks starts from (the k-th best of any documents is a lower bound,
    so results do not depend on it).

    Null texts have no terms; texts are read whole, whatever their length.  A document
    without an id counts but is never returned; rows of one id are documents of their own.
    Items without an id or terms find nothing; rows of one item are one query.  Equal
    scores rank by ascending doc_id; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for queries in query_blocks(items, item_col, item_text_col, most_items, most_chars):
        numbers: dict[str, int] = {}
        held = [[numbers.setdefault(t, len(numbers)) for t in terms] for _, terms in queries]
        counted, _ = cut_lineage(texts.mapInArrow(partial(_counted, numbers=numbers), "doc_id long, n long, terms array<int>, tfs array<long>"))
        stats = statistics(counted, len(numbers))
        pairs = common_pairs(held, stats.weights)
        units = [(item, paired(terms, set(pairs))) for (item, _), terms in zip(queries, held, strict=True)]
        named = counted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0))
        index = named.mapInArrow(partial(_lists, stats=stats, pairs=np.array(pairs, np.int64).reshape(-1, 2), block_docs=block_docs), LISTS)
        index, _ = cut_lineage(index)

        def best(lists: DataFrame, least: dict[int, int], units: list = units) -> DataFrame:
            found = lists.groupBy("block").applyInArrow(lambda t: _search(t, units, least, k), "query_id long, vec_id long, score long")
            return found.withColumn("rank", F.row_number().over(best_first(k))).where(F.col("rank") <= k)

        seed = best(index.where(F.pmod(F.xxhash64("block"), F.lit(SEED_BLOCKS)) == 0), {})
        least = {r["query_id"]: r["score"] for r in seed.where(F.col("rank") == k).collect()}  # a row per query of the block
        part = best(index, least).select(F.col("query_id").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("doc_id"), "score")
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
