"""SimHash fingerprints and their groups by bit-sliced comparison.

Fingerprints are compared 64 at a time: a block of fingerprints is kept as bit planes (one
word holds one bit of 64 fingerprints), the differing bits of a probe are added with
carry-save adders into bitwise counters, and a (probe, word) pair is given up as soon as all
its 64 counters exceed the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations, repeat
from math import acos, ceil, comb, floor, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from larder import cut_lineage
from larder.llm.components import components

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHINGLES_AT_ONCE = 1 << 15
PAIR_WORDS_AT_ONCE = 1 << 18
PAIRS_AT_ONCE = 1 << 16
WIDE_WORDS = 16  # a wide fingerprint has 1024 bits; its first word is the one compared by planes


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, words: int, seed: int) -> bytes:
    """XXH64 (big-endian, joined) of each run of ``words`` words; ASCII case folded, ASCII white space splits."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(w) < words:
        return xxhash.xxh64_digest(b" ".join(w), seed) if w else b""
    return b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)), repeat(seed)))


def text_fingerprints(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """Per text the word whose bits are set in over half of its shingle hashes; zero without words."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = np.frombuffer(shingle_hashes(text, words, seed), np.uint8).reshape(-1, 8)
        votes = np.zeros(BITS, np.int64)
        for k in range(0, len(hashes), SHINGLES_AT_ONCE):
            votes += np.unpackbits(hashes[k : k + SHINGLES_AT_ONCE], axis=1).sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * votes > len(hashes)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per input row, ``fp`` the 64 bits as a long.

    Null and empty texts have fingerprint zero; a null id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = text_fingerprints(b.column(1).to_pylist(), words, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- bit-sliced comparison


def _full_adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, eights: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count (bit planes, lowest first) is greater than ``radius``."""
    planes = [ones, twos, fours, *eights]
    over, equal = np.zeros_like(ones), np.full_like(ones, FULL)
    if radius >> len(planes):
        return over
    for k in range(len(planes) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & planes[k]
        else:
            over = over | (equal & planes[k])
            equal = equal & ~planes[k]
    return over


def planes_of(fps: np.ndarray, word_of: np.ndarray, lane_of: np.ndarray, n_words: int) -> np.ndarray:
    """Bit planes: [bit, word], lane ``lane_of`` of a word holding that fingerprint's bit."""
    lanes = np.zeros((n_words, 64), np.uint64)
    lanes[word_of, lane_of] = fps
    bits = np.unpackbits(lanes.view(np.uint8).reshape(n_words, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(BITS, n_words)


def near_lanes(fps: np.ndarray, planes: np.ndarray, probe: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (probe row, word) the lanes within ``radius``; pairs without any are left out.

    Eight planes are added at a time: carry-save adders give ones, twos and fours, their
    carry goes to the counters of eights.  Pairs of which every lane exceeds the radius
    leave before the next eight planes are read.
    """
    zero = np.zeros(len(probe), np.uint64)
    ones, twos, fours, eights = zero, zero, zero, [zero.copy() for _ in range(4)]
    for first in range(0, BITS, 8):
        flip = [planes[first + k][word] ^ (np.uint64(0) - ((fps[probe] >> np.uint64(first + k)) & np.uint64(1))) for k in range(8)]
        ones, a = _full_adder(ones, flip[0], flip[1])
        ones, b = _full_adder(ones, flip[2], flip[3])
        twos, c = _full_adder(twos, a, b)
        ones, a = _full_adder(ones, flip[4], flip[5])
        ones, b = _full_adder(ones, flip[6], flip[7])
        twos, d = _full_adder(twos, a, b)
        fours, carry = _full_adder(fours, c, d)
        for k, e in enumerate(eights):
            eights[k], carry = e ^ carry, e & carry
        alive = _over(ones, twos, fours, eights, radius) != FULL
        if not alive.all():
            probe, word, ones, twos, fours = probe[alive], word[alive], ones[alive], twos[alive], fours[alive]
            eights = [e[alive] for e in eights]
    return probe, word, ~_over(ones, twos, fours, eights, radius)


def block_roots(fps: np.ndarray, block: np.ndarray, radius: int, accept: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Row of the first member of each row's component, components formed inside blocks.

    ``block`` numbers the blocks of the sorted rows 0, 1, ...  ``accept`` may turn down pairs
    of rows within the radius.  Work is done over chunks of (row, word) pairs, so memory is
    bounded whatever the blocks' sizes.
    """
    n = len(fps)
    size = np.bincount(block)
    first_row = np.cumsum(size) - size
    words = (size + 63) // 64
    first_word = np.cumsum(words) - words
    at = np.arange(n) - first_row[block]
    planes = planes_of(fps, first_word[block] + at // 64, at % 64, int(words.sum()))
    held = np.zeros(int(words.sum()), np.uint64)  # lanes in use
    np.bitwise_or.at(held, first_word[block] + at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
    start_of_word = np.repeat(first_row, words) + 64 * (np.arange(int(words.sum())) - np.repeat(first_word, words))

    root = np.arange(n)
    ends = np.cumsum(words[block])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIR_WORDS_AT_ONCE, "right")))
        per = words[block[lo:hi]]
        probe = np.repeat(np.arange(lo, hi), per)
        word = np.repeat(first_word[block[lo:hi]], per) + np.arange(len(probe)) - np.repeat(np.cumsum(per) - per, per)
        later = start_of_word[word] + 63 > probe  # each pair of rows once
        probe, word, lanes = near_lanes(fps, planes, probe[later], word[later], radius)
        lanes = lanes & held[word]
        some = lanes != 0
        probe, word, lanes = probe[some], word[some], lanes[some]
        for k in range(0, len(probe), 1 << 15):  # at most 2^21 lanes unpacked at once
            which, lane = np.nonzero(np.unpackbits(lanes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = probe[k : k + (1 << 15)][which], start_of_word[word[k : k + (1 << 15)][which]] + lane
            a, b = a[a < b], b[a < b]
            for j in range(0, len(a) if accept else 0, PAIRS_AT_ONCE):
                x, y = a[j : j + PAIRS_AT_ONCE], b[j : j + PAIRS_AT_ONCE]
                apart = root[x] != root[y]
                x, y = x[apart], y[apart]
                near = accept(x, y)
                root = merge(root, x[near], y[near])
            if accept is None:
                root = merge(root, a, b)
        lo = hi
    return root


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after joining the components of each a with those of its b; the least row is the root."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def jaccard_test(sets: list[bytes], similarity: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of pairs of rows (the first ones ascending): Jaccard of their sets of 8-byte hashes is ``similarity`` or more."""
    size = np.array([len(x) // 8 for x in sets], np.int64)
    end = np.cumsum(size)
    start = end - size
    ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)[1]
    mark = np.zeros(int(ids.max(initial=-1)) + 1, bool)

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(x), np.int64)
        edges = [*np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist(), len(x)] if len(x) else []
        for lo, hi in zip(edges, edges[1:], strict=False):
            own = ids[start[x[lo]] : end[x[lo]]]
            mark[own] = True
            per = size[y[lo:hi]]
            at = np.cumsum(per) - per
            held = np.r_[0, np.cumsum(mark[ids[np.repeat(start[y[lo:hi]] - at, per) + np.arange(int(per.sum()))]])]
            shared[lo:hi] = held[at + per] - held[at]
            mark[own] = False
        return shared >= similarity * (size[x] + size[y] - shared) - 1e-9

    return test


def pair_test(wide: list[bytes], size: np.ndarray, sets: list[bytes | None], wide_limit: int, similarity: float, few: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A test of pairs of rows, the cheapest part first: sizes, wide fingerprints (not of sets below ``few``), then exact where sets are given."""
    bits = np.frombuffer(b"".join(wide), np.uint64).reshape(-1, WIDE_WORDS)
    exact = jaccard_test(sets, similarity) if len(sets) and sets[0] is not None else None

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
        near = low >= similarity * high - 1e-9
        by_bits = np.flatnonzero(near & (low >= few))
        near[by_bits] = np.bitwise_count(bits[x[by_bits]] ^ bits[y[by_bits]]).sum(axis=1, dtype=np.int64) <= wide_limit
        if exact is not None:
            left = np.flatnonzero(near)
            near[left] = exact(x[left], y[left])
        return near

    return test


def _links(batches: Iterator[pa.RecordBatch], radius: int, similar: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted (band, key, tile_a, tile_b, node or fp[, wide, size, set]) rows to (a, b) links, at most one per row.

    With ``similar`` (the last arguments of ``pair_test``) rows of band 0 are compared within ``radius``, those
    of other bands, which may have few shingles, at any distance.
    """
    rest: pa.Table | None = None

    def roots(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        for k in range(4):
            c = t.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        if similar is None:
            return block_roots(t.column(4).to_numpy().view(np.uint64), np.cumsum(change), radius)
        wide = t.column(5).to_pylist()
        near = pair_test(wide, t.column(6).to_numpy(), t.column(7).to_pylist(), **similar)
        first = np.ascontiguousarray(np.frombuffer(b"".join(wide), np.uint64).reshape(-1, WIDE_WORDS)[:, 0])
        return block_roots(first, np.cumsum(change), radius if t.column(0)[0].as_py() == 0 else BITS, near)

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        band = t.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(t)] if similar else [0, len(t)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            part = t.slice(lo, hi - lo)
            nodes, root = part.column(4).to_numpy(), roots(part)
            linked = root != np.arange(len(root))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes[linked], nodes[root[linked]])], ["a", "b"])

    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not len(t):
            continue
        cols = [t.column(k).to_numpy() for k in range(4)]
        same = np.ones(len(t), bool)
        for c in cols:
            same &= c == c[-1]
        cut = len(t) - int(same.sum())  # the last block may go on
        if cut:
            yield from links(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield from links(rest)


# ---------------------------------------------------------------- candidate blocks


def bands(radius: int, n: int, block_rows: int, bits: int = BITS) -> list[int]:
    """Masks such that fingerprints within ``radius`` agree under one mask at least.

    The bits are cut into radius + m parts; at most ``radius`` parts hold a differing bit, so
    some m parts agree entirely.  m is the least for which ``n`` evenly spread fingerprints
    give blocks of at most ``block_rows``: results are the same for every m.
    """
    m = 1
    while n / 2 ** (bits * m / (radius + m)) > block_rows and comb(radius + m, m) < 500:
        m += 1
    edges = [round(bits * k / (radius + m)) for k in range(radius + m + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, m)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(fps: DataFrame, n: int, radius: int = 4, block_rows: int = 512, tile_rows: int = 2048) -> DataFrame:
    """(a, b) links that connect exactly the distinct ``fp`` values within ``radius`` bits.

    Only links of a spanning forest of each block are returned.  A block of more than
    ``tile_rows`` rows is cut into tiles by hash; each pair of tiles is a task of its own.
    """
    masks = bands(radius, n, block_rows)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("band", "key"))
    large = keyed.groupBy("band", "key").count().where(F.col("count") > tile_rows).select("band", "key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles"))
    tiles = F.coalesce(F.col("tiles"), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    dealt = (
        keyed.join(large, ["band", "key"], "left")
        .select("band", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        .select("band", "key", F.least("own", "other").alias("tile_a"), F.greatest("own", "other").alias("tile_b"), "fp")
    )
    group = ["band", "key", "tile_a", "tile_b"]
    return dealt.repartition(*group).sortWithinPartitions(*group, "fp").mapInArrow(partial(_links, radius=radius), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; a component's
    id is its smallest doc_id.  Texts without words (null, empty) share fingerprint zero and
    are linked like any other; equal rows give equal rows; a row with null id gets its
    component's id (null if no member has one).  An empty table gives no rows.
    """
    marked, _ = cut_lineage(fingerprints(docs, id_col, text_col, words, seed))
    distinct, n = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(distinct.select("fp"), n, radius))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near-duplicates by similarity


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """1024-bit SimHash: every shingle hash is mixed into ``WIDE_WORDS`` words."""
    votes = np.zeros(64 * WIDE_WORDS, np.int64)
    for k in range(0, len(hashes), SHINGLES_AT_ONCE // WIDE_WORDS):
        x = hashes[k : k + SHINGLES_AT_ONCE // WIDE_WORDS, None] + np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        votes += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def differing_share(similarity: float) -> float:
    """Expected share of differing SimHash bits of two sets of that Jaccard similarity."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes in order."""
    return np.unique(np.frombuffer(shingle_hashes(text, words, seed), ">u8").astype(np.uint64))


def _sketches(batches: Iterator[pa.RecordBatch], text_col: str, words: int, seed: int, keys: int, small: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(5)]
        for text in b.column("doc").field(text_col).to_pylist():
            hashes = shingle_set(text, words, seed)
            held = hashes.tobytes()
            found = (xxhash.xxh3_128_digest(held), wide_fingerprint(hashes), hashes[:keys].view(np.int64), len(hashes), held if len(hashes) < small else None)
            for c, v in zip(out, found, strict=True):
                c.append(v)
        types = [pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out, types)], [*b.schema.names, "same", "wide", "keys", "size", "few"])


def _sets(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, set), a batch for every few megabytes."""
    for b in batches:
        nodes, sets, held = [], [], 0
        for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            nodes.append(node)
            sets.append(shingle_set(text, words, seed).tobytes())
            held += len(sets[-1])
            if held > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])
                nodes, sets, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "set"])


def _dealt(rows: DataFrame, group: list[str], tiles: DataFrame) -> DataFrame:
    """``rows`` once for each pair of tiles of their group that they are in; ``tiles``: (*group, tiles)."""
    mine = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = rows.join(tiles, group).withColumns({"mine": mine, "other": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))})
    return pairs.select("node", *group, F.least("mine", "other").alias("tile_a"), F.greatest("mine", "other").alias("tile_b"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
    margin: float = 6.0, keys: int = 8, seed: int = 42, tile_rows: int = 2048, few: int = 64, tile_bytes: int = 1 << 24,
) -> DataFrame:
    """The input rows without all but the smallest (id, row) of each near-duplicate group.

    Two texts are linked if their sets of ``words``-word shingles have Jaccard ``similarity``
    or more, counted exactly.  Candidates share one of their ``keys`` smallest shingle hashes
    (two sets of similarity 0.8 share none of 8 about once in 400,000 pairs) and their
    1024-bit SimHash fingerprints differ in no more bits than expected at ``similarity`` plus
    ``margin`` standard deviations; inside such a block the first 64 bits are compared by bit
    planes, then the rest.  Fingerprints say little about sets of fewer than ``few``
    shingles: those are compared by their hashes at once.  The components of candidates are
    then compared pair by pair by their sets, and groups are the components of the pairs
    that hold.

    Equal sets are grouped before anything is compared; texts without words (null, empty)
    are equal to each other; texts shorter than ``words`` are one shingle; rows may repeat;
    null ids come after all others.  Columns come back as they are, whatever their names; an
    empty table gives no rows.  A block with a third of all texts is cut into pairs of tiles
    of about ``tile_rows`` rows (and ``tile_bytes`` of sets), each a bounded task.
    """
    bits = 64 * WIDE_WORDS
    share = differing_share(similarity)
    limit = floor(bits * share + margin * sqrt(bits * share * (1 - share)))
    radius = ceil(64 * limit / bits + 4 * sqrt(64 * share * (1 - share)))
    small = floor(few / similarity) + 1  # sets that can be similar to one below ``few``
    link = partial(_links, radius=radius, similar={"wide_limit": limit, "similarity": similarity, "few": few})
    marks = "same binary, wide binary, keys array<long>, size long, few binary"
    kept = StructType([StructField("doc", docs.schema), StructField("row", LongType()), *StructType.fromDDL(marks)])
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    stored, _ = cut_lineage(rows.mapInArrow(partial(_sketches, text_col=text_col, words=words, seed=seed, keys=keys, small=small), kept))

    own = F.struct(F.col("doc")[id_col].isNull().alias("none"), F.col("doc")[id_col].alias("id"), "row")
    marks = stored.select("row", own.alias("own"), "same", "wide", "keys", "size", "few")
    distinct, _ = cut_lineage(marks.groupBy("same").agg(F.min("row").alias("node"), F.min("own").alias("own"), *[F.min(c).alias(c) for c in ("wide", "keys", "size", "few")]))
    large, short = F.col("size") >= few, F.col("size") < small
    keyed = distinct.select("node", "size", F.explode("keys").alias("key")).select("node", F.explode(F.array_compact(F.array(F.when(large, 0), F.when(short, 1)))).alias("band"), "key")
    shared = keyed.groupBy("band", "key").count().where("count > 1").select("band", "key", F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles"))
    group = ["band", "key", "tile_a", "tile_b"]
    sets = F.when(F.col("band") == 1, F.col("few")).alias("set")
    blocks = _dealt(keyed, ["band", "key"], shared).join(distinct.select("node", "wide", "size", "few"), "node").select(*group, "node", "wide", "size", sets)
    loose = components(blocks.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(link, "a long, b long").distinct())

    # the components of candidates, each text once (or once a pair of tiles), with its set
    members, _ = cut_lineage(loose.join(distinct.select("node", "wide", "size"), "node").select("node", F.lit(1).alias("band"), F.col("root").alias("key"), "wide", "size"))
    tiles = members.groupBy("band", "key").agg(F.ceil(F.greatest(F.count("*") / tile_rows, F.sum("size") * 8 / tile_bytes)).cast("int").alias("tiles"))
    texts = stored.select(F.col("row").alias("node"), F.col("doc")[text_col].alias("text")).join(members.select("node"), "node", "left_semi")
    whole, _ = cut_lineage(texts.mapInArrow(partial(_sets, words=words, seed=seed), "node long, set binary").join(members, "node"))
    parts = _dealt(members.select("node", "band", "key"), ["band", "key"], tiles).join(whole.select("node", "wide", "size", "set"), "node").select(*group, "node", "wide", "size", "set")
    roots = components(parts.repartition(*group).sortWithinPartitions(*group, "node").mapInArrow(link, "a long, b long").distinct())

    grouped = distinct.join(roots, "node", "left").select("own", F.coalesce("root", "node").alias("root"))
    first = grouped.groupBy("root").agg(F.min("own").alias("own")).select(F.col("own.row").alias("row"))
    return stored.join(first, "row", "left_semi").select("doc.*")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))
