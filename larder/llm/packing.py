"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of runs (stretches of at most ``run_tokens`` tokens of one document)
and earns, in every round, a quantum of the window's tokens in proportion to its target.  A
run leaves its queue in the first round whose accumulated quanta cover everything the source
has sent up to the run's end; what is left over is the deficit carried on.  As long as a
source has runs, that round is ceil(tokens up to the run's end / quantum), so no task has to
play the rounds in sequence and deficits carry over windows and partitions by themselves.
Runs in order of (round, source, place in the queue) are one stream, cut every ``window``
tokens; only the last window can be short.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import cut_lineage
from larder.llm.prefix import power_of_two, running_before

WORDS_KEPT = 400_000  # per worker; beyond it the memory of encoded words starts anew


#: A run of letters of ASCII and Latin-1 (one code point each in every normal form, lower case
#: of the same length), perhaps with a run of punctuation: the pieces the tokenizer makes of it.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([^\s'A-Za-z0-9\x80-\U0010ffff]*)")


def plain_pieces_hold(tokenizer: object) -> bool:
    """Whether the tokenizer cuts PLAIN stretches into lower-case letters and punctuation."""
    samples = ["Été,", "WORD", "b.", "ÀÖØßÿ!?", "%%%", "mot;:"]
    pre, norm = tokenizer.pre_tokenizer, tokenizer.normalizer
    if pre is None or norm is None:
        return False
    return all([byte_text(x) for x in PLAIN.fullmatch(w).groups() if x] == [p for p, _ in pre.pre_tokenize_str(norm.normalize_str(w))] for w in samples)


def byte_text(piece: str) -> str:
    """A lower-cased piece as byte-level models spell it: one printable code point a byte."""
    return piece.lower() if piece.isascii() else "".join(BYTE_TEXT[x] for x in piece.lower().encode())


# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_TEXT = {x: chr(x) for x in _PRINTABLE} | {x: chr(256 + k) for k, x in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class EncodedPieces(dict):
    """Ids of the pieces (letters or punctuation) met so far, by the tokenizer's model alone."""

    def __init__(self, model: object, dtype: np.dtype) -> None:
        super().__init__()
        self.tokenize, self.dtype = model.tokenize, dtype

    def __missing__(self, piece: str) -> bytes:
        ids = np.array([t.id for t in self.tokenize(byte_text(piece))], self.dtype).tobytes() if piece else b""
        self[piece] = ids
        return ids


class EncodedWords(dict):
    """Ids (little-endian, ``dtype``) of white-space-free stretches, encoded when first met.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its stretches in order; only ASCII white space is cut at, the rest is the tokenizer's.
    A plain word goes to the tokenizer's model directly, without the layers that keep
    offsets; every other stretch goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.pieces = EncodedPieces(self.tokenizer.model, self.dtype)
        self.direct = plain_pieces_hold(self.tokenizer)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        plain = PLAIN.fullmatch(text) if self.direct and "<" not in text else None
        if plain:
            ids = self.pieces[plain[1].lower()] + self.pieces[plain[2]]
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        self[word] = ids
        return ids

    def encode(self, text: str | None, end: int) -> bytes:
        """Ids of the whole text and ``end``."""
        for memory in (self, self.pieces):
            if len(memory) > WORDS_KEPT:
                memory.clear()
        words = (text or "").encode("utf-8", "replace").split()
        return b"".join(map(self.__getitem__, words)) + np.array([end], self.dtype).tobytes()


_ENCODERS: dict[str, EncodedWords] = {}


def encoder(path: str) -> EncodedWords:
    if path not in _ENCODERS:
        _ENCODERS[path] = EncodedWords(path)
    return _ENCODERS[path]


def _tokens(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    words = encoder(path)
    for b in batches:
        for k in range(0, len(b), 512):
            part = b.slice(k, 512)
            ids = [words.encode(t, end) for t in part.column("text").to_pylist()]
            n = pa.array([len(x) // words.dtype.itemsize for x in ids], pa.int64())
            rest = [part.column(c) for c in part.schema.names if c != "text"]
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, n, pa.array(ids, pa.binary())], [*names, "doc_tokens", "ids"])


def tokenized(docs: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str, source_col: str, order: tuple[Column, Column] | None) -> DataFrame:
    """(row, doc_id, queue, bucket, place, doc_tokens, ids), ``ids`` packed little-endian."""
    bucket, place = order or (F.lit(None), F.xxhash64(F.col(id_col).cast("long")))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"),
        bucket.cast("long").alias("bucket"), place.cast("long").alias("place"), F.col(text_col).alias("text"),
    )
    return rows.mapInArrow(partial(_tokens, path=tokenizer, end=end), "row long, doc_id long, queue string, bucket long, place long, doc_tokens long, ids binary")


def quanta(lengths: DataFrame, targets: DataFrame | None, window: int) -> DataFrame:
    """(queue, quantum): tokens a queue earns in each round, summing to ``window``.

    Without ``targets`` a queue earns in proportion to its tokens, so that all queues end
    together; queues that ``targets`` (queue, weight > 0) leaves out get the least weight.
    """
    sums = lengths.groupBy("queue").agg(F.sum("doc_tokens").cast("double").alias("weight"))
    whole = Window.partitionBy(F.lit(0))  # one row per queue
    if targets is not None:
        given = targets.where("weight > 0").groupBy(F.coalesce(F.col("queue"), F.lit("")).alias("queue")).agg(F.sum("weight").cast("double").alias("given"))
        sums = sums.join(given, "queue", "left").select("queue", F.coalesce(F.col("given"), F.min("given").over(whole), F.lit(1.0)).alias("weight"))
    return sums.select("queue", (F.col("weight") / F.sum("weight").over(whole) * window).alias("quantum"))


def stream_places(lengths: DataFrame, rows: int, targets: DataFrame | None, window: int, run_tokens: int) -> DataFrame:
    """(row, start, length, at): where each run of each document starts in the packed stream.

    ``lengths``: (row, queue, bucket, place, doc_tokens).  Both running sums are cut into
    buckets: documents of a queue by their hash (or the caller's bucket), rounds into about
    as many buckets as a bucket has rounds.
    """
    tokens = lengths.agg(F.sum("doc_tokens")).first()[0] or 0
    by_hash = F.shiftright("place", 64 - power_of_two(rows / 8192).bit_length() + 1) if rows > 8192 else F.lit(0)
    queued = running_before(lengths.withColumn("bucket", F.coalesce("bucket", by_hash.cast("long"))), ["queue"], "bucket", ["place", "row"], "doc_tokens", "before")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_tokens") - 1, F.lit(run_tokens).cast("long")))
    runs = queued.join(quanta(lengths, targets, window), "queue").select("row", "queue", "quantum", "before", "doc_tokens", start.alias("start"))
    length = F.least(F.lit(run_tokens).cast("long"), F.col("doc_tokens") - F.col("start"))
    sent = F.col("before") + F.col("start")
    runs = runs.select("row", "start", length.alias("length"), "queue", sent.alias("sent"), F.ceil((sent + length) / F.col("quantum")).alias("round"))
    per_bucket = max(1, isqrt(tokens // window))
    runs = runs.withColumn("rounds", F.floor(F.col("round") / per_bucket))
    return running_before(runs, [], "rounds", ["round", "queue", "sent"], "length", "at").select("row", "start", "length", "at")


PIECE = "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(batches: Iterator[pa.RecordBatch], window: int, width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PIECE.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.string(), *[pa.int64()] * 6] + [pa.binary()] * with_ids
    for b in batches:
        out: list[list] = [[] for _ in names]
        for doc_id, queue, doc_tokens, packed, runs in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            ids = memoryview(np.frombuffer(packed, f"<u{width}").astype("<u4").tobytes())
            for start, length, at in pieces_of([(r["start"], r["length"], r["at"]) for r in runs], window):
                part = ids[4 * start : 4 * (start + length)]
                row = [doc_id, queue, start, length, zlib.crc32(part), doc_tokens, at // window, at % window] + [bytes(part)] * with_ids
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def pieces_of(runs: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """(start, length, at) runs of one document, joined where they touch, cut at windows."""
    out: list[tuple[int, int, int]] = []
    for start, length, at in sorted(runs):
        if out and out[-1][2] + out[-1][1] == at:
            start, at, length = out[-1][0], out[-1][2], out.pop()[1] + length
        while length:
            take = min(length, window - at % window)
            out.append((start, take, at))
            start, at, length = start + take, at + take, length - take
    return out


def pack(
    docs: DataFrame, tokenizer: str, end: int = 2, window: int = 4096, run_tokens: int = 1024, targets: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order: tuple[Column, Column] | None = None, with_ids: bool = True,
) -> DataFrame:
    """Packs every document; one row per piece (``PIECE``, and ``ids`` as little-endian uint32).

    ``end`` follows each document's ids, so a null or empty text is one token.  Documents of
    a source queue in order of (``order[0]``, ``order[1]``) - a coarse and a fine place - or
    of a hash of their id.  Null sources queue under the empty name; rows with the same or
    no id are documents of their own; an empty table gives no rows.

    Each id lies in exactly one piece, windows are gapless from offset 0 and full but for the
    last.  In every prefix of the stream each source is within ``run_tokens`` of its share of
    the rounds played; once a source has run dry, the others share its place in proportion.
    The tokens are written once to the shared folder; places are computed on lengths alone.
    """
    if window < 1 or run_tokens < 1:
        raise ValueError("window and run_tokens must be positive")
    width = encoder(tokenizer).dtype.itemsize
    stored, rows = cut_lineage(tokenized(docs, tokenizer, end, id_col, text_col, source_col, order))
    lengths = stored.select("row", "queue", "bucket", "place", "doc_tokens")
    runs = stream_places(lengths, rows, targets, window, run_tokens).groupBy("row").agg(F.collect_list(F.struct("start", "length", "at")).alias("runs"))
    joined = stored.select("row", "doc_id", "queue", "doc_tokens", "ids").join(runs, "row").select("doc_id", "queue", "doc_tokens", "ids", "runs")
    return joined.mapInArrow(partial(_pieces, window=window, width=width, with_ids=with_ids), PIECE + ", ids binary" * with_ids)
