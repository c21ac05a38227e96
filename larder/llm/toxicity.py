"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in the weights of its words, a word's weight is the sum
of the weights of the word and of its beginnings.  A document is toxic unless all of its
sentences are clean (noisy-or), so document labels alone train the sentence scorer, which
then points at the offending sentences.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Byte classes: letters and all non-ASCII bytes are word bytes, . ! ? and line ends end a sentence.
CLASSES = bytes(i if i >= 128 or chr(i).isalpha() else 10 if chr(i) in ".!?\n" else 32 for i in range(256))
BEGINNINGS = range(4, 11)
WORDS_KEPT = 200_000  # per worker; beyond it the memory of word weights starts anew


def folded(text: str | None) -> str:
    """Lower case with every code point in its place."""
    low = (text or "").lower()
    return low if len(low) == len(text or "") else re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sentences(text: str | None) -> list[bytes]:
    """The stretches between sentence ends, other bytes than words' blanked."""
    return folded(text).encode("utf-8", "replace").translate(CLASSES).split(b"\n")


FEATURES = 1 << 20  # places of the hashed features


def word_features(word: bytes) -> list[int]:
    """Places of a word's features: itself (marked) and its beginnings of 4 to 10 bytes."""
    return [zlib.crc32(f) % FEATURES for f in (b"=" + word, *(word[:k] for k in BEGINNINGS if len(word) >= k))]


@dataclass
class SentenceModel:
    """Weights of the feature places in use and the sentence bias; an untrained model says 0."""

    bias: float = -30.0
    weights: dict[int, float] = field(default_factory=dict)


@dataclass
class Chunk:
    """Documents of a bounded number of bytes as arrays; words are numbered inside the chunk."""

    word: np.ndarray  # of each occurrence
    sentence: np.ndarray  # of each occurrence
    doc: np.ndarray  # of each sentence
    feature: np.ndarray  # places, word after word
    owner: np.ndarray  # the word of each entry of ``feature``
    words: int


def chunks(texts: Iterable[str | None], at_once: int = 1 << 23) -> Iterator[Chunk]:
    """The texts' words and sentences, cut after about ``at_once`` characters.

    Nothing outlives a chunk but its arrays, which are bounded by the bytes read: a word of
    n bytes has fewer than n features, and no dictionary spans the sample.
    """
    number: dict[bytes, int] = {}
    words, sentence, doc_of, size = array("i"), array("i"), array("i"), 0

    def done() -> Chunk:
        feature, count = array("i"), array("i")
        for w in number:
            places = word_features(w)
            feature.extend(places)
            count.append(len(places))
        return Chunk(*(np.array(x, np.int32) for x in (words, sentence, doc_of, feature)), np.repeat(np.arange(len(number), dtype=np.int32), np.array(count, np.int32)), len(number))

    for d, text in enumerate(texts):
        for part in sentences(text):
            if found := part.split():
                words.extend([number.setdefault(w, len(number)) for w in found])
                sentence.extend([len(doc_of)] * len(found))
                doc_of.append(d)
        size += len(text or "")
        if size >= at_once:
            yield done()
            number, words, sentence, doc_of, size = {}, array("i"), array("i"), array("i"), 0
    if len(doc_of):
        yield done()


def slopes(parts: list[Chunk], y: np.ndarray, share: np.ndarray, w: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
    """(gradient by feature, gradient by bias, loss) of the noisy-or likelihood."""
    g, gb, loss = np.zeros(len(w)), 0.0, 0.0
    seen = np.zeros(len(y), bool)
    for c in parts:
        of_word = np.bincount(c.owner, w[c.feature], c.words)
        z = np.clip(bias + np.bincount(c.sentence, of_word[c.word], len(c.doc)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        first, last = int(c.doc[0]), int(c.doc[-1]) + 1
        own, mine = c.doc - first, slice(first, last)
        clean = np.bincount(own, np.log1p(-np.minimum(p, 1 - 1e-12)), last - first)  # log of "all sentences clean"
        some = np.maximum(-np.expm1(clean), 1e-9)
        held = np.zeros(last - first, bool)
        held[own] = True
        seen[mine] |= held
        loss -= float((share[mine] * (y[mine] * np.log(some) + (1 - y[mine]) * clean))[held].sum())
        slope = share[mine] * (1 - y[mine] / some)  # of the loss in each sentence's own p
        g_sentence = slope[own] * p
        g_word = np.bincount(c.word, g_sentence[c.sentence], c.words)
        g += np.bincount(c.feature, g_word[c.owner], len(w))
        gb += float(g_sentence.sum())
    return g, gb, loss + float((share * y)[~seen].sum()) * -math.log(1e-9)


def learn(texts: Iterable[str | None], toxic: np.ndarray, share: np.ndarray, epochs: int = 120, rate: float = 0.08, shrink: float = 1e-4) -> SentenceModel:
    """Noisy-or maximum likelihood over documents by full-batch Adam with soft thresholding.

    ``share``: weight of each document (undoes unequal sampling of the classes).  Memory is
    the texts' arrays (about 20 bytes a byte of text at most) and five tables of feature
    places, however many distinct words there are.
    """
    n = len(toxic)
    if not n or toxic.min() == toxic.max():
        return SentenceModel(bias=30.0 if n and toxic.min() == 1 else -30.0)
    parts = list(chunks(texts))
    if not parts:
        return SentenceModel(bias=-30.0)
    used = np.unique(np.concatenate([np.unique(c.feature) for c in parts]))
    place = np.zeros(FEATURES, np.int32)
    place[used] = np.arange(len(used))
    for c in parts:
        c.feature = place[c.feature]
    y, share = toxic.astype(np.float64), share / share.sum()
    w, bias = np.zeros(len(used)), -4.0
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, epochs + 1):
        g, gb, _ = slopes(parts, y, share, w, bias)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w = w - step * (m / (1 - 0.9**t))
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink, 0)
        bias -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    kept = np.flatnonzero(np.abs(w) > 1e-3)
    return SentenceModel(float(bias), dict(zip(used[kept].tolist(), w[kept].tolist(), strict=True)))


class WordWeights(dict):
    """Weights of the words met so far, forgotten together when there are too many."""

    def __init__(self, model: SentenceModel) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) > WORDS_KEPT:
            self.clear()
        weights = self.model.weights
        self[word] = total = sum([weights.get(f, 0.0) for f in word_features(word)])
        return total


def sentence_chances(text: str | None, weights: WordWeights) -> tuple[np.ndarray, list[int]]:
    """(chance of each sentence with words, its number among all stretches)."""
    bias = weights.model.bias
    logits, numbers = [], []
    for k, part in enumerate(sentences(text)):
        if words := part.split():
            logits.append(bias + sum([weights[w] for w in words]))
            numbers.append(k)
    return 1 / (1 + np.exp(-np.clip(np.array(logits), -30, 30))), numbers


def noisy_or(chances: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(chances, 1 - 1e-12)).sum())) if len(chances) else 0.0


def sentence_spans(text: str, numbers: list[int]) -> list[tuple[int, int]]:
    """(start, end) in code points of the stretches with these numbers, outer blanks left out."""
    whole = folded(text).encode("utf-8", "replace")
    out, at, begin, wanted = [], 0, 0, set(numbers)
    for k, part in enumerate(sentences(text)):
        if k in wanted:
            first = begin + len(part) - len(part.lstrip())
            last = begin + len(part.rstrip())
            start = at + len(whole[begin:first].decode())
            out.append((start, start + len(whole[first:last].decode())))
        at += len(whole[begin : begin + len(part) + 1].decode())
        begin += len(part) + 1
    return out


SCORED = "score double, predicted int, n_sentences int, offending array<struct<start:int,end:int,score:double>>"


def _score(batches: Iterator[pa.RecordBatch], model: SentenceModel, limit: float) -> Iterator[pa.RecordBatch]:
    weights = WordWeights(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for b in batches:
        score, count, spans = [], [], []
        for text in (x.as_py() for x in b.column("text")):
            chances, numbers = sentence_chances(text, weights)
            score.append(noisy_or(chances))
            count.append(len(chances))
            bad = np.flatnonzero(chances >= limit)
            places = sentence_spans(text, [numbers[k] for k in bad]) if len(bad) else []
            spans.append([{"start": s, "end": e, "score": float(c)} for (s, e), c in zip(places, chances[bad], strict=True)])
        names = [n for n in b.schema.names if n != "text"]
        columns = [b.column(n) for n in names]
        columns += [pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32()), pa.array(count, pa.int32()), pa.array(spans, span)]
        yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted", "n_sentences", "offending"])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str, most_per_class: int, most_chars: int) -> DataFrame:
    """(text, toxic, share): a sample by hash of the id of about ``most_per_class`` rows and ``most_chars`` characters a class.

    A text longer than a quarter of ``most_chars`` is never in the sample.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isin(0, 1)).groupBy(id_col).agg(F.max(toxic_col).cast("int").alias("toxic"))
    size = F.coalesce(F.length(text_col), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).alias("_id"), size.alias("size")).where(F.col("size") * 4 <= most_chars)
    labelled = sizes.join(known.select(F.col(id_col).alias("_id"), "toxic"), "_id")
    totals = labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).collect()  # two rows at most
    rate = {r["toxic"]: min(1.0, most_per_class / r["n"], most_chars / max(1, r["chars"])) for r in totals}
    if not rate:
        return docs.sparkSession.createDataFrame([], "text string, toxic int, share double")
    chance = F.when(F.col("toxic") == 1, F.lit(rate.get(1, 1.0))).otherwise(F.lit(rate.get(0, 1.0)))
    at = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(at < chance).select(F.col(id_col).alias("_id"), "toxic", (1 / chance).alias("share"))
    picked = F.broadcast(picked)  # counted above: about most_per_class ids and numbers a class, whatever the input
    texts = docs.where(size * 4 <= most_chars).select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return texts.join(picked, "_id").select("text", "toxic", "share")


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
    most_per_class: int = 4000, most_chars: int = 8_000_000,
) -> SentenceModel:
    """Model learned from labelled documents.

    The fit sees at most about ``most_per_class`` documents and ``most_chars`` characters of
    each class, chosen by a hash of their id and weighted back to the classes' sizes; this
    bounds the one task that fits, and only the weights come to the driver.  Labels other
    than 0 and 1 and null ids are left out; of repeated labels the largest counts; without
    both classes the model is constant.
    """
    sample = training_rows(docs, labels, id_col, text_col, toxic_col, most_per_class, most_chars)
    fitted = sample.repartition(1).sortWithinPartitions("toxic", "text").mapInArrow(_fit, "feature int, weight double").collect()
    bias = [r["weight"] for r in fitted if r["feature"] is None]
    return SentenceModel(bias[0] if bias else SentenceModel.bias, {r["feature"]: r["weight"] for r in fitted if r["feature"] is not None})


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's rows to the model's: a weight for each feature place, the bias without one."""
    held = [b for b in batches if len(b)]
    toxic, share = (np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.empty(0) for c in ("toxic", "share"))
    model = learn((x.as_py() for b in held for x in b.column("text")), toxic.astype(np.int64), share)
    yield pa.RecordBatch.from_arrays([pa.array([None, *model.weights], pa.int32()), pa.array([model.bias, *model.weights.values()], pa.float64())], ["feature", "weight"])


def toxicity(docs: DataFrame, model: SentenceModel, text_col: str = "text", keep: list[str | Column] | None = None, limit: float = 0.5) -> DataFrame:
    """The ``keep`` columns (default doc_id) of every row and ``SCORED``.

    ``offending``: sentences whose own chance is at least ``limit``, as code-point spans of
    the text.  Null, empty and wordless texts have no sentences and score 0; texts are read
    whole, whatever their length; equal rows get equal scores; an empty table gives no rows.
    """
    kept = docs.select(*(keep or ["doc_id"]), F.col(text_col).alias("text"))
    if kept.columns.count("text") > 1:
        raise ValueError("the text column is added by itself; leave it out of keep")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "text")
    return kept.mapInArrow(partial(_score, model=model, limit=limit), f"{fields}, {SCORED}")


def drop_toxic(docs: DataFrame, model: SentenceModel, text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """The input rows whose score is under ``reject_from``; columns as they are, whatever their names.

    Only the text goes through Python; null, empty and wordless texts score 0 and stay, equal
    rows share their fate, an empty table stays empty.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = WordWeights(model)
        for texts in batches:
            yield pa.array([noisy_or(sentence_chances(t.as_py(), weights)[0]) for t in texts], pa.float64())

    return docs.where(score(F.col(text_col)) < reject_from)
