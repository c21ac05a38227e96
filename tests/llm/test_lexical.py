"""Ranked search against scoring every document."""

import math
import re

import numpy as np
import pytest
from llm_fixtures import LONG, rows_of
from pyspark.sql import functions as F

from larder.llm import lexical


def words(text):
    out = []
    for part in re.split("[^0-9A-Za-z\x80-\U0010ffff]+", text or ""):
        if part:
            out.append("".join(c.lower() if c.isascii() else c for c in part))
    return out


def brute(docs, items, k):
    held = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    queries = {}
    for i, t in items:
        if i is not None:
            queries.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in queries.items():
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in terms}
        scored = []
        for i, w in held:
            m = 50 + (50 * len(w) * n_docs) // total if total else 0
            score = sum(weight[t] * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def tables(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, n long"), spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id long")


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "ÉTÉ", "naïve", "日本", "🙂x", "A1"]
    chance = 1 / np.arange(1, len(vocabulary) + 1)
    pick = lambda m: " ".join(rng.choice(vocabulary, m, p=chance / chance.sum()))
    docs = [(k, pick(int(rng.integers(1, 40)))) for k in range(n)]
    return docs, [(k, pick(12)) for k in range(15)]


@pytest.mark.parametrize("block_docs, most_items, parts", [(4096, 512, 1), (7, 512, 30), (50, 4, 4)])
def test_search_matches_scoring_everything(spark, block_docs, most_items, parts):
    docs, items = corpus(400)
    docs += [(1000 + k, docs[3][1]) for k in range(30)]  # ties
    d, i = tables(spark, docs, items)
    got = lexical.ranked_search(d.repartition(parts), i, k=8, block_docs=block_docs, most_items=most_items)
    assert sorted(rows_of(got)) == brute(docs, items, 8)


def test_search_edges(spark):
    docs = [(1, "a b-c A"), (1, "a b-c A"), (2, None), (3, ""), (4, "-- ,, __"), (None, "a b"), (None, None), (5, LONG), (6, "É é")]
    items = [(1, "A b"), (1, "c mit"), (2, None), (3, ""), (None, "a"), (4, "nowhere"), (5, "é É É"), (6, "word WORD one")]
    d, i = tables(spark, docs, items)
    assert sorted(rows_of(lexical.ranked_search(d, i))) == brute(docs, items, 50)
    assert rows_of(lexical.ranked_search(d.where("false"), i)) == [] == rows_of(lexical.ranked_search(d, i.where("false")))
    many, one = tables(spark, [(k, "same words here") for k in range(300)] + [(k, "filler") for k in range(300, 800)], [(1, "same here")])
    assert [(r[1], r[2]) for r in sorted(rows_of(lexical.ranked_search(many, one)))] == [(k + 1, k) for k in range(50)]


def test_pair_bounds_are_between_single_and_summed_maxima():
    docs = np.arange(4, dtype=np.int32)
    block = lexical.Block(docs, {0: (docs[:3], np.array([9, 1, 1]), 9), 1: (docs[1:], np.array([2, 1, 8]), 8)}, {(0, 1): (docs[1:3], np.array([3, 2]), 3)})
    assert block.bound((0, 1)) == 9 and block.bound((0,)) + block.bound((1,)) == 17
    found, scores = lexical.search_block(block, [(0, 1)], 50, 10)
    assert len(found) == 0  # the summed maxima would have opened the lists
    found, scores = lexical.search_block(block, [(0, 1)], 2, 1)
    assert dict(zip(found.tolist(), scores.tolist(), strict=True)) == {0: 9, 3: 8}


def test_thresholds_never_change_results():
    rng = np.random.default_rng(6)
    for _ in range(200):
        docs = np.arange(60, dtype=np.int32)
        terms = {}
        for t in range(6):
            own = np.flatnonzero(rng.random(60) < 0.4).astype(np.int32)
            if len(own):
                impacts = rng.integers(1, 12, len(own))
                terms[t] = (own, impacts, int(impacts.max()))
        pairs = {}
        for p in ((0, 1), (2, 3)):
            if p[0] in terms and p[1] in terms:
                both, i, j = np.intersect1d(terms[p[0]][0], terms[p[1]][0], return_indices=True)
                if len(both):
                    joint = terms[p[0]][1][i] + terms[p[1]][1][j]
                    pairs[p] = (both, joint, int(joint.max()))
        whole = np.zeros(60, np.int64)
        for own, impacts, _ in terms.values():
            whole[own] += impacts
        kth = np.sort(whole)[-5]
        found, scores = lexical.search_block(lexical.Block(docs, terms, pairs), [(0, 1), (2, 3), (4,), (5,)], 5, int(rng.integers(0, max(1, kth) + 1)))
        assert (scores == whole[found]).all() and set(np.flatnonzero(whole > max(kth, 0))) <= set(found) and set(np.flatnonzero((whole == kth) & (whole > 0))) <= set(found)


def test_terms_are_the_same_in_both_readers(spark):
    texts = ["Été d'A1_b", "\x00x\x7fy", "日本 🙂\u0300z", "", None, "ẞİI\u2028K"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(lexical.terms_of(F.col("t"))).collect()]
    assert got == [lexical.WORDS.findall((t or "").translate(lexical.LOWERED)) for t in texts] == [words(t) for t in texts]
