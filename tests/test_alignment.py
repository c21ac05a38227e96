"""Token alignment against the full matrix."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.operators import alignment as A


def plain(a, b):
    """The whole matrix, followed back from its end."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
            else:
                d[i][j] = i + j
    partner, inserted, i, j = [-1] * len(a), [[] for _ in range(len(a) + 1)], len(a), len(b)
    while i or j:
        if i and j and d[i - 1][j - 1] + (a[i - 1] != b[j - 1]) == d[i][j]:
            i, j = i - 1, j - 1
            partner[i] = j
        elif i and d[i - 1][j] + 1 == d[i][j]:
            i -= 1
        else:
            j -= 1
            inserted[i].insert(0, j)
    return partner, inserted


sequences = st.lists(st.integers(0, 3), max_size=14)


@given(sequences, sequences)
@settings(max_examples=400, deadline=None)
def test_both_ways_give_the_matrix_alignment(a, b):
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    assert A.align(x, y) == plain(a, b) == A.align(x, y, few_edits=-1)


@given(sequences, sequences)
@settings(max_examples=400, deadline=None)
def test_guided_and_all_diagonals_agree(a, b):
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    cells = A.Guided(a, b, 10**6)
    assert len(cells.reach) - 1 == A.Rows(x, y).distance
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(A, "EFFORT", 10**6)
        guided = A.align(x, y)
        patch.setattr(A, "EFFORT", 0)
        assert A.align(x, y) == guided == plain(a, b)


def test_strange_tokens_guide_the_search():
    """Spoilt words that the other text has not: one diagonal, not one more for every edit."""
    a = [n % 40 for n in range(20_000)]
    b = [1000 + n if n % 11 == 3 else t for n, t in enumerate(a)]
    cells = A.Guided(a, b, 100_000)
    assert len(cells.reach) - 1 == len(range(3, 20_000, 11))
    assert sum(map(len, cells.reach)) < 3 * len(cells.reach)


def test_long_sequences_agree():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50, 3000)
    b = np.delete(np.where(rng.random(3000) < 0.05, rng.integers(0, 50, 3000), a), rng.integers(0, 3000, 60))
    assert A.align(a, b) == A.align(a, b, few_edits=-1)
    assert A.align(a, a) == (list(range(3000)), [[] for _ in range(3001)])


def test_documented_example():
    """Th is missed, big is added, cat stays, si and the end are mended, on is spoilt."""
    assert A.judge("Th cat si on the fride,", "The cat is on the fridge.", "Th big cat is in the fridge.") == (3, 2, 1, 2, 3)


@pytest.mark.parametrize("texts, want", [
    (("a b", "a b", "a b"), (0, 0, 0, 2, 0)), (("a b", "a c", "a d"), (1, 0, 0, 1, 0)), (("a b", "a", "a"), (1, 0, 0, 1, 1)), (("a", "a x", "a x y"), (1, 1, 0, 1, 1)),
    ((None, None, None), (0, 0, 0, 0, 0)), (("", "a b", ""), (0, 0, 2, 0, 0)), (("a b", None, "a b"), (0, 0, 2, 0, 0)), (("été, l'eau", "été, l'eau", "ete, l'eau"), (0, 1, 0, 4, 0)),
])
def test_counts(texts, want):
    assert A.judge(*texts) == want


def test_metrics(spark):
    rows = [("x", "Th cat si on the fride,", "The cat is on the fridge.", "Th big cat is in the fridge."), ("y", "a b", "a b", "a b"), ("x", None, None, None), (None, "a", "b", "b")]
    df = spark.createDataFrame(rows, "lang string, original string, reference string, prediction string")
    got = {r.lang: r for r in A.alignment_metrics(df, ["lang"]).collect()}
    assert (got["x"].n_rows, got["x"].tp, got["x"].precision, got["x"].recall) == (2, 3, 0.6, 0.75) and abs(got["x"].f1 - 2 / 3) < 1e-12
    assert got["y"].precision is None and got["y"].f1 is None and got[None].f1 == 1.0
    assert A.alignment_metrics(df).first().tp == 4
    assert A.alignment_metrics(df.where("false")).first().n_rows == 0
