"""Token alignment of corrections: what a prediction changes against what it should.

Original and reference, and original and prediction, are aligned token by token with the
fewest edits.  Every original token, and every token inserted between two of them, is then
changed or not on either side, which makes it a true or false positive or negative.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]")
FEW_EDITS = 2000  # up to so many edits diagonals are followed (at most 32 MB), beyond that rows
EFFORT = 12  # compared tokens and points for each token of both texts, before all diagonals are followed
COUNTS = "tp long, fp long, fn long, tn long, exact long"

#: For each original token the partner's position or -1, for each gap the inserted positions.
Alignment = tuple[list[int], list[list[int]]]


def numbered(*texts: str | None) -> list[np.ndarray]:
    """The texts' tokens as numbers that are equal where the tokens are."""
    seen: defaultdict[str, int] = defaultdict(count().__next__)
    return [np.array(list(map(seen.__getitem__, TOKEN.findall(x or ""))), np.int64) for x in texts]


class Diagonals:
    """Edit distances by furthest-reaching points: few edits cost little whatever the length.

    ``reach[e][k + e]`` is the furthest row on diagonal k that e edits come to; a cell's distance
    is the least e that reaches it.  Gives up after ``most`` edits.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, most: int) -> None:
        self.a, self.b = a, b
        self.reach: list[np.ndarray] = []
        goal = len(b) - len(a)
        for e in range(most + 1):
            k = np.arange(-e, e + 1)
            if e:
                last = np.full(2 * e + 3, -9, np.int64)
                last[2:-2] = self.reach[-1]
                rows = np.maximum(np.maximum(last[1:-1], last[2:]) + 1, last[:-2])
            else:
                rows = np.zeros(1, np.int64)
            rows = np.minimum(rows, np.minimum(len(a), len(b) - k))
            rows[rows < np.maximum(0, -k)] = -9  # outside the matrix
            self.reach.append(self.slid(rows, k))
            if abs(goal) <= e and self.reach[-1][goal + e] >= len(a):
                return
        self.reach = []  # too many edits

    def slid(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rows where equal tokens from here on end: all diagonals together at first, then the few that go on."""
        on = np.flatnonzero(rows >= 0)
        for _ in range(3):
            on = on[(rows[on] < len(self.a)) & (rows[on] + k[on] < len(self.b))]
            on = on[self.a[rows[on]] == self.b[rows[on] + k[on]]]
            rows[on] += 1
            if not len(on):
                return rows
        for d in on.tolist():
            rows[d] = self.slide(int(rows[d]), int(rows[d] + k[d]))
        return rows

    def slide(self, i: int, j: int) -> int:
        """The row where equal tokens from (i, j) on end."""
        a, b, step = self.a, self.b, 32
        while True:
            n = min(step, len(a) - i, len(b) - j)
            if n <= 0:
                return i
            apart = a[i : i + n] != b[j : j + n]
            if apart.any():
                return i + int(apart.argmax())
            i, j, step = i + n, j + n, step * 2

    def at(self, i: int, j: int, e: int) -> bool:
        """Whether cell (i, j) is within ``e`` edits."""
        return e >= 0 and i >= 0 and j >= 0 and abs(j - i) <= e and self.reach[e][j - i + e] >= i


class Guided:
    """Furthest-reaching points of those diagonals alone that a shortest way can still use.

    Tokens of one side that the other has not, and the lengths, bound the edits still to come
    from below.  Points whose edits and bound together pass ``most`` are left out; ``most`` starts
    at the bound of the whole and is raised while ``effort`` (compared tokens and points) lasts.
    All points of all shortest ways are kept, so the alignment is that of every diagonal.
    """

    def __init__(self, a: list[int], b: list[int], effort: int) -> None:
        self.a, self.b, self.effort = a, b, effort
        self.a_only, self.b_only = self.strange(a, set(b)), self.strange(b, set(a))
        self.reach: list[dict[int, int]] = []
        least, slack = self.still(0, 0), 0
        while self.effort > 0 and not self.search(least + slack):
            slack = slack * 4 + 2

    @staticmethod
    def strange(tokens: list[int], others: set[int]) -> list[int]:
        """How many tokens from each place on are not among ``others``."""
        own = set(tokens) - others
        return [*accumulate(map(own.__contains__, reversed(tokens)), initial=0)][::-1]

    def still(self, i: int, j: int) -> int:
        """A lower bound of the edits from cell (i, j) on."""
        more = (len(self.a) - i) - (len(self.b) - j)
        return max(self.a_only[i] + max(0, -more), self.b_only[j] + max(0, more))

    def search(self, most: int) -> bool:
        a, b, n, m = self.a, self.b, len(self.a), len(self.b)
        self.reach, last = [], {}
        for e in range(most + 1):
            points: dict[int, int] = {}
            for k in {d for k in last for d in (k - 1, k, k + 1)} if e else (0,):
                row = max(last.get(k, -9) + 1, last.get(k + 1, -9) + 1, last.get(k - 1, -9)) if e else 0
                first = row = min(row, n, m - k)
                if row < max(0, -k):
                    continue  # outside the matrix
                while row < n and row + k < m and a[row] == b[row + k]:
                    row += 1
                self.effort -= row - first + 1
                if e + self.still(row, row + k) <= most:
                    points[k] = row
            self.reach.append(points)
            last = points
            if points.get(m - n, -9) >= n:
                return True
            if not points or self.effort <= 0:
                break
        self.reach = []
        return False

    def at(self, i: int, j: int, e: int) -> bool:
        """Whether cell (i, j), beside a cell of a shortest way, is on one with ``e`` edits before it."""
        return e >= 0 and i >= 0 and j >= 0 and self.reach[e].get(j - i, -9) >= i


class Rows:
    """Edit distances row by row; every so-maniest row is kept and those between are made again.

    Memory is about twice the square root of the rows, in rows.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = a, b
        self.every = max(1, int(len(a) ** 0.5))
        self.kept = {0: np.arange(len(b) + 1, dtype=np.int32)}
        row = self.kept[0]
        for i in range(1, len(a) + 1):
            row = self.following(row, i)
            if i % self.every == 0:
                self.kept[i] = row
        self.distance = int(row[-1])
        self.block: dict[int, np.ndarray] = {}

    def following(self, row: np.ndarray, i: int) -> np.ndarray:
        best = np.empty_like(row)
        best[0] = i
        np.minimum(row[:-1] + (self.b != self.a[i - 1]), row[1:] + 1, out=best[1:])
        steps = np.arange(len(row), dtype=np.int32)
        return np.minimum.accumulate(best - steps) + steps  # insertions along the row

    def at(self, i: int, j: int, e: int) -> bool:
        if i < 0 or j < 0 or e < 0:
            return False
        if i not in self.block:
            start = i - i % self.every
            self.block = {start: self.kept[start]}
            for k in range(start + 1, min(start + self.every, len(self.a) + 1)):
                self.block[k] = self.following(self.block[k - 1], k)
        return self.block[i][j] <= e


def align(a: np.ndarray, b: np.ndarray, few_edits: int = FEW_EDITS) -> Alignment:
    """The alignment of fewest edits; of several, followed from the end, tokens facing each other come before dropped and these before inserted ones.

    All ways of finding distances give the same alignment.
    """
    left, right = a.tolist(), b.tolist()
    cells: Guided | Diagonals | Rows = Guided(left, right, EFFORT * (len(left) + len(right) + 16) if few_edits >= 0 else 0)
    if not cells.reach:
        cells = Diagonals(a, b, few_edits)
    if cells.reach:
        e = len(cells.reach) - 1
    else:
        cells = Rows(a, b)
        e = cells.distance
    partner, inserted = [-1] * len(a), [[] for _ in range(len(a) + 1)]
    i, j = len(a), len(b)
    while i or j:
        if i and j and left[i - 1] == right[j - 1]:
            i, j = i - 1, j - 1
            partner[i] = j
        elif i and j and cells.at(i - 1, j - 1, e - 1):
            i, j, e = i - 1, j - 1, e - 1
            partner[i] = j
        elif i and cells.at(i - 1, j, e - 1):
            i, e = i - 1, e - 1
        else:
            j, e = j - 1, e - 1
            inserted[i].append(j)
    return partner, [g[::-1] for g in inserted]


def judge(original: str | None, reference: str | None, prediction: str | None, few_edits: int = FEW_EDITS) -> tuple[int, int, int, int, int]:
    """(tp, fp, fn, tn, exact) of one prediction; exact: true positives that are the reference's own token."""
    o, r, p = numbered(original, reference, prediction)
    (r_at, r_in), (p_at, p_in) = align(o, r, few_edits), align(o, p, few_edits)
    o, r, p = o.tolist(), r.tolist(), p.tolist()
    should = {i for i, k in enumerate(r_at) if k < 0 or r[k] != o[i]}
    does = {i for i, k in enumerate(p_at) if k < 0 or p[k] != o[i]}
    tp, fp, fn = len(should & does), len(does - should), len(should - does)
    tn = len(o) - tp - fp - fn
    same = lambda x, y: (x < 0) == (y < 0) and (x < 0 or r[x] == p[y])
    exact = sum(same(r_at[i], p_at[i]) for i in should & does)
    for wanted, made in zip(r_in, p_in, strict=True):
        if not wanted and not made:
            continue
        both = min(len(wanted), len(made))
        tp, fp, fn = tp + both, fp + len(made) - both, fn + len(wanted) - both
        exact += sum(r[x] == p[y] for x, y in zip(wanted, made, strict=False))
    return tp, fp, fn, tn, exact


def alignment_counts(original: Column, reference: Column, prediction: Column) -> Column:
    """``struct<tp,fp,fn,tn,exact>`` of each row; null texts have no tokens."""

    @F.arrow_udf(COUNTS)
    def counts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([(n, pa.int64()) for n in ("tp", "fp", "fn", "tn", "exact")])
        for columns in batches:
            rows = [judge(*texts) for texts in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.array([dict(zip(("tp", "fp", "fn", "tn", "exact"), map(int, r), strict=True)) for r in rows], kind)

    return counts(original, reference, prediction)


def alignment_metrics(df: DataFrame, by: list[str] | None = None, original: str = "original", reference: str = "reference", prediction: str = "prediction") -> DataFrame:
    """Counts, precision, recall and F1 of the corrections, per group or over all rows.

    A rate without a denominator is null.
    """
    rows = df.select(*(by or []), alignment_counts(F.col(original), F.col(reference), F.col(prediction)).alias("c")).select(*(by or []), "c.*")
    sums = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn", "tn", "exact")])
    rate = lambda a, b: F.when(b > 0, a / b)
    precision, recall = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": precision, "recall": recall, "f1": rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
