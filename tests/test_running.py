"""Running tables: any split merges to the state of one pass."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import running as R


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *(f"v{i}" for i in range(900))]), rng.randrange(6)) for _ in range(4000)]
    return spark.createDataFrame([*data, ("void", None, 2)], "user string, barcode string, part int")


def test_any_split_equals_one_pass(spark, rows, tmp_path):
    want = rows_of(R.read_state(R.state_of(rows, ["user"], ["barcode"], 64), ["user"], ["barcode"], 64))
    table = R.RunningTable(spark, str(tmp_path / "t"), ["user"], ["barcode"], 64)
    for part in (4, 0, 5):
        assert table.add(rows.where(F.col("part") == part), f"p{part}")
    table.fold()
    for part in (1, 2, 3):
        assert table.add(rows.where(F.col("part") == part), f"p{part}")
    assert table.add(rows.where("part = 2"), "p2")  # again: replaces itself
    assert not table.add(rows.where("part = 4"), "p4")  # folded: nothing changes
    assert rows_of(table.read()) == want
    table.fold()
    assert rows_of(table.read()) == want
    assert table.add(rows.where("false"), "empty") and rows_of(table.read()) == want


def test_counts_are_exact_and_estimates_within_their_error(spark, rows):
    data = rows.collect()
    for k in (64, 2000):
        got = {r["user"]: (r["count"], r["n_barcode"]) for r in R.read_state(R.state_of(rows, ["user"], ["barcode"], k), ["user"], ["barcode"], k).collect()}
        for user in {r["user"] for r in data}:
            mine = [r for r in data if r["user"] == user]
            exact = len({r["barcode"] for r in mine} - {None})
            assert got[user][0] == len(mine)
            assert got[user][1] == exact if exact < k else abs(got[user][1] / exact - 1) < 4 / (k - 2) ** 0.5


def test_rows_taken_back(spark, tmp_path):
    table = R.RunningTable(spark, str(tmp_path / "t"), ["user"])
    table.add(spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "user string, s int"), "1", "s")
    table.add(spark.createDataFrame([("a", -1), ("b", -1), ("c", 1)], "user string, s int"), "2", "s")
    assert rows_of(table.read()) == [("a", 1), ("c", 1)]
    with pytest.raises(ValueError):
        R.state_of(spark.createDataFrame([("a", 1)], "user string, s int"), ["user"], ["s"], sign="s")


def test_nothing_added(spark, tmp_path):
    table = R.RunningTable(spark, str(tmp_path / "none"), ["user"])
    table.fold()
    assert table.state() is None
    with pytest.raises(ValueError):
        table.read()
