"""The closure, whole and above some tags, against a walk over every node."""

import random

import pytest

from larder.operators import taxonomy as T


def walked(edges):
    up = {}
    for p, c in edges:
        up.setdefault(c, set()).add(p)
    out = set()
    for node in up:
        todo, seen = list(up[node]), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += up.get(n, ())
        out |= {(a, node) for a in seen}
    return out


def random_dag(seed, n, reach):
    rng = random.Random(seed)
    return sorted({(f"n{max(0, i - rng.randint(1, reach))}", f"n{i}") for i in range(1, n) for _ in range(rng.randint(1, 3))})


CASES = {"chain": [(f"n{i}", f"n{i + 1}") for i in range(40)], "deep": random_dag(1, 90, 4), "wide": random_dag(2, 150, 60), "edge": [("a", "b")], "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]}


@pytest.mark.parametrize("case", CASES)
def test_whole_closure(spark, case):
    got = [tuple(r) for r in T.taxonomy_closure(spark.createDataFrame(CASES[case], "parent string, child string")).collect()]
    assert sorted(got) == sorted(walked(CASES[case]))


@pytest.mark.parametrize("case,max_steps", [("deep", 32), ("deep", 3), ("wide", 32), ("cycle", 32)])
def test_closure_above_some_tags(spark, case, max_steps):
    tags = ["n7", "n50", "n50", None, "unknown", "n89", "c"]
    edges = spark.createDataFrame(CASES[case], "parent string, child string")
    got = T.closure_of(edges, spark.createDataFrame([(t,) for t in tags], "value_tag string"), max_steps=max_steps).select("ancestor", "descendant")
    assert sorted(tuple(r) for r in got.collect()) == sorted(p for p in walked(CASES[case]) if p[1] in tags)


def test_no_edges(spark):
    assert T.taxonomy_closure(spark.createDataFrame([], "parent string, child string")).count() == 0


def test_only_pairs_above_the_tags_are_written(spark, monkeypatch):
    edges, written, cut = spark.createDataFrame(CASES["deep"], "parent string, child string"), [], T.cut_lineage

    def watched(df):
        out = cut(df)
        written.append((df.columns, out[1]))
        return out

    monkeypatch.setattr(T, "cut_lineage", watched)
    T.closure_of(edges, spark.createDataFrame([("n20",)], "value_tag string"))
    assert sum(n for columns, n in written if columns == ["ancestor", "descendant"]) == len([p for p in walked(CASES["deep"]) if p[1] == "n20"])
