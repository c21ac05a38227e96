"""The stored vector index against exact search and fresh builds."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import vector_index as X
from larder.operators import vectors as V


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(c) for c in v], "b" if i % 5 == 0 else "a") for i, v in zip(ids, x, strict=True)], "logo_id long, embedding array<double>, server string")


def brute(vectors, k):
    """{query: [(distance, id)]} of {id: (vector, server)}."""
    unit = {i: (np.array(v) / (np.linalg.norm(v) or 1), s) for i, (v, s) in vectors.items()}
    return {i: sorted((round(float(1 - v @ w) / 2, 9), j) for j, (w, t) in unit.items() if j != i and s == t)[:k] for i, (v, s) in unit.items()}


def lists_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((round(r.distance, 9), r.neighbor_id))
    return {q: sorted(n) for q, n in out.items()}


def clusters(n, width, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((12, width))[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, width))


@pytest.mark.parametrize("make", [lambda: clusters(900, 24, 1), lambda: np.random.default_rng(2).standard_normal((700, 16))])
def test_calibrated_search_finds_nine_tenths(spark, tmp_path, make):
    x = make()
    df = table(spark, x)
    index = X.VectorIndex.build(df, f"{tmp_path}/i", server_col="server")
    settings = index.calibrate(10)
    got = lists_of(index.search(df, settings, 10, server_col="server", block_rows=100, query_rows=50))
    want = brute({i: (v, "b" if i % 5 == 0 else "a") for i, v in enumerate(x)}, 10)
    recall = np.mean([len({j for _, j in want[i]} & {j for _, j in got.get(i, [])}) / 10 for i in want])
    assert recall >= 0.9, (recall, settings)
    assert all(d in dict((j, e) for e, j in want[i]).values() or d >= want[i][0][0] for i in got for d, _ in got[i])  # distances are exact ones
    everything = index.search(df, X.Settings(10_000, 10_000), 10, server_col="server")
    assert lists_of(everything) == want


def test_lists_after_any_upserts_equal_a_fresh_build(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = clusters(300, 12, 3)
    now = {i: (v, "b" if i % 5 == 0 else "a") for i, v in enumerate(x[:200])}
    index = X.VectorIndex.build(table(spark, x[:200]), f"{tmp_path}/i", server_col="server", cells=9)
    lists = index.exact(index.rows(), 6)
    for step in range(3):
        since = index.batches()
        ids = [int(i) for i in rng.choice(300, 25, replace=False)]
        fresh = clusters(25, 12, 10 + step)
        fresh[3] = fresh[4]  # equal vectors
        index.upsert(table(spark, fresh, ids), server_col="server")
        now.update({i: (v, "b" if i % 5 == 0 else "a") for i, v in zip(ids, fresh, strict=True)})
        gone = [int(i) for i in rng.choice(sorted(now), 9, replace=False)]
        index.delete(spark.createDataFrame([(i,) for i in gone], "logo_id long"))
        now = {i: v for i, v in now.items() if i not in gone}
        lists, _ = X.cut_lineage(X.refresh_lists(index, lists, since, 6))
        assert lists_of(lists) == brute(now, 6)
        assert sorted(r.id for r in index.rows().select("id").collect()) == sorted(now)


def test_a_broken_off_batch_is_written_over(spark, tmp_path):
    x = clusters(40, 8, 5)
    index = X.VectorIndex.build(table(spark, x), f"{tmp_path}/i", cells=3)
    table(spark, x[:3]).write.parquet(f"{tmp_path}/i/rows/batch=1/cell=0")  # no entry in the log
    assert index.batches() == 1 and index.rows().count() == 40
    assert index.upsert(table(spark, clusters(2, 8, 6), [100, 101])) == 1 and index.rows().count() == 42


def test_odd_vectors_take_no_part(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (7, [0.0, 0.0]), (8, []), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "logo_id long, embedding array<double>")
    exact = sorted((r.query_id, r.neighbor_id) for r in V.knn_join(df, df, 5).collect())
    assert exact == [(a, b) for a in (1, 2, 7) for b in (1, 2, 7) if a != b]
    index = X.VectorIndex.build(df.where("logo_id <> 6 or logo_id is null"), f"{tmp_path}/i")
    got = index.search(df, index.calibrate(5), 5)
    assert sorted((r.query_id, r.neighbor_id) for r in got.collect()) == exact
    assert V.knn_join(df.where("false"), df.where("false"), 5).count() == 0
    assert V.knn_join(df.where(F.col("logo_id") == 3), df, 5).count() == 0


def test_copies_that_come_later_win_by_smaller_ids(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(60, 64))
    index = X.VectorIndex.build(table(spark, x, range(1000, 1060)), f"{tmp_path}/i", cells=4)
    before, _ = X.cut_lineage(index.exact(index.rows(), 6))
    index.upsert(table(spark, x, range(60)))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round((1 - unit @ unit.T) / 2, 9)
    want = {q: sorted((near[q % 1000, n % 1000], n) for n in [*range(60), *range(1000, 1060)] if n != q)[:6] for q in [*range(60), *range(1000, 1060)]}
    got = {}
    for r in X.refresh_lists(index, before, 1, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    assert got == {q: [n for _, n in row] for q, row in want.items()}


def test_a_search_writes_no_row_for_each_cell_of_a_query(spark, tmp_path):
    x = np.random.default_rng(4).standard_normal((400, 8))
    index = X.VectorIndex.build(table(spark, x), f"{tmp_path}/i", cells=20)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("larder-cut-*"))
    assert index.search(table(spark, x), X.Settings(20, 400), 5).count() == 2000
    written = sum(spark.read.parquet(str(p)).count() for p in set(folder.glob("larder-cut-*")) - before)
    assert written < 400


def test_an_exact_search_writes_no_row_for_each_cell_of_a_query(spark):
    x = np.random.default_rng(6).standard_normal((400, 8))
    df = table(spark, x)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("larder-cut-*"))
    got = V.knn_join(df, df, 5, cells=20, block_rows=200, server_col="server")
    assert lists_of(got.withColumn("distance", F.round("distance", 9))) == brute({i: (v, "b" if i % 5 == 0 else "a") for i, v in enumerate(x)}, 5)
    tables = [spark.read.parquet(str(p)) for p in set(folder.glob("larder-cut-*")) - before]
    assert sum(t.count() for t in tables if "embedding" in t.columns) <= 4 * 400  # the index, the queries, and these for either search


def test_many_equal_vectors_give_the_smaller_ids(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((12, 6))[rng.integers(0, 12, 900)]
    x[:500] = x[0]
    got = lists_of(V.knn_join(table(spark, x), table(spark, x), 7, server_col="server", cells=5, block_rows=300, query_rows=200))
    assert {q: [n for _, n in row] for q, row in got.items()} == {q: [n for _, n in row] for q, row in brute({i: (v, "b" if i % 5 == 0 else "a") for i, v in enumerate(x)}, 7).items()}


def test_refreshed_lists_send_no_vector_to_each_cell(spark, tmp_path):
    x = clusters(200, 8, 9)
    index = X.VectorIndex.build(table(spark, x[:150]), f"{tmp_path}/i", server_col="server", cells=12)
    before, _ = X.cut_lineage(index.exact(index.rows(), 5))
    index.upsert(table(spark, x[150:], range(150, 200)), server_col="server")
    usual = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = X.refresh_lists(index, before, 1, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert "block#" in plan and not re.search(r"hashpartitioning\([^)]*cell", plan), plan


def test_a_vectors_length_is_not_worked_out_for_each_component(spark):
    rows = X.unit_rows(table(spark, [[1.0, 2.0]]), "logo_id", "embedding", None).where(F.size("vector") == 2)  # may go below the division
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT(") <= 2, plan
