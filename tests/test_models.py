"""Token post-processing, vectors and votes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import annotations as N
from larder.operators import tokens as T
from larder.operators import vectors as V


def test_entity_runs(spark):
    rows = [("i", i, w, e, s) for i, (w, e, s) in enumerate([("25", "A", 0.9), ("g", "A", 0.5), ("x", "O", 0.9), ("3", "A", 0.8), ("4", "B", 0.7)])]
    out = T.entity_runs(spark.createDataFrame(rows, "source_image string, index int, word string, entity string, score double")).collect()
    assert sorted((r["start"], r["end"], r["words"], r["score"]) for r in out) == [(0, 2, ["25", "g"], 0.9), (3, 4, ["3"], 0.8), (4, 5, ["4"], 0.7)]


def test_energy_split_and_serving(spark):
    rows = [("i", "ENERGY_KJ_100G", ["kJ/525", "kj"], 0), ("i", "SERVING_SIZE", ["25", "9"], 1)]
    out = T.entity_normalize(spark.createDataFrame(rows, "source_image string, entity string, words array<string>, start int")).collect()
    assert {(r["entity"], r["value"], r["unit"], r["valid"]) for r in out} == {("energy-kj_100g", "525", "kj", True), ("serving_size", "25 g", None, True)}


def test_suppression(spark):
    boxes = [{"score": 0.9, "bounding_box": [0.0, 0.0, 1.0, 1.0]}, {"score": 0.8, "bounding_box": [0.0, 0.0, 1.0, 0.99]}, {"score": 0.3, "bounding_box": [0.0, 0.0, 0.1, 0.1]}]
    df = spark.createDataFrame([(boxes,)], "objects array<struct<score:double,bounding_box:array<double>>>")
    kept = [x["index"] for x in df.select(T.filter_logos(F.col("objects"), 0.2).alias("k")).first()["k"]]
    plain = [x["index"] for x in df.select(T.filter_logos(F.col("objects"), 0.5, suppress=False).alias("k")).first()["k"]]
    assert kept == [0, 2] and plain == [0, 1]


def test_votes_weighting(spark):
    rows = [(1, 10, 0.0), (1, 11, 0.5), (2, 10, 0.5), (2, 11, 0.25)]
    out = {(r["logo_id"], r["neighbor_id"]): r["weight"] for r in V.vote_weights(spark.createDataFrame(rows, "logo_id long, neighbor_id long, distance double")).collect()}
    assert out == {(1, 10): 1.0, (1, 11): 0.0, (2, 10): 2.0, (2, 11): 4.0}


@pytest.mark.parametrize("values,expected", [([1, 1, 1], 1), ([1, 1, 0, 0], -1), ([1, 1, 1, 0, 0], -1), ([1, 1, 0], None), ([0, 0, 0, -1], 0), ([1], None)])
def test_vote_resolution(spark, values, expected):
    votes = spark.createDataFrame([("i", v) for v in values], "insight_id string, value int")
    assert N.vote_resolve(votes).first()["annotation"] == expected


def test_knn_is_exact_in_any_layout(spark):
    rng = np.random.default_rng(3)
    # one group of near copies holds a third of all rows
    vectors = np.vstack([rng.normal(size=(120, 16)), np.ones((60, 16)) + rng.normal(scale=1e-3, size=(60, 16))]).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "logo_id long, embedding array<float>")
    got = V.knn_join(df, df, 5, cells=6, block_rows=16, query_rows=50).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    far = (1 - unit.astype("float64") @ unit.T.astype("float64")) / 2
    np.fill_diagonal(far, np.inf)
    want = np.sort(far, axis=1)[:, :5]
    for q in range(len(vectors)):
        mine = sorted(r["distance"] for r in got if r["query_id"] == q)
        assert np.allclose(mine, want[q], atol=1e-6)


def test_probed_neighbours_are_never_nearer(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(100)], "logo_id long, embedding array<float>")
    exact = {(r["query_id"], r["rank"]): r["distance"] for r in V.knn_join(df, df, 3, cells=5).collect()}
    for r in V.knn_join(df, df, 3, cells=5, probes=2).collect():
        assert r["distance"] >= exact[(r["query_id"], r["rank"])] - 1e-9
