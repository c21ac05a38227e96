"""Near-duplicate embeddings against all pairs."""

import numpy as np
import pytest
from llm_fixtures import rows_of
from pyspark.sql import functions as F

from larder.llm import polytope as P


def around(rng, centre, cosine, n):
    """``n`` vectors at this cosine of a centre."""
    noise = rng.standard_normal((n, len(centre)))
    noise -= (noise @ centre)[:, None] * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * P.unit(noise)


def brute(vectors, cosine=0.9):
    """(links, components) of {id: vector} by comparing all pairs."""
    ids = sorted(vectors)
    x = P.unit(np.array([vectors[i] for i in ids]))
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    component = {}
    for k, i in enumerate(ids):
        if i not in component:
            stack = [k]
            component[i] = i
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if ids[j] not in component:
                        component[ids[j]] = i
                        stack.append(j)
    return dict(zip(ids, near.sum(axis=1).tolist(), strict=True)), component, int(near.sum())


def test_hadamard_is_the_matrix_product():
    h = np.array([[1.0]])
    for _ in range(4):
        h = np.block([[h, h], [h, -h]])
    x = np.random.default_rng(0).standard_normal((5, 16))
    assert np.allclose(P.hadamard(x), x @ h / 4)


def test_own_bucket_is_the_nearest_axis():
    plan = P.Plan(16, 2, 4, 3, 4, 1)
    x = P.unit(np.random.default_rng(1).standard_normal((50, 16)))
    keys = P.bucket_keys(x, plan)
    size = 32 * 8
    for t in range(3):
        code = 0
        for k, axes in enumerate(plan.axes):
            y = x
            for flip in P.signs(plan, t, k):
                y = P.hadamard(y * flip)
            axis = np.argmax(np.hstack([y[:, :axes], -y[:, :axes]]), axis=1)
            code = code * 2 * axes + 2 * (axis % axes) + axis // axes
        assert (keys[:, t, 0] == t * size + code).all()
        assert all(len(set(r)) == 4 for r in keys[:, t].tolist())  # probes are other buckets


@pytest.mark.parametrize("width", [3, 8, 64, 100])
def test_pairs_at_the_limit_meet_as_often_as_planned(width):
    rng = np.random.default_rng(2)
    plan = P.choose(100_000, width, 0.9, 0.98, 5, 13)
    a = P.unit(rng.standard_normal((400, width)))
    b = np.vstack([around(rng, c, 0.9, 1) for c in a])
    assert P.meet(P.bucket_keys(a, plan), P.bucket_keys(b, plan)).any(axis=1).mean() > 0.95


@pytest.mark.parametrize("tile_rows, cell_rows", [(1024, 4096), (40, 100)])
def test_links_and_components_match_all_pairs(spark, tile_rows, cell_rows):
    rng = np.random.default_rng(3)
    x = [*P.unit(rng.standard_normal((700, 32)))]
    for c in x[:40]:
        x += [*around(rng, c, 0.97, 3)]
    x += [*around(rng, x[0], 0.985, 260)]  # a hot group in which all are linked
    x += [x[5]] * 90 + [2.5 * x[6]] * 4  # copies, and scaled ones
    x = [v * s for v, s in zip(x, rng.choice([1e-200, 1.0, 3.0, 1e200], len(x)), strict=True)]
    order = rng.permutation(len(x))
    vectors = {int(i): x[k] for i, k in enumerate(order)}
    got = rows_of(P.near_duplicates(spark.createDataFrame([(k, [float(c) for c in v]) for k, v in vectors.items()], "vec_id long, embedding array<double>"), tile_rows=tile_rows, cell_rows=cell_rows))
    links, component, total = brute(vectors)
    assert sorted(r[0] for r in got) == sorted(vectors)
    assert all(r[1] <= links[r[0]] for r in got) and sum(r[1] for r in got) > 0.99 * total
    assert np.mean([r[2] == component[r[0]] for r in got]) > 0.99
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_a_pair_counts_once_however_often_it_meets():
    plan = P.Plan(16, 1, 4, 3, 3, 1)  # few buckets: every pair meets many times
    x = around(np.random.default_rng(5), P.unit(np.ones((1, 16)))[0], 0.99, 60)
    keys = P.bucket_keys(P.unit(x), plan)
    seen = {}
    for t in range(3):
        for key in np.unique(keys[:, t]):
            inside = np.flatnonzero((keys[:, t] == key).any(axis=1))
            for a in inside:
                for b in inside:
                    if a < b and key in (keys[a, t, 0], keys[b, t, 0]):
                        once = P.first_meeting(keys, np.array([a]), np.array([b]), np.array([key]), np.array([t]))[0]
                        seen[a, b] = seen.get((a, b), 0) + int(once)
    met = {(a, b) for a in range(60) for b in range(a + 1, 60) if P.meet(keys[[a]], keys[[b]]).any()}
    assert seen == dict.fromkeys(met, 1)


def test_vector_edges(spark):
    one = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, one, 0), (2, one, 0), (2, [0.0, 1.0, 0.0, 0.0], 0), (9, [0.0, 2.0, 0.1, 0.0], 1), (3, None, None), (4, [0.0] * 4, 1), (5, [float("nan")] * 4, 1), (6, [None, 1.0, 0.0, 0.0], 1), (7, [1.0], 1), (8, [], 1), (None, one, 1), (None, None, None), (10, [2.0], 3), (11, [float("inf"), 1.0, 0.0, 0.0], 3)]
    df = spark.createDataFrame([(*r, r[2], "x", 1) for r in rows], "vec_id long, embedding array<double>, row int, weight int, vector string, h1 int")
    got = rows_of(P.near_duplicates(df))
    want = [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (9, 1, 1, False), (7, 1, 7, True), (10, 1, 7, False), (None, 0, None, None), (None, 0, None, None)]
    want += [(k, 0, k, True) for k in (3, 4, 5, 6, 8, 11)]
    assert sorted(got, key=str) == sorted(want, key=str)  # rows of id 2 are one node
    assert rows_of(P.near_duplicates(df.where("false"))) == []
    assert rows_of(P.near_duplicates(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding")).where("vec_id = 1"))) == [(1, 0, 1, True)]
