"""Image classes by fingerprint against all pairs."""

import numpy as np
import pytest

from larder.operators import fingerprints as P


def brute(images, distance):
    ids, h = [i for i, _ in images], np.array([x for _, x in images], np.int64).view(np.uint64)
    near = np.bitwise_count(h[:, None] ^ h) <= distance
    np.fill_diagonal(near, False)
    root = {}
    for k in sorted(range(len(ids)), key=lambda k: ids[k]):
        if k not in root:
            root[k], stack = ids[k], [k]
            while stack:
                for j in np.flatnonzero(near[stack.pop()]):
                    if j not in root:
                        root[j] = ids[k]
                        stack.append(int(j))
    return sorted((ids[k], root[k], int(near[k].sum())) for k in range(len(ids)))


def spoilt(rng, h, bits):
    for b in rng.choice(64, bits, replace=False):
        h ^= 1 << int(b)
    return h


def signed(h):
    return P.signed(h)


@pytest.mark.parametrize("distance, tile_rows", [(4, 2048), (4, 16), (0, 2048), (7, 64)])
def test_classes_equal_all_pairs(spark, distance, tile_rows):
    rng = np.random.default_rng(distance)
    hashes = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    for h in hashes[:40]:
        hashes += [spoilt(rng, h, int(b)) for b in rng.integers(0, distance + 3, 4)]
    hashes += [spoilt(rng, hashes[0], 2) for _ in range(120)] + [hashes[1]] * 60  # a hot group, and equal ones
    images = [(int(i), signed(h)) for i, h in zip(rng.permutation(len(hashes)), hashes, strict=True)]
    df = spark.createDataFrame(images, "id long, fingerprint long")
    got = sorted(tuple(r) for r in P.fingerprint_duplicates(df, distance, tile_rows=tile_rows, cell_rows=200).collect())
    assert got == brute(images, distance)


def test_ten_thousand_equal_hashes_and_edges(spark):
    rows = [(k, 5) for k in range(10_000)] + [(20_000, 7), (20_001, -1), (20_002, None), (None, 5), (20_001, -1)]
    df = spark.createDataFrame(rows, "id long, fingerprint long")
    got = {(r.id, r.class_id, r.n_links) for r in P.fingerprint_duplicates(df, 1).collect()}
    assert got == {(k, 0, 10_000) for k in range(10_000)} | {(20_000, 0, 10_000), (20_001, 20_001, 1)}
    assert P.fingerprint_duplicates(df.where("false")).count() == 0


def test_masks_hold_every_pair():
    rng = np.random.default_rng(1)
    for hashes, distance in ((100, 4), (10**6, 4), (10**9, 3), (10**5, 7)):
        masks = P.masks_for(hashes, distance)
        assert 1 <= len(masks) <= 128
        for _ in range(300):
            apart = spoilt(rng, 0, distance)
            assert any(apart & m == 0 for m in masks)


def test_chains_reach_their_least_node(spark):
    links = [(k, k + 1) for k in range(100, 400)] + [(1000 - k, 999 - k) for k in range(50)] + [(7, 7), (5000, 6000), (6000, 5500)]
    got = dict(tuple(r) for r in P.least_reachable(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(100, 401), 100), **dict.fromkeys(range(950, 1001), 950), 5000: 5000, 6000: 5000, 5500: 5000}
