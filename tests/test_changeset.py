"""Change sets against a direct greedy selection on random small groups."""

import random

import pytest

from larder.operators import changeset as S
from larder.operators import taxonomy as T

CAND = "id long, barcode string, server_type string, type string, value_tag string, source_image string, automatic_processing boolean, predictor string, priority int"
REF = "id string, barcode string, server_type string, type string, value_tag string, source_image string, automatic_processing boolean, annotation int"


def image(path):
    return int(path.split("/")[-1].split(".")[0]) if path else 0


def greedy(candidates, references, conflicts):
    """Best ranked first; blocked or conflicting candidates fall out; open rows are reused."""
    order = sorted(candidates, key=lambda c: (c[8], -image(c[5]), 0 if c[6] else 1, c[7] or "z", c[0]))
    keep, chosen = set(), []
    blocking = [r for r in references if r[7] is not None or r[6]]
    for c in order:
        if any(conflicts(c[4], r[4]) for r in blocking) or any(conflicts(c[4], s[4]) for s, _ in chosen):
            continue
        same = [r for r in sorted(references) if r[7] is None and conflicts(c[4], r[4]) and c[5] == r[5]]
        chosen.append((c, same[0] if same else None))
        keep |= {r[0] for r in same[:1]}
    out = {("update" if r else "create", c[0], r[0] if r else None) for c, r in chosen}
    return out | {("delete", None, r[0]) for r in references if r not in blocking and r[0] not in keep}


def draw(rng, tags):
    images = [None, "/1/1.jpg", "/1/2.jpg", "/1/3.jpg"]
    cands, refs, n = [], [], 0
    for p in range(12):
        for _ in range(rng.randint(0, 6)):
            n += 1
            cands.append((n, f"p{p}", "off", "label", rng.choice(tags), rng.choice(images), rng.choice([True, False, None]), rng.choice(["a", None]), rng.randint(1, 2)))
        for _ in range(rng.randint(0, 4)):
            n += 1
            refs.append((f"r{n:04d}", f"p{p}", "off", "label", rng.choice(tags), rng.choice(images), rng.choice([True, False, None]), rng.choice([None, None, 0, 1])))
    return cands, refs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_keys(spark, seed):
    cands, refs = draw(random.Random(seed), ["a", "b", "c", None])
    out = S.merge_candidates(spark.createDataFrame(cands, CAND), spark.createDataFrame(refs, REF), ["value_tag"]).select("op", "candidate_id", "insight_id")
    got = {tuple(r) for r in out.collect()}
    want = set()
    for p in {c[1] for c in cands} | {r[1] for r in refs}:
        want |= greedy([c for c in cands if c[1] == p], [r for r in refs if r[1] == p], lambda a, b: a == b)
    assert got == want


def test_taxonomy_rule(spark):
    edges = [("root", "a"), ("root", "b"), ("a", "a1"), ("a", "a2"), ("b", "b1")]
    up = T.taxonomy_closure(spark.createDataFrame(edges, "parent string, child string"))
    pairs = {tuple(r) for r in up.select("ancestor", "descendant").collect()}
    assert ("root", "a1") in pairs and len(pairs) == 8
    cands, refs = draw(random.Random(5), ["root", "a", "b", "a1", "a2", "b1"])
    frame = T.deepest_nodes(spark.createDataFrame(cands, CAND), up, ["barcode"])
    deep = [tuple(r) for r in frame.select("id", "barcode", "server_type", "type", "value_tag", "source_image", "automatic_processing", "predictor", "priority").collect()]
    out = S.merge_candidates(frame, spark.createDataFrame(refs, REF), ["value_tag"], closure=up).select("op", "candidate_id", "insight_id")
    want = set()
    for p in {c[1] for c in cands} | {r[1] for r in refs}:
        want |= greedy([c for c in deep if c[1] == p], [r for r in refs if r[1] == p], lambda a, b: a == b or (a, b) in pairs)
    assert {tuple(r) for r in out.collect()} == want


def test_deepest_nodes_keeps_an_antichain(spark):
    up = spark.createDataFrame([("soups", "miso-soup")], "ancestor string, descendant string")
    rows = spark.createDataFrame([("p", t) for t in ("miso-soup", "meats", "soups", "apricots")], "barcode string, value_tag string")
    assert {r["value_tag"] for r in T.deepest_nodes(rows, up, ["barcode"]).collect()} == {"miso-soup", "meats", "apricots"}


def test_canonical_tag(spark):
    nodes = spark.createDataFrame([("en:organic",)], "id string")
    synonyms = spark.createDataFrame([("fr:bio", "en:organic")], "tag string, id string")
    rows = spark.createDataFrame([("en:organic",), ("fr:bio",), ("xx:none",)], "value_tag string")
    assert {(r["value_tag"], r["canonical"]) for r in T.canonical_tag(rows, nodes, synonyms).collect()} == {("en:organic", "en:organic"), ("fr:bio", "en:organic"), ("xx:none", None)}


def test_applying_twice_changes_nothing(spark):
    cands, refs = draw(random.Random(9), ["a", "b", "c"])
    c, r = spark.createDataFrame(cands, CAND), spark.createDataFrame(refs, REF)
    changes = S.merge_candidates(c, r, ["value_tag"])
    new = c.withColumnRenamed("id", "candidate_id").selectExpr("*", "concat('n', cast(candidate_id as string)) AS insight_id")
    table = S.apply_change_set(r, changes, new)
    again = S.merge_candidates(c, table, ["value_tag"])
    assert {row["op"] for row in again.select("op").distinct().collect()} <= {"update"}
