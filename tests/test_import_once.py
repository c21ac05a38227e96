"""Imports judge all rows of a product in one shuffle, as the single rules do."""

import random

from pyspark.sql import functions as F

from larder.operators import candidates as C
from larder.operators import changeset as S
from larder.operators import dedup as D
from larder.operators import taxonomy as T
from larder.operators.filters import valid_prediction
from larder.plans import flows

DDL = "id long, barcode string, server_type string, type string, value_tag string, value string, source_image string, automatic_processing boolean, predictor string, predictor_version string"


def rows(spark, seed, first, n=600):
    rng = random.Random(seed)
    made = [
        (
            first + k, rng.choice(["1", "2", "3", None]), rng.choice(["off", "obf", None]), rng.choice(["category", "label", "brand", None]), rng.choice(["a", None]), rng.choice(["v", None]),
            rng.choice([None, "", "/1/1.jpg", "/1/2.jpg", "/1/9.jpg"]), rng.choice([True, None]), rng.choice(["p", None]), rng.choice(["1", "2", None, None]),
        )
        for k in range(n)
    ]
    return spark.createDataFrame(made, DDL)


def products(spark):
    return spark.createDataFrame([("1", "off", ["1", "2"]), ("1", "obf", ["1"]), ("2", "off", ["2"]), ("2", "obf", [])], "code string, server_type string, image_ids array<string>")


def test_import_follows_the_single_rules(spark):
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    for seed in range(4):
        for known in (products(spark), products(spark).drop("server_type").dropDuplicates(["code"])):
            incoming, stored = rows(spark, seed, 0, 12 + 60 * seed), rows(spark, seed + 50, 10_000)
            valid = valid_prediction(incoming, known)
            stale = D.stale_versions(valid, stored)
            remaining = stored.join(stale.select("id"), "id", "left_anti")
            fresh = D.new_predictions(valid, remaining)
            out = S.import_predictions(incoming, stored, known)
            assert ids(out["delete"]) == ids(stale)
            assert ids(out["insert"]) == ids(fresh)
            assert ids(out["table"]) == sorted(ids(remaining) + ids(fresh))
            assert sorted(map(str, out["updated_types"].collect())) == sorted(map(str, valid.select("barcode", "server_type", "type").distinct().collect()))


def test_rows_are_shuffled_once(spark):
    incoming, stored = rows(spark, 1, 0), rows(spark, 2, 10_000)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = S.import_predictions(incoming, stored, products(spark))["table"].select(F.count("*"), F.max("value"))
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the rows and the products
    assert plan.count("Sort [") <= 3, plan


def test_placed_candidates_are_worked_out_once(spark):
    candidates = rows(spark, 3, 0).withColumn("priority", F.lit(1))
    references = rows(spark, 4, 10_000).withColumns({"id": F.concat(F.lit("i"), "id"), "annotation": F.lit(None).cast("int")})
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = S.merge_candidates(candidates, references, ["value_tag"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("Join ") == 2, plan  # blocked and matched, not again for the deletions


def test_types_without_predictions_are_left_out(spark):
    present = spark.createDataFrame([("1", "off", t) for t in ("label", "brand", "nutrient_mention")], "barcode string, server_type string, type string")
    assert flows.possible_types(present, None) == ["label", "brand"]
    assert flows.possible_types(present, ["nutrition_image", "label"]) == ["label"]
    assert flows.possible_types(present, ["category", "store"]) == ["category"]


def plan_of(spark, make):
    """The physical plan as on tables too large for broadcasts."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def merge_inputs(spark, seed):
    pick = F.when(F.col("id") % 7 == 0, 1)
    candidates = rows(spark, seed, 0, 300).withColumn("priority", F.lit(1)).where("type = 'label'").na.drop(subset=["barcode", "server_type"])
    references = rows(spark, seed + 1, 10_000, 200).where("type = 'label'").na.drop(subset=["barcode", "server_type"]).withColumns({"annotation": pick.cast("int"), "id": F.concat(F.lit("i"), "id")})
    return candidates, references


def test_candidates_are_merged_where_they_lie(spark):
    closure = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "ancestor string, descendant string")
    for seed in range(3):
        candidates, references = merge_inputs(spark, 10 * seed)
        for up in (None, closure):
            want = S.merge_candidates(candidates, references, ["value_tag"], closure=up).drop("type")
            got = S.merge_candidates(candidates, references, ["value_tag"], None, up, ["barcode", "server_type"], dealt=True)
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    lying = [df.repartition(4, "barcode", "server_type") for df in merge_inputs(spark, 1)]
    plan = plan_of(spark, lambda: S.merge_candidates(*lying, ["value_tag"], group=["barcode", "server_type"], dealt=True))
    assert "Join " not in plan and all("value_tag" not in line and "insight_id" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line), plan


def test_deepest_tags_meet_their_rows_by_product_alone(spark):
    closure = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "ancestor string, descendant string")
    made = [(1, "1", "a"), (2, "1", "b"), (3, "1", "c"), (4, "1", None), (5, "2", "b"), (6, "2", "b"), (7, "2", "x"), (8, None, "a"), (9, None, "b")]
    tags = spark.createDataFrame(made, "id long, barcode string, value_tag string")
    assert sorted(r["id"] for r in T.deepest_nodes(tags, closure, ["barcode"]).collect()) == [1, 4, 5, 6, 7, 8, 9]
    plan = plan_of(spark, lambda: T.deepest_nodes(tags.repartition(4, "barcode"), closure, ["barcode"]))
    assert "hashpartitioning(barcode#" in plan and not any("barcode" in line and "value_tag" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line), plan


def test_a_run_reads_few_tags_of_a_taxonomy(spark):
    nodes = spark.range(1000).select(F.concat(F.lit("en:n"), "id").alias("id"), F.create_map(F.lit("x"), F.lit("1")).alias("properties"))
    synonyms = spark.range(1000).select(F.concat(F.lit("fr:n"), "id").alias("tag"), F.concat(F.lit("en:n"), "id").alias("id"))
    triple = (nodes, synonyms, spark.createDataFrame([], "ancestor string, descendant string"))
    element = '{"element": {"shape": {"value_tag": "en:n7"}}}'
    made = [("label", "en:n1", "{}"), ("label", "fr:n2", "{}"), ("category", "en:n3", "{}"), ("brand", "en:n4", "{}"), ("packaging", None, element)]
    predictions = spark.createDataFrame(made, "type string, value_tag string, data string")
    products = spark.createDataFrame([([("en:n9", None, None)],)], "packagings array<struct<shape:string,material:string,recycling:string>>")
    dims = flows.Dimensions({k: triple for k in ("label", "category", "shape")}, nodes.select(F.col("id").alias("value_tag")))
    used = flows.used_dimensions(dims, predictions, products, ["label", "category", "packaging", "brand"])
    for name in ("label", "category", "shape"):
        assert sorted(r["id"] for r in used.taxonomy[name][0].collect()) == ["en:n1", "en:n2", "en:n3", "en:n7", "en:n9"]
    assert [r["tag"] for r in used.taxonomy["label"][1].collect()] == ["fr:n2"]
    assert used.authorized.count() == 5 and flows.used_dimensions(dims, predictions, products, ["brand"]).taxonomy == dims.taxonomy


def test_a_stored_nutrient_is_looked_up_once(spark):
    kind = "map<string,struct<value:string,unit:string>>"
    sets = f"array<struct<nutrients:{kind},per:string,preparation:string,source:string>>"
    made = [({"salt_100g": (v, "g")}, [({"salt": ("2", "g")}, "100ml", "as_sold", "packaging")], None) for v in ("2", "3")]
    frame = spark.createDataFrame([*made, ({}, None, None), (None, [], None)], f"nutrients {kind}, sets {sets}, serving_size string")
    out = frame.select(C.nutrients_bring_news(F.col("nutrients"), F.col("sets"), F.col("serving_size")).alias("news"))
    assert [r["news"] for r in out.collect()][:2] == [False, True]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("filter(") <= 2, plan
