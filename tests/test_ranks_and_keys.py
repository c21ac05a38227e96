"""Ties, successive updates, products of several projects, deep trees."""

import pytest

from larder import session
from larder.operators import candidates as C
from larder.operators import changeset as S
from larder.operators import joins as J
from larder.operators import ranking as R
from larder.operators import tokens as T

PREDICTION = "id long, barcode string, server_type string, type string, value string, source_image string, predictor string, priority int, automatic_processing boolean"
PRODUCT = "code string, server_type string, quantity string, expiration_date string, countries_tags array<string>, brands_tags array<string>, unique_scans_n int, image_ids array<string>"


def test_latest_value_takes_the_best_ranked_of_equal_values(spark):
    rows = [
        (1, "p", "off", "t", "2024-01-01", "/1/2.jpg", None, 1, True), (2, "p", "off", "t", "2024-01-01", "/1/9.jpg", None, 1, True),
        (3, "q", "off", "t", "2024-01-01", "/1/9.jpg", None, 2, True), (4, "q", "off", "t", "2024-01-01", "/1/3.jpg", None, 1, True),
        (5, "r", "off", "t", "2023-01-01", "/1/9.jpg", None, 1, True), (6, "r", "off", "t", "2024-01-01", "/1/3.jpg", None, 1, True),
    ]
    got = {r.barcode: (r.id, r.automatic_processing) for r in R.latest_value(spark.createDataFrame(rows, PREDICTION)).collect()}
    assert got == {"p": (2, True), "q": (4, True), "r": (6, False)}


def test_last_ranked_candidate_updates_the_row(spark):
    insights = spark.createDataFrame([("a", "p", "off", "label", "old")], "id string, barcode string, server_type string, type string, value_tag string")
    changes = spark.createDataFrame([("update", 9, "a"), ("update", 4, "a")], "op string, candidate_id long, insight_id string")
    columns = "candidate_id long, barcode string, server_type string, type string, value_tag string, priority int, source_image string, automatic_processing boolean, predictor string"
    new = spark.createDataFrame([(9, "p", "off", "label", "first", 1, None, False, None), (4, "p", "off", "label", "second", 2, None, False, None)], columns)
    assert [r.value_tag for r in S.apply_change_set(insights, changes, new).collect()] == ["second"]


def two_projects(spark):
    return spark.createDataFrame([("p", "off", None, None, ["a"], ["x"], 1, ["1"]), ("p", "obf", "9 g", "soon", ["b"], ["y"], 2, [])], PRODUCT)


def test_one_barcode_in_two_projects(spark):
    products = two_projects(spark)
    rows = spark.createDataFrame([(1, "p", "off", "expiration_date", "2024-01-01", None, None, 1, True), (2, "p", "obf", "expiration_date", "2024-01-01", None, None, 1, True)], PREDICTION)
    assert [r.id for r in C.with_product(rows, products, "quantity").where("quantity is null").collect()] == [1]
    assert C.with_product(rows.drop("server_type"), products).count() == 4
    stamped = S.stamp_fields(rows.selectExpr("*", "value as value_tag"), products)
    assert sorted((r.id, r.countries[0], r.unique_scans_n) for r in stamped.collect()) == [(1, "a", 1), (2, "b", 2)]
    assert sorted((r.id, r.brands[0]) for r in J.product_enrich(rows.selectExpr("*", "array('z') as brands", "array('z') as countries", "0 as unique_scans_n"), products).collect()) == [(1, "x"), (2, "y")]
    gone = S.deletions_of_missing_products(rows.selectExpr("*").withColumn("id", rows.id.cast("string")), products.where("server_type = 'off'"))
    assert [r.insight_id for r in gone.collect()] == ["2"]


def test_trees_are_counted_as_deep_as_they_go(spark):
    deep, value = "struct<id:string>", {"id": "n6"}
    for k in range(5, 0, -1):
        deep, value = f"struct<id:string,ingredients:array<{deep}>>", {"id": f"n{k}", "ingredients": [value]}
    trees = spark.createDataFrame([(1, [value]), (2, None)], f"id long, ingredients array<{deep}>")
    nodes = spark.createDataFrame([("n6",), ("n1",)], "id string")
    got = {r.id: (r.ingredients_n, r.known_ingredients_n) for r in T.ingredient_counts(trees, nodes).collect()}
    assert got == {1: (6, 2), 2: (0, 0)}


def test_lineage_is_not_cut_in_a_private_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    monkeypatch.setattr(Session, "conf", type("Conf", (), {"get": staticmethod(lambda key, default: default)}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
