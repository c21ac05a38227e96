"""Queries: sources, sinks, filters, joins, aggregates, order and set operations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import boxes, paths
from larder.operators import aggregates as A
from larder.operators import dedup as D
from larder.operators import filters as P
from larder.operators import joins as J
from larder.operators import questions as Q
from larder.operators import ranking as R
from larder.operators import running as S
from larder.plans.registry import Data, query
from larder.plans.roles import product_full, stamped, with_json
from larder.session import checkpoint_dir
from larder.sources import readers, writers


BASE_URL = "https://images.example.org"


def scratch(d: Data, name: str) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(d.spark)}/larder-{name}-{uuid.uuid4().hex}"


def joined(column: str):
    return F.array_join(F.col(column), ",").alias(column)


# --- sources ------------------------------------------------------------------

PRODUCT_DDL = "code string, lang string, product_name string, brands_tags array<string>, unique_scans_n int, schema_version int"


@query("scan_products_jsonl", "SELECT code, lang, product_name, array_to_string(brands_tags, ',') AS brands_tags, unique_scans_n FROM product")
def _(d):
    path = scratch(d, "products")
    writers.sink_jsonl(d.product.select("code", "lang", "product_name", "brands_tags", "unique_scans_n", "schema_version"), path)
    return readers.scan_products_jsonl(d.spark, path, PRODUCT_DDL, 8).select("code", "lang", "product_name", joined("brands_tags"), "unique_scans_n")


@query("scan_products_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(d):
    return readers.scan_products_parquet(d.spark, f"{d.folder}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_product_project", "SELECT code, lang, array_to_string(image_ids, ',') AS image_ids FROM product")
def _(d):
    out = readers.scan_product_project(product_full(d).drop("image_ids"), ["code", "lang", "image_ids"])
    return out.withColumn("image_ids", F.array_join(F.array_sort("image_ids"), ","))


@query("product_defaults", """
SELECT code, coalesce(array_to_string(categories_tags, ','), '') AS categories, len(coalesce(categories_tags, [])) AS n_categories,
  CASE WHEN quantity <> '' THEN quantity END AS quantity, coalesce(unique_scans_n, 0) AS unique_scans_n, schema_version,
  CASE WHEN lang = 'fr' THEN 'eau ' || code END AS text_fr, CASE WHEN lang <> 'fr' THEN 'water ' || code END AS text_main FROM product
""")
def _(d):
    docs = d.product.withColumns({
        "ingredients_text_fr": F.when(F.col("lang") == "fr", F.concat(F.lit("eau "), "code")),
        "ingredients_text": F.when(F.col("lang") != "fr", F.concat(F.lit("water "), "code")).otherwise(""),
    })
    out = readers.product_defaults(docs)
    text = F.col("ingredients_text")
    return out.select(
        "code", F.array_join("categories_tags", ",").alias("categories"), F.size("categories_tags").cast("long").alias("n_categories"), "quantity",
        "unique_scans_n", "schema_version", F.try_element_at(text, F.lit("fr")).alias("text_fr"), F.try_element_at(text, F.lit("main")).alias("text_main"),
    )


@query("minify_products", "SELECT code, lang, quantity, unique_scans_n FROM product")
def _(d):
    return readers.minify_products(d.product).drop("countries_tags", "categories_tags", "emb_codes_tags", "labels_tags", "brands_tags", "stores_tags", "expiration_date")


@query("product_lookup", """
SELECT k.barcode AS code, p.lang, p.quantity, p.code IS NOT NULL AS found
FROM (SELECT DISTINCT CASE WHEN length(barcode) = 8 THEN 'x' || barcode ELSE barcode END AS barcode FROM image) k LEFT JOIN product p ON k.barcode = p.code
""")
def _(d):
    keys = d.image.select(F.when(F.length("barcode") == 8, F.concat(F.lit("x"), "barcode")).otherwise(F.col("barcode")).alias("code")).distinct()
    return readers.product_lookup(d.product, keys, ["code"], ["lang", "quantity"])


def ocr_rows(d: Data) -> DataFrame:
    """OCR archive documents made of the texts: some without content, some with errors."""
    doc = F.col("doc_id")
    source = F.concat(F.when(doc % 10 == 3, F.lit("/images/")).otherwise(F.lit("//")), F.lpad(doc.cast("string"), 3, "0"), F.lit("/123/456/7890/"), (doc % 4 + 1).cast("string"), F.lit(".json"))
    full = F.when(doc % 6 != 0, F.struct(F.col("text").alias("text")))
    listed = F.array(F.struct(F.col("text").alias("description"), F.lit("fr").alias("locale")))
    error = F.when(doc % 7 == 0, F.struct(F.lit(7).alias("code"), F.lit("failed").alias("message")))
    response = F.struct(error.alias("error"), full.alias("fullTextAnnotation"), listed.alias("textAnnotations"))
    content = F.when(doc % 11 != 0, F.struct(F.when(doc % 13 != 0, F.array(response)).otherwise(F.array_repeat(response, 0)).alias("responses")))
    return d.ocr_text.select("doc_id", source.alias("source"), content.alias("content"))


OCR_VALID = "doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 7 <> 0 AND doc_id % 10 <> 3"


@query("scan_ocr_archive", f"""
SELECT lpad(cast(doc_id AS string), 3, '0') || '1234567890' AS barcode,
  '/' || lpad(cast(doc_id AS string), 3, '0') || '/123/456/7890/' || cast(doc_id % 4 + 1 AS string) || '.jpg' AS source_image, length(text) AS n
FROM ocr_text WHERE {OCR_VALID}
""")
def _(d):
    from larder import schemas

    path = scratch(d, "ocr")
    ocr_rows(d).drop("doc_id").write.json(path)
    rows = readers.scan_ocr_archive(d.spark.read.schema(schemas.OCR_ROW).json(path))
    return rows.select("barcode", "source_image", F.length(F.coalesce("response.fullTextAnnotation.text", F.col("response.textAnnotations")[0]["description"])).cast("long").alias("n"))


@query("scan_ocr_files", """
SELECT stem, path, content_size FROM (
  SELECT '/ocr/' || cast(o_custkey AS string) AS stem, '/ocr/' || cast(o_custkey AS string) || CASE WHEN o_orderkey % 2 = 0 THEN '.json' ELSE '.json.gz' END AS path,
    o_orderkey AS content_size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, '/ocr/' || cast(o_custkey AS string) || CASE WHEN o_orderkey % 2 = 0 THEN '.json' ELSE '.json.gz' END DESC, o_orderkey DESC) AS rn
  FROM (SELECT o_custkey, o_orderdate, o_orderkey % 2 AS m, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2, 3)) WHERE rn = 1
""")
def _(d):
    """Listing with the newer of two spellings per image."""
    path = F.concat(F.lit("/ocr/"), F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".json").otherwise(".json.gz"))
    one = d.orders.groupBy("o_custkey", "o_orderdate", F.col("o_orderkey") % 2).agg(F.max("o_orderkey").alias("o_orderkey"))
    files = one.select(path.alias("path"), F.col("o_orderdate").cast("timestamp").alias("modificationTime"), F.col("o_orderkey").alias("content"))
    return readers.scan_ocr_files(files).select("stem", "path", F.col("content").alias("content_size"))


@query("ocr_extract_text", f"SELECT doc_id, text, replace(text, chr(10), ' ') AS text_contiguous FROM ocr_text WHERE {OCR_VALID.replace(' AND doc_id % 10 <> 3', '')}")
def _(d):
    raw = ocr_rows(d).select("doc_id", F.to_json("content").alias("content"))
    return readers.ocr_extract_text(readers.parse_ocr_json(raw)).select("doc_id", "text", "text_contiguous")


@query("scan_predictions_jsonl", "SELECT id, barcode, type, value_tag, value, source_image, automatic_processing, predictor FROM prediction")
def _(d):
    path = scratch(d, "predictions")
    with_json(d.prediction).drop("created_at", "priority", "matcher_type", "from_name", "l_orderkey", "o_custkey").write.option("compression", "gzip").json(path)
    return readers.scan_predictions_jsonl(d.spark, path).select("id", "barcode", "type", "value_tag", "value", "source_image", "automatic_processing", "predictor")


@query("scan_dictionary", "SELECT 'k' || cast(p_partkey AS string) AS key, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS pattern FROM part")
def _(d):
    path = scratch(d, "dictionary")
    line = F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit("||"), "p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("||"), "p_brand")).otherwise(""))
    noise = d.part.where(F.col("p_partkey") % 5 == 0).select(F.when(F.col("p_partkey") % 2 == 0, "// note").otherwise("").alias("value"))
    writers.sink_text(d.part.select(line.alias("value")).unionByName(noise), path)
    return readers.scan_dictionary(d.spark, path)


@query("scan_taxonomy", """
SELECT n.id, n.name_en, e.parents FROM node n LEFT JOIN (SELECT child, string_agg(parent, ',' ORDER BY parent) AS parents FROM (SELECT DISTINCT parent, child FROM edge) GROUP BY child) e ON n.id = e.child
""")
def _(d):
    """One JSON object per shard of nodes, exploded back to rows."""
    parents = d.edge.distinct().groupBy("child").agg(F.array_sort(F.collect_list("parent")).alias("parents"))
    rows = d.node.join(parents, d.node["id"] == parents["child"], "left")
    body = F.struct(F.create_map(F.lit("en"), "name_en").alias("names"), F.col("parents"))
    objects = rows.select(F.to_json(F.create_map("id", body)).alias("value"))
    out = readers.taxonomy_nodes(objects)
    return out.select("id", F.col("names")["en"].alias("name_en"), F.when(F.size("parents") > 0, F.array_join("parents", ",")).alias("parents"))


def detections(d: Data) -> DataFrame:
    """Object detections per image from the logo rows."""
    box = F.array(F.lit(0.1), F.lit(0.1), F.col("score") / 2 + 0.2, F.lit(0.5))
    objects = F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), F.struct(F.col("score"), box.alias("bounding_box"), F.concat(F.lit("l"), (F.col("idx") % 3).cast("string")).alias("label")).alias("o"))))
    return d.logo.groupBy("barcode", "l_orderkey").agg(F.transform(objects, lambda x: x["o"]).alias("result")).select("barcode", F.col("l_orderkey").cast("string").alias("image_id"), "result")


@query("scan_detections_jsonl", "SELECT barcode, cast(l_orderkey AS string) AS image_id, count(*) AS n_objects, max(score) AS best FROM logo GROUP BY barcode, l_orderkey")
def _(d):
    path = scratch(d, "detections")
    detections(d).write.json(path)
    rows = readers.scan_detections_jsonl(d.spark, path)
    return rows.select("barcode", "image_id", F.size("result").cast("long").alias("n_objects"), P.max_confidence(F.col("result")).alias("best"))


@query("import_image_predictions", "SELECT p.id, i.source_image, p.model_name FROM image_prediction p JOIN image i ON p.image_id = i.id")
def _(d):
    rows = d.image_prediction.drop("image_id").join(d.image.select((F.col("id") * 10).alias("id"), "barcode", "image_id"), "id")
    return readers.image_prediction_rows(rows).select("id", "source_image", "model_name")


@query("scan_vectors", "SELECT vec_id, label, len(embedding) AS dim FROM embeddings WHERE len(embedding) = 64")
def _(d):
    return readers.scan_vectors(d.embeddings, dim=64).select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("scan_predictions_for_products", """
SELECT id, barcode, type, value_tag FROM prediction WHERE server_type = 'off' AND type IN ('label', 'brand')
  AND barcode IN (SELECT code FROM product WHERE lang = 'fr')
""")
def _(d):
    codes = d.product.where("lang = 'fr'").select(F.col("code").alias("barcode"))
    return readers.scan_predictions_for_products(d.prediction, codes, "off", ["label", "brand"]).select("id", "barcode", "type", "value_tag")


@query("dataset_integrity_check", "SELECT count(*) AS n_rows, count(*) >= 1000 AS valid FROM orders")
def _(d):
    return readers.dataset_integrity_check(d.orders, 1000)


# --- sinks (write, read back) -------------------------------------------------


@query("sink_parquet", "SELECT id, type, value_tag FROM insight")
def _(d):
    path = scratch(d, "insights")
    writers.sink_parquet(d.insight.select("id", "type", "value_tag"), path, partition_by=["type"])
    return d.spark.read.parquet(path).select("id", "type", "value_tag")


@query("sink_jsonl", "SELECT id, barcode FROM prediction")
def _(d):
    path = scratch(d, "jsonl")
    writers.sink_jsonl(d.prediction.select("id", "barcode"), path)
    return d.spark.read.schema("id long, barcode string").json(path)


@query("sink_csv_dump", "SELECT id, type, annotation FROM insight WHERE annotation = -1 AND server_type = 'off' AND type = 'label'")
def _(d):
    path = scratch(d, "csv")
    rows = P.insight_filter(d.insight, annotated=True, annotation=-1, types=["label"]).select("id", "type", "annotation")
    writers.sink_csv_dump(rows, path)
    return d.spark.read.schema("id string, type string, annotation int").option("header", "true").csv(path)


@query("sink_text", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY p_name")
def _(d):
    path = scratch(d, "text")
    writers.sink_text(d.part, path, "p_name")
    return d.spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("sink_metrics", """
SELECT type, predictor, count(*) AS n FROM insight GROUP BY type, predictor
""")
def _(d):
    path = scratch(d, "metrics")
    counts = d.insight.groupBy("type", "predictor").agg(F.count(F.lit(1)).alias("n"))
    writers.sink_metrics(A.metric_points(counts, "insights", ["type", "predictor"], ["n"], F.lit("2024-01-01 00:00:00").cast("timestamp")), path)
    back = d.spark.read.parquet(path)
    return back.select(F.col("tags")["type"].alias("type"), F.col("tags")["predictor"].alias("predictor"), F.col("fields")["n"].cast("long").alias("n"))


@query("sink_logo_export", "SELECT id, barcode, source_image, annotation_type, username FROM logo")
def _(d):
    path = scratch(d, "logos")
    writers.sink_logo_export(d.logo.withColumnRenamed("idx", "index"), path)
    return d.spark.read.schema("id long, barcode string, source_image string, annotation_type string, username string").json(path)


@query("sink_batch_insert", "SELECT server_type, count(*) * 2 AS n FROM image GROUP BY server_type")
def _(d):
    path = scratch(d, "inserted")
    rows = d.image.select("id", "server_type")
    writers.sink_batch_insert(rows, path)
    writers.sink_batch_insert(rows, path)
    return d.spark.read.parquet(path).groupBy("server_type").agg(F.count(F.lit(1)).alias("n"))


# --- filters ------------------------------------------------------------------


@query("filter_country_tag", "SELECT code, lang FROM product WHERE list_contains(countries_tags, 'en:c3')")
def _(d):
    return P.filter_country_tag(d.product, "en:c3").select("code", "lang")


@query("filter_state_tag", "SELECT code, lang FROM product WHERE list_contains(states_tags, 'state-2')")
def _(d):
    return P.filter_state_tag(d.product, "state-2").select("code", "lang")


@query("filter_text_eq", "SELECT code, product_name FROM product WHERE coalesce(product_name, '') = ''")
def _(d):
    return P.filter_text_eq(d.product, "product_name", "").select("code", "product_name")


@query("filter_number", "SELECT id, unique_scans_n, confidence FROM insight WHERE unique_scans_n >= 100 AND coalesce(confidence, 0) < 100000")
def _(d):
    return P.filter_number(P.filter_number(d.insight, "unique_scans_n", 100, "geq"), "confidence", 100000, "lt", 0.0).select("id", "unique_scans_n", "confidence")


@query("filter_text_nonempty", "SELECT code, product_name FROM product WHERE product_name IS NOT NULL AND product_name <> ''")
def _(d):
    return P.filter_text_nonempty(d.product, "product_name").select("code", "product_name")


@query("filter_text_empty", "SELECT code, lang FROM product WHERE product_name IS NULL OR product_name = ''")
def _(d):
    return P.filter_text_empty(d.product, "product_name").select("code", "lang")


@query("filter_tags_nonempty", "SELECT code FROM product WHERE len(categories_tags) > 0")
def _(d):
    return P.filter_tags_nonempty(d.product, "categories_tags").select("code")


@query("filter_tags_empty", "SELECT code FROM product WHERE coalesce(len(categories_tags), 0) = 0")
def _(d):
    return P.filter_tags_empty(d.product, "categories_tags").select("code")


@query("filter_modified", "SELECT code, last_modified_t FROM product WHERE last_modified_t >= 1600100000")
def _(d):
    return P.filter_modified(d.product, 1600100000, 1600100001).select("code", "last_modified_t")


@query("take_n", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def _(d):
    return P.take_n(d.orders.select("o_orderkey").orderBy("o_orderkey"), 50)


@query("insight_filter", """
SELECT id, type, value_tag FROM insight WHERE server_type = 'off' AND annotation IS NULL AND automatic_processing = false AND type IN ('label', 'category', 'brand')
  AND list_has_any(countries, ['en:c1', 'en:c2', 'en:c3', 'en:c4', 'en:c5']) AND reserved_barcode = false AND list_has_all(campaign, ['missing-category'])
  AND list_has_any(lc, ['fr']) AND with_image = true
""")
def _(d):
    return P.insight_filter(
        d.insight, automatically_processable=False, types=["label", "category", "brand"], countries=["en:c1", "en:c2", "en:c3", "en:c4", "en:c5"],
        reserved_barcode=False, campaigns=["missing-category"], lc=["fr"], with_image=True,
    ).select("id", "type", "value_tag")


@query("image_filter", """
SELECT i.id, i.source_image FROM image i WHERE i.server_type = 'off' AND NOT EXISTS (SELECT 1 FROM image_prediction p WHERE p.image_id = i.id)
""")
def _(d):
    return P.image_filter(d.image, d.image_prediction).select("id", "source_image")


@query("prediction_filter", "SELECT id, type, value_tag FROM prediction WHERE server_type = 'off' AND type IN ('label', 'category') AND value_tag = 'en:n7'")
def _(d):
    return P.prediction_filter(d.prediction, value_tag="en:n7", types=["label", "category"]).select("id", "type", "value_tag")


@query("image_prediction_filter", """
SELECT p.id, p.max_confidence FROM image_prediction p JOIN image i ON p.image_id = i.id
WHERE i.server_type = 'off' AND p.model_name = 'nutrition-table' AND p.max_confidence >= 0.5 AND NOT EXISTS (SELECT 1 FROM logo l WHERE l.image_prediction_id = p.id)
""")
def _(d):
    return P.image_prediction_filter(d.image_prediction, d.image, d.logo, model_name="nutrition-table", min_confidence=0.5).select("id", "max_confidence")


@query("logo_filter", """
SELECT l.id, l.annotation_type FROM logo l JOIN image_prediction p ON l.image_prediction_id = p.id JOIN image i ON p.image_id = i.id
WHERE i.server_type = 'off' AND NOT i.deleted AND l.annotation_type IN ('brand', 'label') AND l.annotation_value_tag = 'value-3'
""")
def _(d):
    return P.logo_filter(d.logo, d.image_prediction, d.image, value_tag="value-3", types=["brand", "label"]).select("id", "annotation_type")


@query("page_insights", """
SELECT p.id, p.unique_scans_n, t.total FROM (
  SELECT id, unique_scans_n FROM insight WHERE server_type = 'off' AND annotation IS NULL AND type IN ('label', 'brand') ORDER BY unique_scans_n DESC, id LIMIT 20 OFFSET 20) p,
  (SELECT count(*) AS total FROM insight WHERE server_type = 'off' AND annotation IS NULL AND type IN ('label', 'brand')) t
""")
def _(d):
    page, total = Q.page_insights(d.insight, 2, 20, ["label", "brand"], order="popularity")
    return page.select("id", "unique_scans_n").withColumn("total", F.lit(total.first()["count"]))


def _page_query(d, filtered, order, columns, number=2, count=25):
    page, total = Q.list_page(filtered, number, count, order)
    return page.select(*columns).withColumn("total", F.lit(total.first()["count"]))


@query("page_images", """
WITH f AS (SELECT i.id, i.source_image FROM image i WHERE i.server_type = 'off' AND NOT EXISTS (SELECT 1 FROM image_prediction p WHERE p.image_id = i.id))
SELECT id, source_image, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 25 OFFSET 25
""")
def _(d):
    return _page_query(d, P.image_filter(d.image, d.image_prediction), [F.col("id")], ["id", "source_image"])


@query("page_predictions", """
WITH f AS (SELECT id, type, value_tag FROM prediction WHERE server_type = 'off' AND type = 'label')
SELECT id, type, value_tag, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 25 OFFSET 25
""")
def _(d):
    return _page_query(d, P.prediction_filter(d.prediction, types=["label"]), [F.col("id")], ["id", "type", "value_tag"])


@query("page_image_predictions", """
WITH f AS (SELECT p.id, p.model_name FROM image_prediction p JOIN image i ON p.image_id = i.id WHERE i.server_type = 'off' AND p.model_name = 'nutriscore')
SELECT id, model_name, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 25 OFFSET 25
""")
def _(d):
    rows = P.image_prediction_filter(d.image_prediction, d.image, d.logo, model_name="nutriscore", with_logo=True)
    return _page_query(d, rows, [F.col("id")], ["id", "model_name"])


@query("page_logos", """
WITH f AS (SELECT l.id, l.image_prediction_id FROM logo l JOIN image_prediction p ON l.image_prediction_id = p.id JOIN image i ON p.image_id = i.id
  WHERE i.server_type = 'off' AND NOT i.deleted AND l.annotation_type = 'brand')
SELECT id, image_prediction_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY image_prediction_id DESC, id LIMIT 25 OFFSET 25
""")
def _(d):
    rows = P.logo_filter(d.logo, d.image_prediction, d.image, types=["brand"])
    return _page_query(d, rows, [F.col("image_prediction_id").desc(), F.col("id")], ["id", "image_prediction_id"])


@query("insight_by_id", "SELECT id, type, value FROM insight WHERE id = 'i000000042'")
def _(d):
    return P.insight_by_id(d.insight, "i000000042").select("id", "type", "value")


@query("insights_of_product", "SELECT id, type, value_tag FROM insight WHERE barcode = '3000000160036' AND server_type = 'off' AND annotation IS NULL")
def _(d):
    return P.insights_of_product(d.insight, "3000000160036").select("id", "type", "value_tag")


@query("logo_search", "SELECT id, score FROM logo WHERE server_type = 'off' AND annotation_type = 'brand' AND annotation_value IS NOT NULL AND annotation_value_tag = 'value-5' AND score >= 0.3")
def _(d):
    return P.logo_search(d.logo, type="brand", value="Value 5", min_confidence=0.3, annotated=True).select("id", "score")


@query("annotation_request_check", """
SELECT id, CASE WHEN annotation IS NULL OR annotation NOT IN (-1, 0, 1, 2) THEN 'invalid annotation' WHEN annotation = 2 AND NOT has_data THEN 'data must be provided if annotation is 2'
  WHEN annotation <> 2 AND has_data THEN 'data can only be provided if annotation is 2' WHEN annotation = 2 AND NOT upd THEN 'annotation 2 needs update'
  WHEN annotation = 2 AND u IS NULL THEN 'annotation 2 needs a signed-in user' END AS reject_reason, u IS NOT NULL AS trusted
FROM (SELECT id, value + 1 AS annotation, id % 3 = 0 AS has_data, id % 5 <> 0 AS upd, CASE WHEN id % 2 = 0 THEN NULL ELSE username END AS u FROM vote)
""")
def _(d):
    requests = d.vote.select(
        "id", (F.col("value") + 1).alias("annotation"), F.when(F.col("id") % 3 == 0, "{}").alias("data"), (F.col("id") % 5 != 0).alias("update"),
        F.when(F.col("id") % 2 == 0, "null").otherwise(F.col("username")).alias("username"),
    )
    return P.annotation_request_check(requests).select("id", "reject_reason", "trusted")


@query("valid_image", """
SELECT p.id, p.source_image IS NOT NULL AND list_contains(c.image_ids, regexp_extract(p.source_image, '([0-9]+)[.]jpg$', 1)) AS valid,
  p.source_image IS NULL OR list_contains(c.image_ids, regexp_extract(p.source_image, '([0-9]+)[.]jpg$', 1)) AS valid_insight
FROM prediction p JOIN product c ON p.barcode = c.code
""")
def _(d):
    rows = d.prediction.join(d.product.select(F.col("code").alias("barcode"), "image_ids"), "barcode")
    src, ids = F.col("source_image"), F.col("image_ids")
    return rows.select("id", P.valid_image(src, ids).alias("valid"), P.valid_insight_image(src, ids).alias("valid_insight"))


IMG = "regexp_extract(i.source_image, '([0-9]+)[.]jpg$', 1)"


@query("special_image", f"""
SELECT i.id, EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.img_key LIKE 'front%' AND m.imgid = i.image_id) AS front,
  EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.img_key LIKE 'nutrition%fr' AND m.imgid = i.image_id) AS nutrition_fr,
  EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.imgid = i.image_id) AS selected,
  EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.img_key LIKE 'nutrition_en%') AS has_nutrition_en
FROM image i
""")
def _(d):
    rows = d.image.join(product_full(d).select(F.col("code").alias("barcode"), "images"), "barcode")
    src, images = F.col("source_image"), F.col("images")
    return rows.select(
        "id", P.special_image(src, images, "front").alias("front"), P.special_image(src, images, "nutrition", "fr").alias("nutrition_fr"),
        P.selected_image(paths.image_id(src), images).alias("selected"), P.has_special_image(images, "nutrition", "en").alias("has_nutrition_en"),
    )


@query("authorized_labels", """
SELECT id, value_tag, value_tag IN (SELECT id FROM node WHERE p_partkey % 4 = 0) AS authorized FROM prediction WHERE type = 'label'
""")
def _(d):
    allowed = d.node.where("p_partkey % 4 = 0").select(F.col("id").alias("value_tag"))
    return P.authorized_labels(d.prediction.where("type = 'label'"), allowed).select("id", "value_tag", "authorized")


@query("existing_insights", "SELECT id, barcode FROM insight WHERE type = 'brand' AND (barcode, server_type) IN (SELECT code, server_type FROM product WHERE lang = 'de')")
def _(d):
    keys = d.product.where("lang = 'de'").select(F.col("code").alias("barcode"), "server_type")
    return P.existing_insights(d.insight, keys, "brand").select("id", "barcode")


@query("recent_image", """
SELECT i.id, coalesce(max(o.o_orderkey) * 1000 - max(i.o) * 1000 <= 500000, true) AS recent FROM (SELECT id, barcode, id AS o FROM image) i
LEFT JOIN product_image o ON o.code = i.barcode AND o.o_orderkey <> i.o GROUP BY i.id
""")
def _(d):
    rows = d.image.join(product_full(d).select(F.col("code").alias("barcode"), "images"), "barcode")
    return rows.select("id", P.recent_image(F.col("image_id"), F.col("images"), 500000).alias("recent"))


@query("reserved_barcode", "SELECT code, (CASE WHEN code LIKE '0%' THEN substring(code, 2) ELSE code END) LIKE '2%' AS reserved FROM product")
def _(d):
    return d.product.select("code", paths.is_reserved(F.col("code")).alias("reserved"))


@query("valid_prediction", """
SELECT p.id, p.type FROM prediction p JOIN product c ON p.barcode = c.code
WHERE c.lang <> 'en' AND (p.source_image IS NULL OR list_contains(c.image_ids, regexp_extract(p.source_image, '([0-9]+)[.]jpg$', 1)))
""")
def _(d):
    return P.valid_prediction(d.prediction, d.product.where("lang <> 'en'")).select("id", "type")


@query("detection_filter", """
SELECT l_orderkey AS image, sum(CASE WHEN score > 0.1 THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN score >= 0.8 AND idx % 3 = 1 THEN 1 ELSE 0 END)::BIGINT AS tables FROM logo GROUP BY l_orderkey
""")
def _(d):
    objects = F.col("result")
    return detections(d).select(
        F.col("image_id").cast("long").alias("image"), F.size(P.detection_filter(objects, 0.1)).cast("long").alias("kept"),
        F.size(P.detection_filter(objects, 0.8, "l1", strict=False)).cast("long").alias("tables"),
    )


@query("barcode_rewrite", """
SELECT id, barcode, lpad(ltrim(barcode, '0'), 13, '0') AS new_barcode,
  '/' || substring(lpad(ltrim(barcode, '0'), 13, '0'), 1, 3) || '/' || substring(lpad(ltrim(barcode, '0'), 13, '0'), 4, 3) || '/' || substring(lpad(ltrim(barcode, '0'), 13, '0'), 7, 3)
  || '/' || substring(lpad(ltrim(barcode, '0'), 13, '0'), 10) || '/' || image_id || '.jpg' AS new_source_image
FROM (SELECT id, CASE WHEN length(barcode) = 13 THEN '00' || barcode ELSE barcode END AS barcode, image_id FROM image) WHERE length(ltrim(barcode, '0')) > 8 AND barcode <> lpad(ltrim(barcode, '0'), 13, '0')
""")
def _(d):
    long = d.image.select("id", F.when(F.length("barcode") == 13, F.concat(F.lit("00"), "barcode")).otherwise(F.col("barcode")).alias("barcode"), "source_image")
    return P.barcode_rewrite(long).select("id", "barcode", "new_barcode", "new_source_image")


@query("clean_redundant_data", """
SELECT id, (CASE WHEN o_orderkey % 3 = 0 AND source_image IS NULL THEN 1 WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END)
  + CASE WHEN o_orderkey % 2 = 0 AND type IN ('label', 'brand', 'store', 'category') THEN 0 ELSE 1 END + 1 AS n_left, (o_orderkey % 3 <> 0 OR source_image IS NULL) AS source_error
FROM insight
""")
def _(d):
    tag_key = F.when(F.col("type") == "category", "category").otherwise(F.concat("type", F.lit("_tag")))
    data = F.create_map(
        F.lit("source"), F.when(F.col("o_orderkey") % 3 == 0, F.coalesce("source_image", F.lit("?"))).otherwise("other"),
        tag_key, F.when(F.col("o_orderkey") % 2 == 0, F.coalesce("value_tag", F.lit("none"))).otherwise("other"), F.lit("kept"), F.lit("x"),
    )
    return P.clean_redundant_data(d.insight.withColumn("data", data)).select("id", F.size("cleaned").alias("n_left"), "source_error")


# --- joins --------------------------------------------------------------------


@query("join_logo_image", """
SELECT l.id, p.model_name, i.deleted, i.width FROM logo l JOIN image_prediction p ON l.image_prediction_id = p.id JOIN image i ON p.image_id = i.id
""")
def _(d):
    return J.join_logo_image(d.logo, d.image_prediction, d.image).select("id", "model_name", "deleted", "width")


@query("join_prediction_image", "SELECT p.id, p.model_name, i.barcode, i.source_image FROM image_prediction p JOIN image i ON p.image_id = i.id")
def _(d):
    return J.join_prediction_image(d.image_prediction, d.image).select("id", "model_name", "barcode", "source_image")


@query("join_image_facts", """
SELECT i.source_image, CASE WHEN i.id % 3 = 0 THEN 90 END AS rotation, CASE WHEN i.id % 2 = 0 THEN i.id END AS n_words, l.n AS n_tables
FROM image i LEFT JOIN (SELECT source_image, sum(CASE WHEN score >= 0.5 AND idx % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM logo GROUP BY source_image) l ON i.source_image = l.source_image
""")
def _(d):
    rot = d.image.where("id % 3 = 0").select("source_image", F.lit(90).alias("rotation"))
    lang = d.image.where("id % 2 = 0").select("source_image", F.create_map(F.lit("words"), "id").alias("lang_counts"))
    obj = F.struct(F.col("score"), F.when(F.col("idx") % 2 == 0, "nutrition-table").otherwise("other").alias("label"))
    tables = d.logo.groupBy("source_image").agg(F.collect_list(obj).alias("objects"))
    out = J.join_image_facts(d.image, rot, lang, tables)
    return out.select("source_image", "rotation", F.col("lang_counts")["words"].alias("n_words"), F.size("nutrition_tables").cast("long").alias("n_tables"))


@query("product_ocr_texts", """
SELECT p.code AS barcode, string_agg(i.source_image, '|' ORDER BY i.id) AS texts FROM product p JOIN image i ON i.barcode = p.code WHERE i.id % 3 <> 0 GROUP BY p.code
""")
def _(d):
    texts = d.image.where("id % 3 <> 0").select("barcode", "image_id", F.col("source_image").alias("text"))
    return J.product_ocr_texts(d.product, texts).select("barcode", F.array_join("texts", "|").alias("texts"))


@query("vector_cache_join", """
WITH r AS (SELECT code, o_orderkey, row_number() OVER (PARTITION BY code ORDER BY o_orderkey DESC) AS rn FROM product_image)
SELECT code AS barcode, cast(o_orderkey AS string) AS image_id, o_orderkey % 4 = 0 AS cached FROM r WHERE rn <= 10
""")
def _(d):
    cache = d.image.where("id % 4 = 0").select("barcode", "image_id", F.array(F.col("width").cast("float")).alias("embedding"))
    found, missing = J.vector_cache_join(d.product, cache)
    return found.select("barcode", "image_id", F.lit(True).alias("cached")).unionByName(missing.select("barcode", "image_id", F.lit(False).alias("cached")))


@query("join_embedding_logo", """
SELECT e.vec_id AS logo_id, l.barcode, p.model_version FROM embeddings e JOIN (SELECT o_orderkey AS id, o_orderkey * 10 AS ip, barcode FROM (SELECT o_orderkey, barcode FROM insight)) l ON e.vec_id = l.id
JOIN image_prediction p ON l.ip = p.id
""")
def _(d):
    logos = d.insight.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 10).alias("image_prediction_id"), "barcode", "server_type", "source_image")
    emb = d.embeddings.select(F.col("vec_id").alias("logo_id"), "embedding")
    return J.join_embedding_logo(emb, logos, d.image_prediction).select("logo_id", "barcode", "model_version")


@query("images_without_prediction", """
SELECT id FROM image i WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM image_prediction p WHERE p.image_id = i.id AND p.model_name = 'logo-detector')
""")
def _(d):
    return J.images_without_prediction(d.image, d.image_prediction, "logo-detector").select("id")


@query("predictions_without_logo", "SELECT id, model_name FROM image_prediction WHERE id NOT IN (SELECT image_prediction_id FROM logo)")
def _(d):
    return J.predictions_without_logo(d.image_prediction, d.logo).select("id", "model_name")


@query("exclude_voted", "SELECT id, type FROM insight i WHERE NOT EXISTS (SELECT 1 FROM vote v WHERE v.insight_id = i.id AND v.device_id = 'd7')")
def _(d):
    return J.exclude_voted(d.insight, d.vote, "device_id", "d7").select("id", "type")


@query("missing_images", """
SELECT p.code AS barcode, p.image_id, p.code IS NOT NULL AS listed FROM product_image p WHERE NOT EXISTS (SELECT 1 FROM image i WHERE i.barcode = p.code AND i.image_id = p.image_id AND i.id % 4 <> 0)
""")
def _(d):
    out = J.missing_images(d.product, d.image.where("id % 4 <> 0"))
    return out.select("barcode", "image_id", F.col("source_image").isNotNull().alias("listed"))


@query("unseen_detections", """
SELECT DISTINCT l.l_orderkey AS image_pk FROM logo l JOIN image i ON l.l_orderkey = i.id WHERE NOT EXISTS (SELECT 1 FROM image_prediction p WHERE p.image_id = l.l_orderkey AND p.model_name = 'nutriscore')
""")
def _(d):
    return J.unseen_detections(detections(d), d.image, d.image_prediction, "nutriscore").select("image_pk")


@query("uncategorised_products", "SELECT code FROM product WHERE code NOT IN (SELECT barcode FROM prediction WHERE type = 'category')")
def _(d):
    return J.uncategorised_products(d.product.unionByName(d.product), d.prediction).select("code")


@query("unindexed_vectors", "SELECT vec_id AS logo_id FROM embeddings WHERE vec_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(d):
    emb = d.embeddings.select(F.col("vec_id").alias("logo_id"))
    return J.unindexed_vectors(emb, d.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("logo_id")))


@query("with_image_exists", """
SELECT i.id, CASE WHEN i.type IN ('brand', 'category') AND i.annotation IS NULL THEN EXISTS (SELECT 1 FROM image m WHERE m.barcode = i.barcode AND m.server_type = i.server_type AND NOT m.deleted)
  WHEN i.type IN ('brand', 'category') THEN i.with_image ELSE i.source_image IS NOT NULL END AS with_image FROM insight i
""")
def _(d):
    return J.with_image_exists(d.insight, d.image).select("id", "with_image")


@query("product_enrich", """
SELECT i.id, array_to_string(p.countries_tags, ',') AS countries, array_to_string(p.brands_tags, ',') AS brands, p.unique_scans_n,
  CASE WHEN i.type IN ('label', 'category') THEN len(p.image_ids) > 0 ELSE i.source_image IS NOT NULL END AS with_image
FROM insight i LEFT JOIN product p ON i.barcode = p.code
""")
def _(d):
    return J.product_enrich(d.insight, d.product).select("id", joined("countries"), joined("brands"), "unique_scans_n", "with_image")


def brand_prefixes(d: Data) -> DataFrame:
    return A.brand_prefix_counts(d.product, 2).select("brand_tag", "prefix")


def brand_blacklist(d: Data) -> DataFrame:
    return d.part.where("p_partkey % 40 = 3").select(F.concat(F.lit("brand-"), (F.col("p_partkey") % 25).cast("string")).alias("brand_tag")).distinct()


PREFIXES = """
prefixes AS (SELECT brand_tag, substring(code, 1, 7) || 'xxxxxx' AS prefix, count(*) AS n FROM (SELECT DISTINCT code, unnest(brands_tags) AS brand_tag FROM product WHERE length(code) = 13) GROUP BY 1, 2 HAVING count(*) >= 2),
banned AS (SELECT DISTINCT 'brand-' || cast(p_partkey % 25 AS string) AS brand_tag FROM part WHERE p_partkey % 40 = 3)
"""


@query("brand_range_join", f"""
WITH {PREFIXES}
SELECT p.id, NOT coalesce(p.predictor IN ('taxonomy', 'curated-list'), false) OR (NOT EXISTS (SELECT 1 FROM banned b WHERE b.brand_tag = p.value_tag)
  AND (length(p.barcode) <> 13 OR EXISTS (SELECT 1 FROM prefixes x WHERE x.brand_tag = p.value_tag AND x.prefix = substring(p.barcode, 1, 7) || 'xxxxxx'))) AS brand_allowed
FROM prediction p WHERE p.type = 'brand'
""")
def _(d):
    return J.brand_range_join(d.prediction.where("type = 'brand'"), brand_prefixes(d), brand_blacklist(d)).select("id", "brand_allowed")


@query("refresh_catalog", f"""
WITH {PREFIXES},
r AS (SELECT i.*, p.code AS known, p.image_ids, p.countries_tags, p.brands_tags, p.unique_scans_n AS new_scans,
  NOT coalesce(i.predictor IN ('taxonomy', 'curated-list'), false) OR (NOT EXISTS (SELECT 1 FROM banned b WHERE b.brand_tag = i.value_tag)
  AND (length(i.barcode) <> 13 OR EXISTS (SELECT 1 FROM prefixes x WHERE x.brand_tag = i.value_tag AND x.prefix = substring(i.barcode, 1, 7) || 'xxxxxx'))) AS allowed
  FROM insight i LEFT JOIN (SELECT * FROM product WHERE c_custkey % 17 <> 0) p ON i.barcode = p.code WHERE i.annotation IS NULL)
SELECT id, CASE WHEN created_at <= TIMESTAMP '1998-01-01' AND known IS NULL THEN 'delete' WHEN type = 'brand' AND NOT allowed THEN 'delete'
  WHEN created_at <= TIMESTAMP '1998-01-01' AND source_image IS NOT NULL AND NOT list_contains(image_ids, regexp_extract(source_image, '([0-9]+)[.]jpg$', 1)) THEN 'delete'
  WHEN created_at <= TIMESTAMP '1998-01-01' AND (brands IS DISTINCT FROM brands_tags OR countries IS DISTINCT FROM countries_tags OR unique_scans_n IS DISTINCT FROM new_scans) THEN 'update' ELSE 'keep' END AS action
FROM r
""")
def _(d):
    out = J.refresh_catalog(stamped(d.insight), d.product.where("c_custkey % 17 <> 0"), brand_prefixes(d), brand_blacklist(d), "1998-01-01")
    return out.select("id", "action")


def neighbors(d: Data) -> DataFrame:
    """Neighbour rows (logo, neighbour, distance) from line items of one order."""
    a = d.logo.select(F.col("id").alias("logo_id"), "l_orderkey", "idx")
    b = d.logo.select(F.col("id").alias("neighbor_id"), "l_orderkey", F.col("idx").alias("j"), "l_suppkey")
    return a.join(b, "l_orderkey").where("logo_id <> neighbor_id").select("logo_id", "neighbor_id", ((F.col("l_suppkey") % 7) / 10).alias("distance"))


NEIGHBORS = """
nb AS (SELECT a.id AS logo_id, b.id AS neighbor_id, cast(b.l_suppkey % 7 AS double) / 10 AS distance FROM logo a JOIN logo b ON a.l_orderkey = b.l_orderkey WHERE a.id <> b.id),
lab AS (SELECT n.logo_id, n.neighbor_id, n.distance,
  CASE WHEN l.annotation_type IS NULL OR (l.annotation_value IS NOT NULL AND l.taxonomy_value IS NULL) THEN 'UNKNOWN' ELSE l.annotation_type END AS label_type,
  CASE WHEN l.annotation_type IS NOT NULL AND l.annotation_value IS NOT NULL THEN l.taxonomy_value END AS label_value
  FROM nb n LEFT JOIN logo l ON n.neighbor_id = l.id)
"""


@query("annotation_neighbors_join", f"WITH {NEIGHBORS} SELECT logo_id, neighbor_id, label_type, label_value FROM lab")
def _(d):
    return J.annotation_neighbors_join(neighbors(d), d.logo).select("logo_id", "neighbor_id", "label_type", "label_value")


@query("threshold_join", """
SELECT l.id, coalesce(t.threshold, 0.2) AS threshold FROM logo l LEFT JOIN (
  SELECT 'brand' AS type, 'en:value-' || cast(s_suppkey % 20 AS string) AS value, max(cast(s_suppkey % 9 AS double)) / 10 AS threshold FROM supplier WHERE s_suppkey % 20 < 10 GROUP BY 1, 2) t
ON l.annotation_type IS NOT DISTINCT FROM t.type AND l.taxonomy_value IS NOT DISTINCT FROM t.value
""")
def _(d):
    thresholds = d.supplier.where("s_suppkey % 20 < 10").groupBy(F.concat(F.lit("en:value-"), (F.col("s_suppkey") % 20).cast("string")).alias("value")).agg(
        (F.max((F.col("s_suppkey") % 9).cast("double")) / 10).alias("threshold")).withColumn("type", F.lit("brand"))
    rows = d.logo.select("id", F.col("annotation_type").alias("label_type"), F.col("taxonomy_value").alias("label_value"))
    return J.threshold_join(rows, thresholds).select("id", "threshold")


@query("box_containment_join", """
SELECT l.id AS logo_id, string_agg(w.p_name, ' ' ORDER BY w.wid) AS text FROM logo l JOIN (
  SELECT l_orderkey, l_partkey % 100 AS y, l_suppkey % 90 AS x, id AS wid, 'w' || cast(l_partkey AS string) AS p_name FROM logo) w ON l.l_orderkey = w.l_orderkey
WHERE w.y >= l.idx * 10 AND w.x >= 10 AND w.y + 5 <= l.idx * 10 + 60 AND w.x + 5 <= 80 GROUP BY l.id
""")
def _(d):
    y, x = F.col("l_partkey") % 100, F.col("l_suppkey") % 90
    words = d.logo.select("source_image", F.col("id").alias("word_idx"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), boxes.box(y, x, y + 5, x + 5).alias("bbox"))
    logos = d.logo.select("id", "source_image", boxes.box(F.col("idx") * 10, F.lit(10), F.col("idx") * 10 + 60, F.lit(80)).alias("bounding_box"))
    return J.box_containment_join(words, logos, cell=20)


@query("nearby_match_join", """
SELECT doc_id, CASE WHEN doc_id % 24 = 7 THEN 'paris' ELSE 'paris' END AS city, '75001' AS postal_code FROM ocr_text WHERE doc_id % 12 = 7
UNION ALL SELECT doc_id, 'lyon', '69001' FROM ocr_text WHERE doc_id % 12 = 7
""")
def _(d):
    from larder.operators.text_match import regex_extract

    hits = regex_extract(d.ocr_text, [("paris", "full", r"\bparis\b", []), ("lyon", "full", r"\blyon\b", [])])
    hits = hits.withColumn("postal_code", F.when(F.col("name") == "paris", "75001").otherwise("69001"))
    return J.nearby_match_join(hits, d.ocr_text).select("doc_id", F.col("name").alias("city"), "postal_code")


@query("iou_self_join", """
WITH b AS (SELECT id, source_image, (l_partkey % 50) / 100e0 AS y, (l_suppkey % 50) / 100e0 AS x, 0.3e0 + (l_partkey % 3) / 10e0 AS s FROM logo),
p AS (SELECT a.id AS i, c.id AS j, greatest(0e0, least(a.y + a.s, c.y + c.s) - greatest(a.y, c.y)) * greatest(0e0, least(a.x + a.s, c.x + c.s) - greatest(a.x, c.x)) AS inter, a.s AS sa, c.s AS sc
  FROM b a JOIN b c ON a.source_image = c.source_image AND a.id < c.id)
SELECT i, j FROM p WHERE inter / (sa * sa + sc * sc - inter) >= 0.3
""")
def _(d):
    y, x, s = (F.col("l_partkey") % 50) / 100, (F.col("l_suppkey") % 50) / 100, F.lit(0.3) + (F.col("l_partkey") % 3) / 10
    rows = d.logo.select("source_image", F.col("id").alias("index"), boxes.box(y, x, y + s, x + s).alias("bounding_box"))
    return J.iou_self_join(rows, 0.3).select("i", "j")


# --- aggregates ---------------------------------------------------------------

METRICS = "type, annotation, automatic_processing, predictor, reserved_barcode, server_type"


@query("insight_metrics", f"SELECT {METRICS}, count(*) AS count, round(count(*) / cast(sum(count(*)) OVER () AS double), 9) AS percent FROM insight GROUP BY {METRICS}")
def _(d):
    return A.insight_metrics(d.insight).withColumn("percent", F.round("percent", 9))


@query("facet_metrics", """
WITH p AS (SELECT code, unnest(list_distinct(countries_tags)) AS country, categories_tags, brands_tags FROM product),
t AS (SELECT country, count(*) AS total FROM p GROUP BY country),
f AS (SELECT country, 'categories' AS facet, unnest(list_distinct(categories_tags)) AS tag_id FROM p UNION ALL SELECT country, 'brands', unnest(list_distinct(brands_tags)) FROM p)
SELECT f.country, facet, tag_id, count(*) AS products, round(count(*) * 100 / cast(any_value(t.total) AS double), 6) AS percent FROM f JOIN t ON f.country = t.country GROUP BY f.country, facet, tag_id
""")
def _(d):
    return A.facet_metrics(d.product, {"categories": "categories_tags", "brands": "brands_tags"}).withColumn("percent", F.round("percent", 6))


@query("unanswered_by_value", "SELECT value_tag, count(*) AS count FROM insight WHERE server_type = 'off' AND annotation IS NULL AND type = 'label' GROUP BY value_tag")
def _(d):
    return A.unanswered_by_value(P.insight_filter(d.insight, types=["label"]))


@query("vote_tally", "SELECT insight_id, value, count(*) AS num_votes FROM vote WHERE value <> -1 GROUP BY insight_id, value")
def _(d):
    return A.vote_tally(d.vote)


@query("duplicate_groups", "SELECT source_image, count(*) AS count FROM logo GROUP BY source_image HAVING count(*) > 1")
def _(d):
    return A.duplicate_groups(d.logo)


@query("brand_prefix_counts", """
SELECT brand_tag, substring(code, 1, 7) || 'xxxxxx' AS prefix, count(*) AS count FROM (SELECT code, unnest(list_distinct(brands_tags)) AS brand_tag FROM product WHERE length(code) = 13)
GROUP BY 1, 2 HAVING count(*) >= 2
""")
def _(d):
    return A.brand_prefix_counts(d.product, 2)


@query("brand_list", """
SELECT 'brand-' || cast(p_partkey AS string) AS brand_tag, p_name AS name FROM part WHERE p_partkey < 1000000 AND length(p_name) >= 8 AND NOT regexp_matches(p_name, '^[0-9]+$')
  AND 'brand-' || cast(p_partkey AS string) IN (SELECT b FROM (SELECT unnest(brands_tags) AS b FROM product) GROUP BY b HAVING count(*) >= 5) AND p_partkey % 25 <> 4
""")
def _(d):
    nodes = d.part.select(F.concat(F.lit("en:brand-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    counts = d.product.select(F.explode("brands_tags").alias("brand_tag")).groupBy("brand_tag").agg(F.count(F.lit(1)).alias("products"))
    banned = d.part.where("p_partkey % 25 = 4").select(F.concat(F.lit("brand-"), F.col("p_partkey").cast("string")).alias("brand_tag"))
    return A.brand_list(nodes, counts, banned, 5, 8)


CLOSURE = """
RECURSIVE up(ancestor, descendant) AS (SELECT parent, child FROM edge UNION SELECT e.parent, u.descendant FROM up u JOIN edge e ON e.child = u.ancestor)
"""


@query("generic_categories", f"""
WITH {CLOSURE},
own AS (SELECT DISTINCT code, unnest(categories_tags) AS category FROM product),
closed AS (SELECT code, category, max(covered) AS covered FROM (SELECT code, category, 0 AS covered FROM own UNION ALL SELECT o.code, u.ancestor, 1 FROM own o JOIN up u ON o.category = u.descendant) GROUP BY 1, 2)
SELECT category, count(*) AS total, sum(covered)::BIGINT AS not_deepest, round(sum(covered) / cast(count(*) AS double), 9) AS share FROM closed GROUP BY category
HAVING count(*) >= 20 AND sum(covered) / cast(count(*) AS double) >= 0.8
""")
def _(d):
    return A.generic_categories(d.product, closure(d, d.product_base.select("categories_tags")), 20, 0.8).withColumn("share", F.round("share", 9))


def closure(d: Data, *tags: DataFrame) -> DataFrame:
    """The closure, or the part of it above some tags: each a frame of one column, single or in arrays."""
    from larder.operators.taxonomy import closure_of, taxonomy_closure

    if not tags:
        return taxonomy_closure(d.edge)
    flat = [t.select((F.explode(t.columns[0]) if t.dtypes[0][1].startswith("array") else F.col(t.columns[0])).alias("value_tag")).distinct() for t in tags]
    return closure_of(d.edge, reduce(DataFrame.unionByName, flat))


@query("product_languages", """
WITH w AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'fr' ELSE lang END AS lang, len(string_split(text, ' ')) AS n, source FROM ocr_text),
s AS (SELECT source AS barcode, lang, sum(n) AS count FROM w GROUP BY 1, 2), t AS (SELECT source AS barcode, sum(n) AS words FROM w GROUP BY 1)
SELECT s.barcode, s.lang, s.count::BIGINT AS count, t.words::BIGINT AS words, round(s.count * 100 / cast(t.words AS double), 6) AS percent FROM s JOIN t ON s.barcode = t.barcode
""")
def _(d):
    n = F.size(F.split("text", " ")).cast("long")
    lang = F.when(F.col("doc_id") % 4 == 0, "fr").otherwise(F.col("lang"))
    rows = d.ocr_text.select(F.col("source").alias("barcode"), F.create_map(lang, n, F.lit("words"), n).alias("counts"))
    return A.product_languages(rows).withColumn("percent", F.round("percent", 6))


@query("image_language_share", """
SELECT doc_id, round(n_chars % 7 * 100 / cast(n_chars % 7 + n_chars % 5 + 1 AS double), 6) AS fr, round((n_chars % 5 + 1) * 100 / cast(n_chars % 7 + n_chars % 5 + 1 AS double), 6) AS en FROM documents
""")
def _(d):
    a, b = F.col("n_chars") % 7, F.col("n_chars") % 5 + 1
    share = A.image_language_share(F.create_map(F.lit("fr"), a, F.lit("en"), b, F.lit("words"), a + b))
    return d.documents.select("doc_id", F.round(share["fr"], 6).alias("fr"), F.round(share["en"], 6).alias("en"))


ORIENTATION = "CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'left' WHEN 2 THEN 'down' WHEN 3 THEN 'right' ELSE 'up' END"


def words(d: Data) -> DataFrame:
    """OCR words (one per line item) with orientation and language."""
    return d.logo.select("source_image", F.col("id").alias("word_idx"), F.expr(ORIENTATION).alias("orientation"), F.expr("CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'fr' ELSE 'en' END").alias("lang"))


@query("orientation_mode", f"""
WITH c AS (SELECT source_image, {ORIENTATION} AS o, count(*) AS n FROM logo GROUP BY 1, 2),
r AS (SELECT source_image, o, n, row_number() OVER (PARTITION BY source_image ORDER BY n DESC, o DESC) AS rn FROM c WHERE o IS NOT NULL)
SELECT s.source_image, coalesce(r.o, 'unknown') AS orientation, coalesce(r.n, 0) AS n FROM (SELECT DISTINCT source_image FROM logo) s LEFT JOIN r ON s.source_image = r.source_image AND r.rn = 1
""")
def _(d):
    out = A.orientation_mode(words(d))
    return out.select("source_image", "orientation", F.coalesce(F.try_element_at("count", F.col("orientation")), F.lit(0)).cast("long").alias("n"))


@query("user_statistics", "SELECT username, count(*) AS count FROM insight WHERE annotation IS NOT NULL GROUP BY username")
def _(d):
    return A.user_statistics(d.insight)


def kept_up(d: Data, name: str, rows: DataFrame, keys: list[str], distinct: list[str], k: int) -> S.RunningTable:
    """A running table fed year by year, older years folded."""
    table = S.RunningTable(d.spark, scratch(d, name), keys, distinct, k)
    years = sorted(r[0] for r in rows.select(F.coalesce(F.year("created_at"), F.lit(0))).distinct().collect())  # a row a year
    for nth, year in enumerate(years):
        table.add(rows.where(F.coalesce(F.year("created_at"), F.lit(0)) == year), str(year))
        if nth == len(years) // 2:
            table.fold()
    return table


def smallest_hashes_sql(rows: str, keys: str, value: str, k: int) -> str:
    return f"""h AS (SELECT DISTINCT {keys}, CAST('0x' || substr(md5({value}), 1, 15) AS BIGINT) AS hash FROM {rows} WHERE {value} IS NOT NULL),
s AS (SELECT {keys}, count(*) AS kept, max(hash) AS largest FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY hash) AS r FROM h) WHERE r <= {k} GROUP BY {keys}),
e AS (SELECT {keys}, CASE WHEN kept < {k} THEN kept ELSE CAST(round(cast({k - 1} AS double) * 1152921504606846976.0::double / (cast(largest AS double) + 1)) AS BIGINT) END AS n FROM s)"""


@query("user_statistics_running", f"""
WITH a AS (SELECT username, barcode FROM insight WHERE annotation IS NOT NULL), {smallest_hashes_sql('a', 'username', 'barcode', 256)},
c AS (SELECT username, count(*) AS count FROM a GROUP BY username)
SELECT c.username, count, coalesce(n, 0) AS n_barcode FROM c LEFT JOIN e ON c.username IS NOT DISTINCT FROM e.username
""")
def _(d):
    """Annotations and products of each user, from states of years."""
    rows = d.insight.where("annotation IS NOT NULL")
    return kept_up(d, "users", rows, ["username"], ["barcode"], 256).read()


@query("distinct_barcodes_running", f"""
WITH a AS (SELECT type, barcode FROM insight), {smallest_hashes_sql('a', 'type', 'barcode', 1024)},
c AS (SELECT type, count(*) AS count FROM a GROUP BY type)
SELECT c.type, count, coalesce(n, 0) AS n_barcode FROM c LEFT JOIN e ON c.type IS NOT DISTINCT FROM e.type
""")
def _(d):
    """Products of each insight type, from states of years; a type holds far more than k products."""
    return kept_up(d, "barcodes", d.insight, ["type"], ["barcode"], 1024).read()


@query("insight_metrics_running", f"SELECT {METRICS}, count(*) AS count, round(count(*) / cast(sum(count(*)) OVER () AS double), 9) AS percent FROM insight GROUP BY {METRICS}")
def _(d):
    """The metrics of all insights, from states of years: equal to one pass."""
    return A.shares(kept_up(d, "metrics", d.insight, A.METRIC_TAGS, [], 16).read()).withColumn("percent", F.round("percent", 9))


@query("bounded_count", "SELECT least(count(*), 100) AS count FROM insight WHERE annotation IS NULL")
def _(d):
    return A.bounded_count(d.insight.where("annotation IS NULL"), 100)


@query("distinct_barcodes", "SELECT DISTINCT barcode FROM prediction WHERE type = 'label'")
def _(d):
    return A.distinct_barcodes(d.prediction, "label")


@query("minmax_bounds", "SELECT min(id) AS min_value, max(id) AS max_value FROM prediction")
def _(d):
    return A.minmax_bounds(d.prediction, "id")


@query("max_confidence", "SELECT l_orderkey AS image, max(score) AS best FROM logo GROUP BY l_orderkey")
def _(d):
    return detections(d).select(F.col("image_id").cast("long").alias("image"), P.max_confidence(F.col("result")).alias("best"))


@query("value_conflict_flag", "SELECT barcode, server_type, matcher_type, count(DISTINCT value) > 1 AS conflict FROM prediction WHERE type = 'product_weight' GROUP BY 1, 2, 3")
def _(d):
    return A.value_conflict_flag(d.prediction.where("type = 'product_weight'"))


@query("nutrient_per_mode", """
SELECT o_custkey, CASE WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) > sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) THEN '100g'
  WHEN sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) < sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) THEN 'serving'
  WHEN arg_min(o_orderstatus, o_orderkey) = 'F' THEN '100g' ELSE 'serving' END AS per FROM orders GROUP BY o_custkey
""")
def _(d):
    from larder.functions.measures import nutrient_per_mode

    key = F.concat(F.lit("n"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "_100g").otherwise("_serving"))
    keys = d.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", key.alias("k")))), lambda x: x["k"]).alias("keys"))
    return keys.select("o_custkey", nutrient_per_mode(F.col("keys")).alias("per"))


@query("union_box", """
SELECT l_orderkey AS image, cast(min(l_partkey % 100) - 10 AS double) AS y_min, cast(min(l_suppkey % 90) - 10 AS double) AS x_min, cast(max(l_partkey % 100 + 5) + 10 AS double) AS y_max, cast(max(l_suppkey % 90 + 5) + 10 AS double) AS x_max
FROM logo GROUP BY l_orderkey
""")
def _(d):
    y, x = F.col("l_partkey") % 100, F.col("l_suppkey") % 90
    rows = d.logo.groupBy("l_orderkey").agg(F.collect_list(boxes.box(y, x, y + 5, x + 5)).alias("b"))
    u = boxes.union_box(F.col("b"), 10)
    return rows.select(F.col("l_orderkey").alias("image"), *[u[i].alias(n) for i, n in enumerate(("y_min", "x_min", "y_max", "x_max"))])


# --- order, windows, top-k ----------------------------------------------------

IMAGE_RANK = "coalesce(TRY_CAST(regexp_extract(coalesce(source_image, ''), '([0-9]+)[.]jpg$', 1) AS BIGINT), 0)"


@query("rank_predictions", f"""
SELECT id, row_number() OVER (PARTITION BY barcode, server_type, type ORDER BY priority, -{IMAGE_RANK}, coalesce(predictor, 'z'), id) AS rank FROM prediction
""")
def _(d):
    return R.rank_predictions(d.prediction).select("id", F.col("rank").cast("long").alias("rank"))


@query("rank_candidates", f"""
SELECT id, row_number() OVER (PARTITION BY barcode, server_type, type ORDER BY priority, -{IMAGE_RANK}, CASE WHEN automatic_processing THEN 0 ELSE 1 END, coalesce(predictor, 'z'), id) AS rank FROM prediction
""")
def _(d):
    return R.rank_candidates(d.prediction).select("id", F.col("rank").cast("long").alias("rank"))


@query("rank_packaging", "SELECT id, row_number() OVER (PARTITION BY barcode ORDER BY l_orderkey % 4 DESC, id) AS rank FROM prediction WHERE type = 'store'")
def _(d):
    rows = d.prediction.where("type = 'store'").withColumn("n_properties", F.col("l_orderkey") % 4)
    return R.rank_packaging(rows, ["barcode"]).select("id", F.col("rank").cast("long").alias("rank"))


@query("first_per_product", f"""
SELECT id, value FROM (SELECT id, value, row_number() OVER (PARTITION BY barcode, server_type, type ORDER BY priority, -{IMAGE_RANK}, coalesce(predictor, 'z'), id) AS rn FROM prediction WHERE type = 'product_weight') WHERE rn = 1
""")
def _(d):
    return R.first_per_product(d.prediction.where("type = 'product_weight'")).select("id", "value")


@query("latest_value", f"""
SELECT id, value, several FROM (
  SELECT id, value, row_number() OVER (PARTITION BY barcode, server_type ORDER BY value DESC NULLS LAST, priority, -{IMAGE_RANK}, coalesce(predictor, 'z'), id) AS rn,
    count(DISTINCT value) OVER (PARTITION BY barcode, server_type) > 1 AS several FROM prediction WHERE type = 'expiration_date') WHERE rn = 1
""")
def _(d):
    rows = d.prediction.where("type = 'expiration_date'").withColumn("automatic_processing", F.lit(True))
    return R.latest_value(rows).select("id", "value", (~F.col("automatic_processing")).alias("several"))


@query("order_insights", """
SELECT id, row_number() OVER (PARTITION BY type ORDER BY confidence DESC NULLS LAST, id) AS place FROM insight
""")
def _(d):
    """The order of all rows, told by each row's place within its type."""
    from pyspark.sql.window import Window

    ordered = R.order_insights(d.insight, "confidence").select("id", "type", F.monotonically_increasing_id().alias("at"))
    return ordered.select("id", F.row_number().over(Window.partitionBy("type").orderBy("at")).cast("long").alias("place"))


@query("rank_question_types", "SELECT id, CASE type WHEN 'category' THEN 0 WHEN 'label' THEN 1 WHEN 'brand' THEN 2 ELSE 3 END AS type_rank FROM insight")
def _(d):
    return R.rank_question_types(d.insight).select("id", R.question_type_rank().alias("type_rank"))


@query("page", "SELECT id FROM insight ORDER BY id LIMIT 25 OFFSET 50")
def _(d):
    return R.page(d.insight.select("id").orderBy("id"), 3, 25)


@query("recent_images_k", """
SELECT code AS barcode, string_agg(cast(o_orderkey AS string), ',' ORDER BY o_orderkey DESC) AS recent FROM (
  SELECT code, o_orderkey, row_number() OVER (PARTITION BY code ORDER BY o_orderkey DESC) AS rn FROM product_image) WHERE rn <= 10 GROUP BY code
UNION ALL SELECT code, '' FROM product WHERE len(image_ids) = 0
""")
def _(d):
    return R.recent_images_k(d.product).select("barcode", F.array_join("recent_ids", ",").alias("recent"))


@query("oldest_of_duplicates", "SELECT id FROM logo l WHERE id <> (SELECT min(id) FROM logo m WHERE m.source_image = l.source_image)")
def _(d):
    return R.oldest_of_duplicates(d.logo, ["source_image"]).select("id")


@query("newest_images_first", "SELECT id FROM image ORDER BY uploaded_at DESC, id DESC LIMIT 200")
def _(d):
    return R.newest_images_first(d.image, 200).select("id")


@query("keyset_batches", "SELECT id FROM prediction")
def _(d):
    return R.keyset_batches(d.prediction.select("id"), "id", 8)


@query("random_sample_one", "SELECT 1 AS n, 1 AS known")
def _(d):
    """One row is drawn, and it is a logo with an embedding."""
    emb = d.embeddings.select(F.col("vec_id").alias("logo_id"))
    drawn = R.random_sample_one(emb, d.orders.select(F.col("o_orderkey").alias("id")), 0.2, 7)
    known = drawn.join(emb.join(d.orders, F.col("logo_id") == F.col("o_orderkey"), "left_semi"), "logo_id", "left_semi").select("logo_id", F.lit(1).alias("k"))
    return drawn.join(known, "logo_id", "left").agg(F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("known"))


@query("shuffle_order", "SELECT id FROM logo WHERE annotation_type = 'brand'")
def _(d):
    return R.shuffle_order(d.logo.where("annotation_type = 'brand'").select("id"), 11)


def spell_products(d: Data) -> DataFrame:
    """Catalogue rows with list texts and unknown-ingredient counts."""
    texts = F.array(F.struct(F.lit("fr").alias("lang"), F.lit("autre").alias("text")), F.struct(F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("main").alias("lang"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("texte "), "o_orderpriority")).alias("text")))
    return d.orders.select(
        F.col("o_orderkey").cast("string").alias("code"), F.lit("fr").alias("lang"), texts.alias("ingredients_text"), (F.col("o_orderkey") % 12).alias("ingredients_n"),
        (F.col("o_orderkey") % 4).alias("unknown_ingredients_n"), F.floor("o_totalprice").alias("popularity_key"),
    )


@query("top_batch_extract", """
SELECT cast(o_orderkey AS string) AS code, 'texte ' || o_orderpriority AS text, 'fr' AS lang, round((o_orderkey % 4) / cast(o_orderkey % 12 AS double), 9) AS fraction FROM orders
WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 12 <> 0 AND (o_orderkey % 4) / cast(o_orderkey % 12 AS double) > 0 AND (o_orderkey % 4) / cast(o_orderkey % 12 AS double) <= 0.4
""")
def _(d):
    return R.top_batch_extract(spell_products(d), None).withColumn("fraction", F.round("fraction", 9))


# --- set operations -----------------------------------------------------------


@query("union_predictions", "SELECT type, count(*) AS n FROM prediction WHERE type IN ('label', 'brand', 'store') GROUP BY type")
def _(d):
    parts = [d.prediction.where(F.col("type") == t).drop(*(["value"] if t == "label" else [])) for t in ("label", "brand", "store")]
    return D.union_predictions(parts).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("intersect_types", "SELECT id, type FROM insight WHERE type IN ('label', 'brand')")
def _(d):
    return d.insight.where(F.col("type").isin(D.intersect_types(["brand", "label", "store", "none"]))).select("id", "type")


@query("required_types_superset", "SELECT barcode, server_type FROM prediction WHERE type IN ('label', 'brand', 'store') GROUP BY 1, 2 HAVING count(DISTINCT type) = 3")
def _(d):
    return D.required_types_superset(d.prediction, ["label", "brand", "store"])


@query("ordered_distinct", """
SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY f) AS seen FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) GROUP BY o_custkey
""")
def _(d):
    rows = d.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("s"))
    return rows.select("o_custkey", F.array_join(D.ordered_distinct(F.col("s")), ",").alias("seen"))


@query("dedupe_images", """
WITH i AS (SELECT id, barcode, server_type, width % 50 AS src FROM image), g AS (SELECT id FROM i WHERE id <> (SELECT min(id) FROM i j WHERE j.barcode = i.barcode AND j.src = i.src AND j.server_type = i.server_type))
SELECT 'image' AS tbl, id FROM g UNION ALL SELECT 'image_prediction', id FROM image_prediction WHERE image_id IN (SELECT id FROM g)
UNION ALL SELECT 'logo_annotation', id FROM logo WHERE image_prediction_id IN (SELECT id FROM image_prediction WHERE image_id IN (SELECT id FROM g))
""")
def _(d):
    images = d.image.withColumn("source_image", F.concat_ws("/", "barcode", (F.col("width") % 50).cast("string")))
    out = D.dedupe_images(images, d.image_prediction, d.logo)
    parts = [df.select(F.lit(t).alias("tbl"), "id") for t, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
