"""Role views: the test tables in catalogue shape (shared SQL dialect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.plans.registry import Data, role


def code_of(key: str) -> str:
    """Barcode of a customer key: thirteen digits, some reserved, some eight digits."""
    return (
        f"(CASE WHEN {key} % 10 = 0 THEN lpad(cast(200000000000 + {key} * 40009 AS string), 13, '0') "
        f"WHEN {key} % 10 = 1 THEN cast(20000000 + {key} AS string) ELSE cast(3000000000000 + {key} * 40009 AS string) END)"
    )


def server_of(key: str) -> str:
    return f"(CASE WHEN {key} % 13 = 0 THEN 'obf' ELSE 'off' END)"


FOLDER = (
    "(CASE WHEN length(barcode) > 8 THEN '/' || substring(barcode, 1, 3) || '/' || substring(barcode, 4, 3) || '/' || substring(barcode, 7, 3) "
    "|| '/' || substring(barcode, 10, 100) ELSE '/' || barcode END || '/')"
)


def path_of(image: str) -> str:
    return f"(folder || {image} || '.jpg')"


def half(key: str, by: int = 2) -> str:
    return f"cast(floor({key} / {by}) AS bigint)"


NO_TAGS = "cast(array() AS array<string>)"

# orders with the barcode, project and image folder of their customer, each computed once
role("order_code", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, {code_of('o_custkey')} AS barcode, {server_of('o_custkey')} AS server_type FROM orders
""")

role("order_place", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, barcode, server_type, {FOLDER} AS folder FROM order_code
""")

role("product_image", f"""
SELECT {code_of('o_custkey')} AS code, cast(o_orderkey AS string) AS image_id, o_orderkey FROM orders
""")

role("image_list", """
SELECT code, array_sort(array_agg(image_id)) AS image_ids FROM product_image GROUP BY code
""")

role("product_base", f"""
SELECT c_custkey, {code_of('c_custkey')} AS code, {server_of('c_custkey')} AS server_type,
  CASE c_custkey % 3 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' ELSE 'de' END AS lang,
  CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN NULL ELSE c_name END AS product_name,
  array('en:c' || cast(c_nationkey AS string), 'en:r' || cast(c_nationkey % 5 AS string)) AS countries_tags,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN {NO_TAGS}
    ELSE array('en:n' || cast(1 + c_custkey % 60 AS string), 'en:n' || cast(1 + (c_custkey * 3) % 190 AS string)) END AS categories_tags,
  CASE WHEN c_custkey % 3 = 0 THEN {NO_TAGS} ELSE array('en:n' || cast(1 + (c_custkey * 7) % 190 AS string)) END AS labels_tags,
  CASE WHEN c_custkey % 2 = 0 THEN array('brand-' || cast(c_custkey % 25 AS string), lower(c_mktsegment)) ELSE {NO_TAGS} END AS brands_tags,
  CASE WHEN c_custkey % 2 = 0 THEN array('v' || cast(c_custkey % 5 AS string)) ELSE {NO_TAGS} END AS stores_tags,
  CASE WHEN c_custkey % 5 < 3 THEN array('FR 40.' || cast(100 + c_custkey % 9 AS string) || '.001 CE') ELSE {NO_TAGS} END AS emb_codes_tags,
  array('state-' || cast(c_custkey % 6 AS string)) AS states_tags,
  CASE WHEN c_custkey % 3 = 0 THEN '250 g' END AS quantity,
  CASE WHEN c_custkey % 7 = 0 THEN '2020-01-01' END AS expiration_date,
  cast(floor(abs(c_acctbal)) AS int) AS unique_scans_n,
  cast(1600000000 + c_custkey * 1000 AS bigint) AS last_modified_t,
  CASE WHEN c_custkey % 8 = 0 THEN 999 ELSE 1003 END AS schema_version, c_acctbal, c_mktsegment
FROM customer
""")

role("product", f"""
SELECT b.*, coalesce(l.image_ids, {NO_TAGS}) AS image_ids FROM product_base b LEFT JOIN image_list l ON b.code = l.code
""".replace("b.*", ", ".join("b." + c for c in (
    "c_custkey code server_type lang product_name countries_tags categories_tags labels_tags brands_tags stores_tags "
    "emb_codes_tags states_tags quantity expiration_date unique_scans_n last_modified_t schema_version").split())))

# image metadata rows: raw images and up to four selected ones per product
role("image_meta", f"""
SELECT {code_of('o_custkey')} AS code, cast(o_orderkey AS string) AS img_key, cast(NULL AS string) AS imgid, cast(NULL AS string) AS rev,
  cast(NULL AS string) AS angle, cast(1500000000 + o_orderkey * 1000 AS string) AS uploaded_t,
  cast(400 + o_orderkey % 800 AS int) AS w, cast(300 + o_orderkey % 700 AS int) AS h FROM orders
UNION ALL
SELECT {code_of('o_custkey')}, 'front_fr', cast(min(o_orderkey) AS string), '3', '0', cast(NULL AS string), 400, 300 FROM orders WHERE o_custkey % 3 < 2 GROUP BY o_custkey
UNION ALL
SELECT {code_of('o_custkey')}, 'ingredients_fr', cast(max(o_orderkey) AS string), '5', '90', cast(NULL AS string), 400, 300 FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey
UNION ALL
SELECT {code_of('o_custkey')}, 'nutrition_en', cast(max(o_orderkey) AS string), '7', '-90', cast(NULL AS string), 400, 300 FROM orders WHERE o_custkey % 5 = 0 GROUP BY o_custkey
""")

role("image", f"""
SELECT o_orderkey AS id, barcode, cast(o_orderkey AS string) AS image_id, server_type,
  {path_of('cast(o_orderkey AS string)')} AS source_image,
  cast(400 + o_orderkey % 800 AS int) AS width, cast(300 + o_orderkey % 700 AS int) AS height, o_orderdate AS uploaded_at, o_orderkey % 17 = 0 AS deleted
FROM order_place
""")

role("insight", f"""
SELECT 'i' || lpad(cast(o_orderkey AS string), 9, '0') AS id, barcode, server_type,
  CASE o_orderkey % 6 WHEN 0 THEN 'label' WHEN 1 THEN 'category' WHEN 2 THEN 'brand' WHEN 3 THEN 'product_weight' WHEN 4 THEN 'store' ELSE 'packager_code' END AS type,
  CASE WHEN o_orderkey % 6 < 2 THEN 'en:n' || cast(1 + (o_orderkey * 7) % 190 AS string) WHEN o_orderkey % 6 = 2 THEN 'brand-' || cast(o_orderkey % 25 AS string)
    WHEN o_orderkey % 6 = 4 THEN 'v' || cast(o_orderkey % 5 AS string) END AS value_tag,
  CASE o_orderkey % 6 WHEN 2 THEN 'Brand ' || cast(o_orderkey % 25 AS string) WHEN 3 THEN cast(100 + (o_orderkey % 40) * 10 AS string) || ' g'
    WHEN 4 THEN 'V' || cast(o_orderkey % 5 AS string) WHEN 5 THEN 'FR 40.' || cast(100 + o_orderkey % 9 AS string) || '.001 EC' END AS value,
  CASE WHEN o_orderkey % 5 <> 0 THEN {path_of('cast(o_orderkey AS string)')} END AS source_image,
  CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '5-LOW' THEN NULL ELSE false END AS automatic_processing,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'flashtext' WHEN '2-HIGH' THEN 'regex' WHEN '3-MEDIUM' THEN 'taxonomy' WHEN '4-NOT SPECIFIED' THEN 'curated-list' END AS predictor,
  CASE WHEN o_orderstatus = 'F' THEN cast(o_orderkey % 3 AS int) - 1 END AS annotation,
  cast(o_orderkey % 4 AS int) AS n_votes, cast(o_orderkey % 1000 AS int) AS unique_scans_n,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS confidence, o_orderdate AS created_at,
  array('en:c' || cast(o_custkey % 25 AS string)) AS countries,
  CASE WHEN o_custkey % 2 = 0 THEN array('brand-' || cast(o_custkey % 25 AS string)) ELSE {NO_TAGS} END AS brands,
  CASE o_orderkey % 3 WHEN 0 THEN array('missing-category', 'agribalyse-category') WHEN 1 THEN array('missing-category') ELSE {NO_TAGS} END AS campaign,
  CASE WHEN o_orderkey % 2 = 0 THEN array('fr', 'en') ELSE array('de') END AS lc,
  o_custkey % 10 = 0 OR o_custkey % 10 = 1 AS reserved_barcode, o_orderkey % 8 <> 0 AS with_image,
  CASE WHEN o_orderstatus = 'F' THEN 'u' || cast(o_custkey % 50 AS string) END AS username, o_orderkey, o_custkey
FROM order_place
""")

role("prediction", f"""
SELECT ((l_orderkey * 200003 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber AS id, barcode, server_type,
  CASE l_linenumber WHEN 1 THEN 'label' WHEN 2 THEN 'category' WHEN 3 THEN 'brand' WHEN 4 THEN 'product_weight' WHEN 5 THEN 'store' WHEN 6 THEN 'packager_code' ELSE 'expiration_date' END AS type,
  CASE WHEN l_linenumber < 3 THEN 'en:n' || cast(1 + l_partkey % 190 AS string) WHEN l_linenumber = 3 THEN 'brand-' || cast(l_suppkey % 25 AS string) WHEN l_linenumber = 5 THEN 'v' || cast(l_partkey % 5 AS string) END AS value_tag,
  CASE l_linenumber WHEN 3 THEN 'Brand ' || cast(l_suppkey % 25 AS string) WHEN 4 THEN cast(100 + (l_partkey % 40) * 10 AS string) || ' g' WHEN 5 THEN 'V' || cast(l_partkey % 5 AS string)
    WHEN 6 THEN 'FR 40.' || cast(100 + l_partkey % 9 AS string) || '.001 EC' WHEN 7 THEN '2020-01-' || lpad(cast(1 + l_partkey % 28 AS string), 2, '0') END AS value,
  CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 6 = 1 THEN {path_of('cast(l_orderkey + 1 AS string)')}
    ELSE {path_of('cast(l_orderkey AS string)')} END AS source_image,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN false END AS automatic_processing,
  CASE WHEN l_linestatus = 'O' THEN 'regex' WHEN l_suppkey % 2 = 0 THEN 'taxonomy' END AS predictor,
  cast(1 + l_partkey % 2 AS string) AS predictor_version, l_discount * 10 AS confidence, l_shipdate AS created_at,
  cast(1 + l_suppkey % 3 AS int) AS priority, 'm' || cast(l_suppkey % 4 AS string) AS matcher_type, l_partkey % 9 = 0 AS from_name, l_orderkey, o_custkey
FROM lineitem JOIN order_place ON l_orderkey = o_orderkey
""")

role("vote", """
SELECT ((l_orderkey * 200003 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber AS id, 'i' || lpad(cast(l_orderkey AS string), 9, '0') AS insight_id,
  cast(cast(l_quantity AS int) % 3 AS int) - 1 AS value, 'u' || cast(l_suppkey AS string) AS username, 'd' || cast(l_partkey % 50 AS string) AS device_id FROM lineitem
""")

role("image_prediction", """
SELECT o_orderkey * 10 AS id, o_orderkey AS image_id, CASE o_orderkey % 3 WHEN 0 THEN 'logo-detector' WHEN 1 THEN 'nutrition-table' ELSE 'nutriscore' END AS model_name,
  'v' || cast(o_orderkey % 2 AS string) AS model_version, 'object_detection' AS type, cast(o_orderkey % 100 AS double) / 100 AS max_confidence, o_orderdate AS created_at
FROM orders WHERE o_orderkey % 5 <> 0
""")

role("logo", f"""
SELECT ((l_orderkey * 200003 + l_partkey) * 1009 + l_suppkey) * 8 + l_linenumber AS id, l_orderkey * 10 AS image_prediction_id, cast(l_linenumber AS int) AS idx, l_discount * 10 AS score,
  CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'brand' WHEN l_returnflag = 'R' THEN 'label' ELSE 'packager' END AS annotation_type,
  CASE WHEN l_partkey % 4 = 0 OR l_partkey % 7 = 0 THEN NULL ELSE 'Value ' || cast(l_suppkey % 20 AS string) END AS annotation_value,
  CASE WHEN l_partkey % 4 = 0 OR l_partkey % 7 = 0 THEN NULL ELSE 'value-' || cast(l_suppkey % 20 AS string) END AS annotation_value_tag,
  CASE WHEN l_partkey % 4 = 0 OR l_partkey % 7 = 0 OR l_partkey % 5 = 0 THEN NULL ELSE 'en:value-' || cast(l_suppkey % 20 AS string) END AS taxonomy_value,
  CASE WHEN l_partkey % 4 <> 0 THEN l_shipdate END AS completed_at, CASE WHEN l_partkey % 4 <> 0 THEN 'u' || cast(l_suppkey AS string) END AS username,
  barcode, server_type, {path_of('cast(l_orderkey AS string)')} AS source_image,
  l_orderkey, l_partkey, l_suppkey FROM lineitem JOIN order_place ON l_orderkey = o_orderkey
""")

role("node", """
SELECT 'en:n' || cast(p_partkey AS string) AS id, p_name || ' ' || cast(p_partkey AS string) AS name_en,
  CASE WHEN p_partkey % 2 = 0 THEN 'fr ' || p_name || ' ' || cast(p_partkey AS string) END AS name_fr, p_partkey % 3 = 0 AS agri, p_partkey FROM part WHERE p_partkey >= 1
""")

role("edge", f"""
SELECT 'en:n' || cast({half('p_partkey')} AS string) AS parent, 'en:n' || cast(p_partkey AS string) AS child FROM part WHERE p_partkey >= 2
UNION ALL
SELECT 'en:n' || cast({half('p_partkey', 3)} AS string), 'en:n' || cast(p_partkey AS string) FROM part WHERE p_partkey >= 5 AND p_partkey % 5 = 0
""")

role("synonym", """
SELECT 'fr:noeud-' || cast(p_partkey AS string) AS tag, 'en:n' || cast(p_partkey AS string) AS id FROM part WHERE p_partkey >= 1 AND p_partkey % 2 = 0
""")

# texts with product wording appended, so that every extractor has something to find
role("ocr_text", """
SELECT doc_id, lang, source, text || chr(10) || CASE doc_id % 12
  WHEN 0 THEN 'Poids net : ' || cast(n_chars % 900 + 11 AS string) || ' g et 2 x ' || cast(n_chars % 300 + 20 AS string) || ' ml'
  WHEN 1 THEN 'A consommer avant le 0' || cast(1 + doc_id % 9 AS string) || '/12/20' || cast(10 + doc_id % 20 AS string) || ' ou 15.06.19'
  WHEN 2 THEN 'EMB ' || cast(10000 + n_chars % 80000 AS string) || 'A conditionne FR 40.' || cast(100 + doc_id % 800 AS string) || '.001 CE'
  WHEN 3 THEN 'ingredients biologiques, FR-BIO-0' || cast(1 + doc_id % 9 AS string) || ' sans conservateur ' || 'NUTRI-SCORE'
  WHEN 4 THEN 'traces de ' || CASE WHEN doc_id % 2 = 0 THEN 'soja' ELSE 'lait' END || ' et sesame'
  WHEN 5 THEN 'energie: ' || cast(n_chars % 900 AS string) || ' kcal, sel ' || cast(n_chars % 9 AS string) || '.5 g proteines 3 g'
  WHEN 6 THEN 'carrefour market et auchan production'
  WHEN 7 THEN 'rendez-vous a 75001 paris ou lyon 69001'
  WHEN 8 THEN 'bouteille plastique a recycler, boite en carton'
  WHEN 9 THEN 'fumer tue, dimethicone'
  WHEN 10 THEN 'net weight ' || cast(n_chars % 3000 AS string) || ' ge'
  ELSE 'sucre de canne et coca cola light, appellation bleu de ' || cast(doc_id % 50 AS string) || ' protegee' END || ' fin.' AS text, n_chars FROM documents
""")

def product_full(d: Data) -> DataFrame:
    """``product`` with the image map (``image_meta`` rows per key)."""
    size = F.create_map(F.lit("full"), F.struct("w", "h"), F.lit("400"), F.struct(F.lit(400).alias("w"), F.lit(300).alias("h")))
    meta = F.struct(
        "imgid", "rev", "angle", "uploaded_t", *[F.lit(None).cast("string").alias(c) for c in ("x1", "y1", "x2", "y2")], size.alias("sizes")
    )
    maps = d.image_meta.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("img_key", meta.alias("m")))).alias("images"))
    out = d.product.join(maps, "code", "left")
    return out.withColumn("images", F.coalesce("images", F.create_map().cast(dict(out.dtypes)["images"])))


def defaults(df: DataFrame) -> DataFrame:
    from larder.sources.readers import product_defaults

    return product_defaults(df) if "images" in df.columns else product_defaults(df).withColumn("image_ids", F.col("image_ids"))


def with_json(predictions: DataFrame) -> DataFrame:
    """Prediction rows with the ``data`` document the engine expects."""
    source = F.when(F.col("from_name"), F.lit("product_name"))
    return predictions.withColumn("data", F.to_json(F.struct("priority", "matcher_type", source.alias("source"))))


def stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.col("created_at").cast("timestamp"))
