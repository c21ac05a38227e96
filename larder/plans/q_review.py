"""Queries: votes, annotation, outcomes, logos under review, questions and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import annotations as N
from larder.operators import questions as Q
from larder.plans.q_core import BASE_URL, scratch
from larder.plans.q_import import keys_of, image_facts
from larder.plans.registry import Data, query
from larder.plans.roles import product_full
from larder.streaming import routes, timers

TALLY = "tally AS (SELECT insight_id, value, count(*) AS n FROM vote WHERE value <> -1 GROUP BY 1, 2), "
RESOLVE = """
r AS (SELECT insight_id, sum(n) AS n_votes, max(n) AS top, CASE WHEN count(*) > 1 THEN min(n) ELSE 0 END AS second, arg_max(value, n * 10 - value) AS best FROM tally GROUP BY insight_id),
res AS (SELECT insight_id, n_votes::BIGINT AS n_votes, cast(CASE WHEN top >= 2 AND second >= 2 THEN -1 WHEN top >= 3 THEN best END AS INT) AS annotation FROM r)
"""


@query("vote_resolve", f"WITH {TALLY} {RESOLVE} SELECT insight_id, n_votes, annotation, annotation IS NOT NULL AS verified FROM res")
def _(d):
    return N.vote_resolve(d.vote)


@query("vote_requests", """
WITH q AS (SELECT 'i' || lpad(cast(c_custkey * 7 AS string), 9, '0') AS insight_id, cast(c_custkey % 3 AS INT) - 1 AS annotation, c_custkey % 2 = 0 AS trusted FROM customer),
k AS (SELECT q.*, i.id IS NOT NULL AS known, i.annotation AS stored, NOT q.trusted OR q.annotation = -1 AS is_vote FROM q LEFT JOIN insight i ON i.id = q.insight_id),
pool AS (SELECT insight_id, value FROM vote WHERE insight_id IN (SELECT insight_id FROM k WHERE is_vote AND known AND stored IS NULL) UNION ALL SELECT insight_id, annotation FROM k WHERE is_vote AND known AND stored IS NULL),
tally AS (SELECT insight_id, value, count(*) AS n FROM pool WHERE value <> -1 GROUP BY 1, 2),
""" + RESOLVE + """
SELECT k.insight_id, CASE WHEN NOT known THEN 'error_unknown_insight' WHEN stored IS NOT NULL THEN 'error_already_annotated' WHEN is_vote AND res.annotation IS NULL THEN 'vote_saved' END AS status,
  CASE WHEN known AND stored IS NULL THEN CASE WHEN is_vote THEN res.annotation ELSE k.annotation END END AS applied FROM k LEFT JOIN res ON res.insight_id = k.insight_id
""")
def _(d):
    requests = d.customer.select(F.concat(F.lit("i"), F.lpad((F.col("c_custkey") * 7).cast("string"), 9, "0")).alias("insight_id"), (F.col("c_custkey") % 3 - 1).cast("int").alias("annotation"), (F.col("c_custkey") % 2 == 0).alias("trusted"))
    return N.vote_requests(requests, d.insight, d.vote).select("insight_id", "status", "applied")


@query("due_automatic", "SELECT id FROM insight WHERE annotation IS NULL AND automatic_processing AND created_at <= TIMESTAMP '1997-06-01'")
def _(d):
    rows = d.insight.withColumn("process_after", F.when(F.col("automatic_processing"), F.col("created_at").cast("timestamp")))
    return N.due_automatic(rows, F.lit("1997-06-01").cast("timestamp")).select("id")


@query("annotation_state", """
SELECT id, CASE WHEN (a = 2) <> has_data THEN 'error_invalid_data' WHEN a IN (1, 2) AND upd THEN outcome ELSE 'saved' END AS status,
  CASE WHEN (a = 2) = has_data THEN a END AS annotation,
  CASE WHEN (a = 2) = has_data THEN CASE WHEN a IN (1, 2) AND upd THEN CASE outcome WHEN 'updated' THEN 2 WHEN 'error_missing_product' THEN 3 END ELSE 1 END END AS annotated_result
FROM (SELECT id, cast(o_orderkey % 3 AS INT) AS a, o_orderkey % 4 = 2 AS has_data, o_orderkey % 5 <> 0 AS upd, CASE o_orderkey % 7 WHEN 0 THEN 'error_already_annotated' WHEN 1 THEN 'error_missing_product' ELSE 'updated' END AS outcome FROM insight)
""")
def _(d):
    k = F.col("o_orderkey")
    rows = d.insight.select("id", (k % 3).cast("int").alias("new_annotation"), (k % 4 == 2).alias("has_data"), (k % 5 != 0).alias("update"), F.lit("u").alias("user"),
                            F.when(k % 7 == 0, "error_already_annotated").when(k % 7 == 1, "error_missing_product").otherwise("updated").alias("outcome"))
    return N.annotation_state(rows, F.lit("2024-01-01").cast("timestamp")).select("id", "status", "annotation", "annotated_result")


# --- outcomes: the catalogue lacks every 17th product --------------------------


def shop(d: Data):
    return d.product.where("c_custkey % 17 <> 0").withColumn("emb_codes", F.array_join("emb_codes_tags", ","))


def shop_full(d: Data):
    return product_full(d).where("c_custkey % 17 <> 0")


def insight_of(d: Data, type: str):
    return d.insight.where(F.col("type") == type).withColumn("data", F.lit("{}"))


def outcome_check(type: str, there: str, payload: str) -> str:
    return f"""
SELECT i.id, CASE WHEN p.code IS NULL THEN 'error_missing_product' WHEN {there} THEN 'error_already_annotated' ELSE 'updated' END AS status,
  CASE WHEN p.code IS NOT NULL AND NOT coalesce({there}, false) THEN {payload} END AS sent
FROM insight i LEFT JOIN (SELECT * FROM product WHERE c_custkey % 17 <> 0) p ON i.barcode = p.code WHERE i.type = '{type}'
"""


def sent(df, field: str):
    return df.select("id", "status", F.get_json_object("payload", f"$.{field}").alias("sent"))


NORM = "regexp_replace(regexp_replace(lower(trim({})), '[ .-]', '', 'g'), 'ce$', 'ec')"


@query("outcome_packager_code", outcome_check("packager_code", f"list_contains(list_transform(p.emb_codes_tags, lambda x: {NORM.format('x')}), {NORM.format('i.value')})", "concat_ws(',', nullif(array_to_string(p.emb_codes_tags, ','), ''), i.value)"))
def _(d):
    return sent(N.outcome_packager_code(insight_of(d, "packager_code"), shop(d)), "emb_codes")


@query("outcome_label", outcome_check("label", "list_contains(p.labels_tags, i.value_tag)", "i.value_tag"))
def _(d):
    return sent(N.outcome_label(insight_of(d, "label"), shop(d)), "add_labels")


@query("outcome_category", """
SELECT i.id, CASE WHEN p.code IS NULL THEN 'error_missing_product' WHEN list_contains(coalesce(p.categories_tags, []), tag) THEN 'error_already_annotated' WHEN u IS NOT NULL THEN 'user_input_updated' ELSE 'updated' END AS status,
  CASE WHEN p.code IS NOT NULL AND NOT list_contains(coalesce(p.categories_tags, []), tag) THEN tag END AS sent
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 1 THEN 'en:n' || cast(1 + o_custkey % 60 AS string) END AS u, coalesce(CASE WHEN o_orderkey % 4 = 1 THEN 'en:n' || cast(1 + o_custkey % 60 AS string) END, value_tag) AS tag FROM insight WHERE type = 'category') i
LEFT JOIN (SELECT * FROM product WHERE c_custkey % 17 <> 0) p ON i.barcode = p.code
""")
def _(d):
    rows = insight_of(d, "category").withColumn("user_value_tag", F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("en:n"), (1 + F.col("o_custkey") % 60).cast("string"))))
    return sent(N.outcome_category(rows, shop(d)), "add_categories")


@query("outcome_product_weight", outcome_check("product_weight", "coalesce(p.quantity, '') <> ''", "i.value"))
def _(d):
    return sent(N.outcome_product_weight(insight_of(d, "product_weight"), shop(d)), "quantity")


@query("outcome_expiration_date", outcome_check("product_weight", "coalesce(p.expiration_date, '') <> ''", "i.value"))
def _(d):
    return sent(N.outcome_expiration_date(insight_of(d, "product_weight"), shop(d)), "expiration_date")


@query("outcome_brand", outcome_check("brand", "false", "i.value"))
def _(d):
    return sent(N.outcome_brand(insight_of(d, "brand"), shop(d)), "add_brands")


@query("outcome_store", outcome_check("store", "list_contains(p.stores_tags, i.value_tag)", "i.value"))
def _(d):
    return sent(N.outcome_store(insight_of(d, "store"), shop(d)), "add_stores")


IMAGE_OUT = "FROM image i LEFT JOIN (SELECT * FROM product WHERE c_custkey % 17 <> 0) p ON i.barcode = p.code"


@query("outcome_upc_image", f"""
SELECT i.id, CASE WHEN p.code IS NULL THEN 'error_missing_product' WHEN i.id % 5 = 0 THEN 'error_failed_update' ELSE 'updated' END AS status,
  CASE WHEN p.code IS NOT NULL AND i.id % 5 <> 0 THEN (SELECT coalesce(string_agg(m.img_key, ',' ORDER BY m.img_key), '') FROM image_meta m WHERE m.code = i.barcode AND m.imgid = i.image_id) END AS sent {IMAGE_OUT}
""")
def _(d):
    rows = image_facts(d, "is_upc_image", F.lit("{}")).withColumn("source_image", F.when(F.col("id") % 5 == 0, F.replace("source_image", F.lit(".jpg"), F.lit("0000000.jpg"))).otherwise(F.col("source_image")))
    out = N.outcome_upc_image(rows, shop_full(d))
    keys = F.from_json(F.get_json_object("payload", "$.unselect"), "array<string>")
    return out.select("id", "status", F.array_join(keys, ",").alias("sent"))


@query("outcome_packaging", f"SELECT i.id, CASE WHEN p.code IS NULL THEN 'error_missing_product' ELSE 'updated' END AS status, CASE WHEN p.code IS NOT NULL THEN 'en:n' || cast(i.id % 40 AS string) END AS sent {IMAGE_OUT}")
def _(d):
    element = F.struct(F.struct(F.concat(F.lit("en:n"), (F.col("id") % 40).cast("string")).alias("value_tag")).alias("shape"))
    out = N.outcome_packaging(image_facts(d, "packaging", F.to_json(F.struct(element.alias("element")))), shop(d))
    return out.select("id", "status", F.get_json_object(F.get_json_object("payload", "$.add_packaging"), "$.shape.value_tag").alias("sent"))


def crop_sql(angle: str, box: tuple, w: str = "i.width", h: str = "i.height") -> str:
    y0, x0, y1, x1 = (f"({v}e0 * {s})" for v, s in zip(box, (h, w, h, w)))
    return (
        f"round(CASE {angle} WHEN 90 THEN {x0} WHEN 180 THEN {h} - {y1} WHEN 270 THEN {w} - {x1} ELSE {y0} END, 6) AS crop_y0, "
        f"round(CASE {angle} WHEN 90 THEN {h} - {y1} WHEN 180 THEN {w} - {x1} WHEN 270 THEN {y0} ELSE {x0} END, 6) AS crop_x0"
    )


def crop_columns(path: str = "crop"):
    crop = F.from_json(F.get_json_object("payload", f"$.{path}"), "array<double>")
    return [F.round(crop[0], 6).alias("crop_y0"), F.round(crop[1], 6).alias("crop_x0")]


@query("outcome_nutrition_image", f"""
SELECT o.id, o.status, CASE WHEN o.status = 'updated' THEN o.crop_y0 END AS crop_y0, CASE WHEN o.status = 'updated' THEN o.crop_x0 END AS crop_x0 FROM (
  SELECT i.id, CASE WHEN p.code IS NULL THEN 'error_missing_product' WHEN i.id % 7 = 0 THEN 'error_invalid_image' WHEN EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.img_key = 'nutrition_en') AND i.id % 2 = 0 THEN 'error_already_annotated' ELSE 'updated' END AS status,
  {crop_sql('((i.id % 4) * 90)', (0.1, 0.2, 0.5, 0.75))} {IMAGE_OUT}) o
""")
def _(d):
    rows = image_facts(d, "nutrition_image", F.to_json(F.struct(((F.col("id") % 4) * 90).alias("rotation"))))
    rows = rows.withColumns({
        "value_tag": F.when(F.col("id") % 2 == 0, "en").otherwise("it"), "bounding_box": F.array(*[F.lit(x) for x in (0.1, 0.2, 0.5, 0.75)]),
        "source_image": F.when(F.col("id") % 7 == 0, F.replace("source_image", F.lit(".jpg"), F.lit("_x.jpg"))).otherwise(F.col("source_image")),
    })
    return N.outcome_nutrition_image(rows, shop_full(d)).select("id", "status", *crop_columns())


@query("outcome_ingredient_spellcheck", f"SELECT i.id, CASE WHEN p.code IS NULL THEN 'error_missing_product' ELSE 'updated' END AS status, CASE WHEN p.code IS NOT NULL THEN CASE WHEN i.id % 3 = 0 THEN 'user ' || i.image_id ELSE 'fixed ' || i.image_id END END AS sent {IMAGE_OUT}")
def _(d):
    rows = image_facts(d, "ingredient_spellcheck", F.to_json(F.struct(F.concat(F.lit("fixed "), F.col("id").cast("string")).alias("correction"))))
    rows = rows.withColumn("user_text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("user "), F.col("id").cast("string"))))
    return sent(N.outcome_ingredient_spellcheck(rows, shop(d)), "ingredients_text")


@query("outcome_nutrient_extraction", f"""
SELECT o.id, o.status, CASE WHEN o.status = 'updated' THEN o.per END AS per, CASE WHEN o.status = 'updated' THEN 'g' END AS unit, CASE WHEN o.status = 'updated' AND NOT o.done THEN o.image_key END AS image_key FROM (
  SELECT i.id, CASE WHEN i.id % 11 = 0 THEN 'cannot_vote' WHEN p.code IS NULL THEN 'error_missing_product' ELSE 'updated' END AS status, CASE WHEN i.id % 2 = 0 THEN '100g' ELSE 'serving' END AS per, 'nutrition_' || p.lang AS image_key,
  EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.img_key = 'nutrition_' || p.lang AND m.imgid = i.image_id) AS done {IMAGE_OUT}) o
""")
def _(d):
    value = F.struct(F.lit("1").alias("value"), F.lit(None).cast("string").alias("unit"))
    suffix = F.when(F.col("id") % 2 == 0, "_100g").otherwise("_serving")
    nutrients = F.create_map(F.concat(F.lit("salt"), suffix), value, F.concat(F.lit("fat"), suffix), value, F.lit("sugars_100g"), value, F.lit("serving_size"), value)
    rows = image_facts(d, "nutrient_extraction", F.lit("{}")).withColumns({"nutrients": nutrients, "is_vote": F.col("id") % 11 == 0})
    out = N.outcome_nutrient_extraction(rows, shop_full(d))
    get = lambda p: F.get_json_object("payload", p)
    return out.select("id", "status", get("$.nutrition_data_per").alias("per"), get("$.nutrients.salt.unit").alias("unit"), get("$.select_image.image_key").alias("image_key"))


@query("outcome_image_orientation", f"""
SELECT i.id, CASE WHEN p.code IS NULL THEN 'error_missing_product' WHEN i.id % 4 = 0 THEN 'error_invalid_data' WHEN NOT EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.img_key = 'front_fr') THEN 'error_updated_product' ELSE 'updated' END AS status,
  CASE WHEN p.code IS NOT NULL AND i.id % 4 <> 0 AND EXISTS (SELECT 1 FROM image_meta m WHERE m.code = i.barcode AND m.img_key = 'front_fr') THEN cast((i.id % 4) * 90 AS string) END AS rotate {IMAGE_OUT}
""")
def _(d):
    rows = image_facts(d, "image_orientation", F.to_json(F.struct(((F.col("id") % 4) * 90).alias("rotation"), F.lit("front_fr").alias("image_key"))))
    return N.outcome_image_orientation(rows, shop_full(d)).select("id", "status", F.get_json_object("payload", "$.rotate").alias("rotate"))


@query("outcome_ingredient_detection", f"""
SELECT o.id, o.status, CASE WHEN o.status = 'updated' THEN o.t END AS sent, CASE WHEN o.status = 'updated' AND o.crops THEN o.crop_y0 END AS crop_y0, CASE WHEN o.status = 'updated' AND o.crops THEN o.crop_x0 END AS crop_x0 FROM (
  SELECT i.id, CASE WHEN i.id % 11 = 0 THEN 'cannot_vote' WHEN p.code IS NULL THEN 'error_missing_product' ELSE 'updated' END AS status, CASE WHEN i.id % 3 = 0 THEN 'user' ELSE 'found' END AS t, i.id % 3 <> 0 AS crops,
  {crop_sql('((i.id % 4) * 90)', (0.1, 0.2, 0.5, 0.75))} {IMAGE_OUT}) o
""")
def _(d):
    rows = image_facts(d, "ingredient_detection", F.to_json(F.struct(F.lit("found").alias("text"), ((F.col("id") % 4) * 90).alias("rotation"))))
    rows = rows.withColumns({
        "value_tag": F.lit("it"), "bounding_box": F.array(*[F.lit(x) for x in (0.1, 0.2, 0.5, 0.75)]), "is_vote": F.col("id") % 11 == 0,
        "user_text": F.when(F.col("id") % 3 == 0, "user"), "user_box": F.lit(None).cast("array<double>"),
    })
    out = N.outcome_ingredient_detection(rows, shop_full(d))
    return out.select("id", "status", F.get_json_object("payload", "$.ingredients_text").alias("sent"), *crop_columns("select_image.crop"))


@query("annotation_outcome", """
SELECT type, status, count(*) AS n FROM (SELECT i.type, CASE WHEN p.code IS NULL THEN 'error_missing_product'
  WHEN i.type = 'label' AND list_contains(p.labels_tags, i.value_tag) THEN 'error_already_annotated' WHEN i.type = 'product_weight' AND p.quantity IS NOT NULL THEN 'error_already_annotated'
  WHEN i.type = 'store' AND list_contains(p.stores_tags, i.value_tag) THEN 'error_already_annotated' ELSE 'updated' END AS status
  FROM insight i LEFT JOIN (SELECT * FROM product WHERE c_custkey % 17 <> 0) p ON i.barcode = p.code WHERE i.type IN ('label', 'product_weight', 'brand', 'store')) GROUP BY 1, 2
""")
def _(d):
    out = N.annotation_outcome(d.insight, shop(d), ["label", "product_weight", "brand", "store"])
    return out.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


# --- logos --------------------------------------------------------------------


@query("logo_value_check", """
SELECT id, CASE WHEN annotation_type = 'label' AND annotation_value IS NOT NULL AND NOT (length(annotation_value) > 3 AND substring(annotation_value, 3, 1) = ':') THEN 'language-prefixed value required'
  WHEN annotation_value IS NULL AND annotation_type IN ('brand', 'category', 'label', 'store') THEN 'value required' END AS reject_reason FROM logo
""")
def _(d):
    return N.logo_value_check(d.logo).select("id", "reject_reason")


@query("logo_annotate", """
SELECT l.id, 'label' AS annotation_type, CASE WHEN l.id % 2 = 0 THEN 'en:n' || cast(l.l_partkey AS string) ELSE 'fr:noeud-' || cast(l.l_partkey AS string) END AS annotation_value_tag,
  CASE WHEN l.id % 2 = 0 THEN n.id ELSE s.id END AS taxonomy_value FROM logo l LEFT JOIN node n ON n.id = 'en:n' || cast(l.l_partkey AS string) LEFT JOIN synonym s ON s.tag = 'fr:noeud-' || cast(l.l_partkey AS string)
WHERE l.annotation_type IS NULL
""")
def _(d):
    key = F.col("l_partkey").cast("string")
    value = F.when(F.col("id") % 2 == 0, F.concat(F.lit("en:N"), key)).otherwise(F.concat(F.lit("fr:noeud "), key))
    given = d.logo.select(F.col("id").alias("logo_id"), F.lit("label").alias("type"), value.alias("value"))
    nodes, synonyms = d.node.withColumn("taxonomy", F.lit("label")), d.synonym.withColumn("taxonomy", F.lit("label"))
    logos = d.logo.withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    out = N.logo_annotate(logos, given, nodes, synonyms, "u1", F.lit("2024-01-01").cast("timestamp"))
    return out.select("id", "annotation_type", "annotation_value_tag", "taxonomy_value")


@query("logo_bulk_update", """
SELECT id, CASE WHEN hit THEN 'label' ELSE annotation_type END AS annotation_type, CASE WHEN hit THEN 'en-new' ELSE annotation_value_tag END AS annotation_value_tag
FROM (SELECT *, coalesce(annotation_type = 'brand' AND annotation_value_tag = 'value-3', false) AS hit FROM logo)
""")
def _(d):
    return N.logo_bulk_update(d.logo, "brand", "Value 3", "label", "en new").select("id", "annotation_type", "annotation_value_tag")


def derived_rows(d: Data):
    """Predictions and insights made from logos: one per annotated logo."""
    data = F.to_json(F.struct(F.col("id").alias("logo_id"), F.when(F.col("l_suppkey") % 3 == 0, True).when(F.col("l_suppkey") % 3 == 1, False).alias("is_annotation")))
    base = d.logo.select("id", "barcode", "server_type", F.when(F.col("idx") % 2 == 0, "brand").otherwise("label").alias("type"), F.when(F.col("idx") == 3, "other").otherwise("universal-logo-detector").alias("predictor"), data.alias("data"), "l_orderkey")
    return base, base.withColumn("annotation", F.when(F.col("l_orderkey") % 2 == 0, 1))


@query("logo_reset", """
SELECT 'logo_annotation' AS tbl, cast(id AS string) AS id FROM logo WHERE annotation_type IS NOT NULL AND l_suppkey % 4 <> 0
UNION ALL SELECT 'prediction', cast(id AS string) FROM logo WHERE l_suppkey % 4 = 0 AND idx <> 3 UNION ALL SELECT 'product_insight', cast(id AS string) FROM logo WHERE l_suppkey % 4 = 0 AND idx <> 3 AND l_orderkey % 2 = 1
""")
def _(d):
    predictions, insights = derived_rows(d)
    out = N.logo_reset(d.logo, predictions, insights, d.logo.where("l_suppkey % 4 = 0").select(F.col("id").alias("logo_id")))
    out["logo_annotation"] = out["logo_annotation"].where("annotation_type is not null")
    return keys_of(out)


@query("cleanup_logo_predictions", "SELECT id FROM logo WHERE NOT (l_suppkey % 3 = 1 AND l_orderkey % 3 = 0)")
def _(d):
    predictions, _ = derived_rows(d)
    return N.cleanup_logo_predictions(predictions, d.logo.where("l_orderkey % 3 = 0")).select("id")


# --- questions ----------------------------------------------------------------


def question_inputs(d: Data):
    names = d.node.select(F.explode(F.array(F.lit("category"), F.lit("label"))).alias("taxonomy"), F.col("id").alias("node_id"), "name_en", "name_fr")
    long = names.select("taxonomy", "node_id", F.lit("en").alias("lang"), F.col("name_en").alias("name")).unionByName(names.where("name_fr is not null").select("taxonomy", "node_id", F.lit("fr").alias("lang"), F.col("name_fr").alias("name")))
    from larder import fixed

    translations = d.region.where("r_regionkey = 0").select(F.lit("fr").alias("lang"), F.explode(F.array(F.lit(fixed.QUESTION_TEXTS["label"]), F.lit(fixed.QUESTION_TEXTS["brand"]))).alias("msg")).withColumn("text", F.concat(F.lit("fr: "), "msg"))
    pictures = d.node.where("p_partkey % 5 = 0").select(F.col("id").alias("value_tag"), F.concat(F.lit("https://static.example.org/"), "id").alias("ref_image_url"))
    return long, translations, pictures


@query("question_format", f"""
WITH front AS (SELECT m.code, '{BASE_URL}/images/products' || regexp_replace(i.source_image, '[^/]*$', '') || 'front_fr.3.400.jpg' AS url FROM image_meta m JOIN image i ON i.barcode = m.code AND i.image_id = m.imgid WHERE m.img_key = 'front_fr'),
s AS (SELECT m.code, m.img_key || '.' || m.rev AS n, CASE WHEN m.img_key LIKE 'front%' THEN 0 WHEN m.img_key LIKE 'ingr%' THEN 1 ELSE 2 END AS o FROM image_meta m WHERE m.imgid IS NOT NULL UNION ALL SELECT code, cast(max(o_orderkey) AS string), 3 FROM product_image GROUP BY code),
b AS (SELECT s.code, '{BASE_URL}/images/products' || any_value(f.folder) || arg_min(n, o) || '.400.jpg' AS url FROM s JOIN (SELECT barcode, any_value(regexp_replace(source_image, '[^/]*$', '')) AS folder FROM image GROUP BY barcode) f ON f.barcode = s.code GROUP BY s.code)
SELECT i.id AS insight_id, CASE WHEN i.type IN ('label', 'category') THEN coalesce(n.name_fr, n.name_en, i.value_tag) ELSE i.value END AS value,
  CASE i.type WHEN 'label' THEN 'fr: Does the product have this label?' WHEN 'brand' THEN 'fr: Does the product belong to this brand?' WHEN 'category' THEN 'Does the product belong to this category?' ELSE 'Does this weight match the weight displayed on the product?' END AS question,
  CASE WHEN i.type = 'label' AND n.p_partkey % 5 = 0 THEN 'https://static.example.org/' || n.id END AS ref_image_url,
  CASE WHEN i.type = 'category' THEN b.url WHEN i.type = 'brand' AND coalesce(i.predictor IN ('curated-list', 'taxonomy'), false) AND front.url IS NOT NULL THEN front.url ELSE '{BASE_URL}/images/products' || regexp_replace(i.source_image, '[.]jpg$', '.400.jpg') END AS source_image_url
FROM insight i LEFT JOIN node n ON i.value_tag = n.id LEFT JOIN b ON b.code = i.barcode LEFT JOIN front ON front.code = i.barcode WHERE i.type IN ('label', 'category', 'brand', 'product_weight')
""")
def _(d):
    out = Q.question_format(d.insight.withColumn("data", F.lit("{}")), product_full(d), *question_inputs(d), "fr", BASE_URL)
    return out.select("insight_id", "value", "question", "ref_image_url", "source_image_url")


@query("questions_page", """
WITH q AS (SELECT id, unique_scans_n FROM insight i WHERE server_type = 'off' AND annotation IS NULL AND automatic_processing = false AND NOT reserved_barcode AND type IN ('category', 'label', 'product_weight', 'brand', 'packaging')
  AND NOT EXISTS (SELECT 1 FROM vote v WHERE v.insight_id = i.id AND v.username = 'u3'))
SELECT id AS insight_id, (SELECT count(*) FROM q) AS total FROM q ORDER BY unique_scans_n DESC, id LIMIT 25 OFFSET 25
""")
def _(d):
    page, total = Q.questions_page(d.insight, 2, 25, "popularity", votes=d.vote, voted_by=("username", "u3"))
    return page.select(F.col("id").alias("insight_id")).withColumn("total", F.lit(total.first()["count"]))


# --- event streams ------------------------------------------------------------

DIFFS = """CASE event_id % 7 WHEN 0 THEN '{"uploaded_images":{"add":["' || cast(user_id AS string) || '"]}}' WHEN 1 THEN '{"uploaded_images":{"delete":["4"]}}' WHEN 2 THEN '{"fields":{"change":["product_type"]}}'
 WHEN 3 THEN '{"fields":{"change":["product_name"]}}' WHEN 4 THEN '{"nutrition":{"x":1}}' WHEN 5 THEN '{"fields":{"add":["other"]}}' END"""

UPDATES = f"""
SELECT event_id, ts, 'p' || cast(user_id AS string) AS code, CASE event_type WHEN 'signup' THEN 'deleted' WHEN 'error' THEN 'other' ELSE 'updated' END AS action,
  CASE event_id % 5 WHEN 0 THEN 'beauty' WHEN 1 THEN NULL ELSE 'food' END AS product_type, CASE event_id % 11 WHEN 0 THEN 'larder-app' WHEN 1 THEN 'scanbot' ELSE 'someone' END AS user_id,
  CASE WHEN event_id % 13 = 0 THEN '[larder] edit' ELSE 'edit' END AS comment, {DIFFS} AS diffs FROM events
"""

ROUTED = f"""
u AS ({UPDATES.strip()}),
routed AS (SELECT event_id, ts, code, CASE product_type WHEN 'beauty' THEN 'obf' ELSE 'off' END AS server_type, CASE WHEN action = 'deleted' THEN 'delete_product' WHEN event_id % 7 = 0 THEN 'image_upload' WHEN event_id % 7 = 2 THEN 'type_switch' WHEN event_id % 7 = 1 THEN 'image_delete' ELSE 'refresh' END AS action_kind,
  CASE WHEN user_id = 'scanbot' THEN 'low' ELSE 'high' END AS priority FROM u WHERE product_type IS NOT NULL AND action <> 'other' AND user_id <> 'larder-app' AND event_id % 13 <> 0)
"""


def updates(d: Data):
    return d.sql(UPDATES).withColumn("timestamp", F.col("ts").cast("timestamp"))


@query("stream_route", f"WITH {ROUTED} SELECT event_id, server_type, action_kind, priority, CASE WHEN action_kind IN ('type_switch', 'image_delete', 'refresh') THEN 10 ELSE 0 END AS delay_seconds FROM routed")
def _(d):
    return routes.stream_route(updates(d)).select("event_id", "server_type", "action_kind", "priority", "delay_seconds")


def run_stream(d: Data, frame, name: str, mode: str = "append"):
    """Drive a streaming frame to its end and read what it wrote."""
    out = scratch(d, name)
    query_ = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(d, name + "-ck")).outputMode(mode).trigger(availableNow=True).start()
    query_.awaitTermination()
    return d.spark.read.parquet(out)


def update_stream(d: Data):
    """The same updates as a file stream."""
    path = scratch(d, "updates")
    updates(d).drop("ts").withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).write.json(path)
    return routes.stream_events(d.spark, path, "event_id long, timestamp timestamp, code string, action string, product_type string, user_id string, comment string, diffs string")


@query("stream_events", f"WITH {ROUTED} SELECT event_id, server_type, action_kind FROM routed")
def _(d):
    """File stream through the router; equals the batch result."""
    return run_stream(d, routes.stream_route(update_stream(d)).select("event_id", "server_type", "action_kind"), "routed")


@query("replay_events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def _(d):
    return routes.replay_events(updates(d), "2024-01-10").select("event_id")


OCR_TASKS = "unnest(['extract_ingredients', 'extract_nutrition', 'predict_category', 'import_insights_from_image', 'run_logo_object_detection']) AS task"


@query("stream_ocr_ready", f"""
SELECT * FROM (SELECT event_id % 1000 AS image_id, 'p' || cast(user_id AS string) AS barcode, CASE event_id % 5 WHEN 0 THEN 'obf' ELSE 'off' END AS server_type, {OCR_TASKS} FROM events WHERE event_id % 5 <> 1 AND event_id % 3 <> 0)
WHERE server_type = 'off' OR task = 'run_logo_object_detection'
""")
def _(d):
    ready = updates(d).where("product_type is not null").select("timestamp", "code", "product_type", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 1000).alias("image_id"))
    return routes.stream_ocr_ready(ready).select("image_id", "barcode", "server_type", "task")


@query("upload_tasks", f"WITH {ROUTED}, t AS (SELECT event_id, server_type, unnest(['add_image_fingerprint', 'run_nutrition_table_object_detection']) AS task FROM routed WHERE action_kind = 'image_upload') SELECT server_type, task, count(*) AS n FROM t WHERE server_type = 'off' OR task = 'add_image_fingerprint' GROUP BY 1, 2")
def _(d):
    return routes.upload_tasks(routes.stream_route(updates(d))).groupBy("server_type", "task").agg(F.count(F.lit(1)).alias("n"))


@query("stream_delayed_refresh", f"""
WITH {ROUTED}, r AS (SELECT code, server_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY code, server_type ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM routed WHERE action_kind = 'refresh'),
g AS (SELECT *, sum(s) OVER (PARTITION BY code, server_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM r)
SELECT code, server_type, epoch_us(min(ts)) AS first_us, count(*) AS n_updates FROM g GROUP BY code, server_type, grp
""")
def _(d):
    rows = routes.stream_route(updates(d)).where("action_kind = 'refresh'")
    out = routes.stream_delayed_refresh(rows, "1 hour")
    return out.select("code", "server_type", F.unix_micros("first_at").alias("first_us"), "n_updates")


@query("stream_delayed_refresh_live")
def _(d):
    """The same sessions from a file stream; those still open at the end stay in state."""
    rows = routes.stream_route(update_stream(d)).where("action_kind = 'refresh'")
    return run_stream(d, routes.stream_delayed_refresh(rows, "1 hour"), "sessions")


@query("stream_refresh_timers", f"""
WITH RECURSIVE {ROUTED}, r AS (SELECT code, server_type, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY code, server_type ORDER BY ts) < 600000000 THEN 0 ELSE 1 END AS s FROM routed WHERE action_kind = 'refresh'),
g AS (SELECT *, sum(s) OVER (PARTITION BY code, server_type ORDER BY us ROWS UNBOUNDED PRECEDING) AS grp FROM r),
due AS (SELECT code, server_type, min(us) AS first_us, max(us) + 600000000 AS due_us, count(*) AS n_updates, row_number() OVER (PARTITION BY code, server_type ORDER BY min(us)) AS k FROM g GROUP BY code, server_type, grp),
run AS (
  SELECT code, server_type, k, true AS started, due_us + 86400000000 AS busy FROM due WHERE k = 1
  UNION ALL
  SELECT d.code, d.server_type, d.k, d.due_us >= busy, CASE WHEN d.due_us >= busy THEN d.due_us + 86400000000 ELSE busy END FROM run JOIN due d ON d.code = run.code AND d.server_type = run.server_type AND d.k = run.k + 1)
SELECT code, server_type, first_us, due_us, n_updates, started FROM due JOIN run USING (code, server_type, k)
WHERE due_us <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM routed WHERE action_kind = 'refresh')
""")
def _(d):
    """Refreshes by timers from a file stream: ten minutes after a burst, none while one of a day before runs."""
    rows = routes.stream_route(update_stream(d)).where("action_kind = 'refresh'")
    with timers.timer_state(d.spark):
        return run_stream(d, timers.delayed_refreshes(rows, 600, 86_400), "refreshes")


@query("stream_serialize_product", "SELECT 'p' || cast(user_id AS string) AS code, count(*) AS n FROM events GROUP BY 1")
def _(d):
    """Events per product counted inside its own partition."""
    rows = routes.stream_serialize_product(updates(d), 8)
    parts = rows.select("code", F.spark_partition_id().alias("p")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p").alias("parts"))
    return parts.where("parts = 1").select("code", "n")


@query("stream_category_trigger", "SELECT event_id, event_id % 7 IN (0, 1, 3, 4, 6) AS rerun FROM events")
def _(d):
    return routes.stream_category_trigger(updates(d)).select("event_id", "rerun")


@query("stream_apply", f"WITH {ROUTED} SELECT action_kind, count(*) AS n FROM routed WHERE action_kind IN ('delete_product', 'image_delete') GROUP BY action_kind")
def _(d):
    """Two handlers append their rows per micro-batch; read back together."""
    out = scratch(d, "applied")

    def handle(rows, epoch):
        rows.select("action_kind", F.lit(epoch).alias("epoch")).write.mode("append").parquet(out)

    routed = routes.stream_route(update_stream(d))
    routes.stream_apply(routed, {"delete_product": handle, "image_delete": handle}, scratch(d, "applied-ck")).awaitTermination()
    return d.spark.read.parquet(out).groupBy("action_kind").agg(F.count(F.lit(1)).alias("n"))


@query("refresh_image_deletes", "SELECT DISTINCT 'p' || cast(user_id AS string) AS barcode, CASE event_id % 5 WHEN 0 THEN 'obf' ELSE 'off' END AS server_type, '4' AS image_id FROM events WHERE event_id % 7 = 1 AND event_id % 5 <> 1")
def _(d):
    from larder.operators.deletes import refresh_image_deletes

    return refresh_image_deletes(updates(d).where("product_type is not null"))

