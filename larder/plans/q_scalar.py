"""Queries: scalar functions and post-processing of model output."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from larder.functions import boxes, measures, paths, text
from larder.operators import questions as Q
from larder.operators import tokens as T
from larder.plans.q_core import CLOSURE, closure, detections
from larder.plans.registry import Data, query
from larder.plans.roles import product_full

# --- text ---------------------------------------------------------------------

FOLD_FROM = "àâäáãåçéèêëíìîïñóòôöõúùûüýÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
FOLD_TO = "aaaaaaceeeeiiiinooooouuuuyAAAAAACEEEEIIIINOOOOOUUUUY"


def sql_fold(expr: str) -> str:
    return f"replace(replace(replace(replace(replace(translate({expr}, '{FOLD_FROM}', '{FOLD_TO}'), 'ß', 'ss'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE')"


@query("fn_tag", f"""
SELECT doc_id, trim(regexp_replace(regexp_replace(translate(replace(lower({sql_fold('text')}), ' & ', '-'), ' ''.', '---'), '[!?]', '', 'g'), ' {{2,}}', ' ', 'g'), '-') AS tag FROM documents
""")
def _(d):
    return d.documents.select("doc_id", text.tag(F.col("text")).alias("tag"))


PUNCT = r"""[\s!"#$%&'()*+,/:;<=>?@\[\\\]^_`{|}~¡¢£¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾¿×ˆ˜–—‘’‚“”„†‡•…‰‹›€™]""".replace("'", "''")


@query("fn_normalize_tag", rf"""
SELECT doc_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(translate(translate(text, '¢£¤¥§©ª®°²³µ¶¹º¼½¾×‰€™', '----------------------'), 'éèàù', 'eeau'), '&[\p{{L}}\p{{N}}_]+;', '-', 'g'), '{PUNCT}', '-', 'g')), '-+', '-', 'g'), '-') AS tag FROM documents
""")
def _(d):
    return d.documents.select("doc_id", text.taxonomy_tag(F.col("text")).alias("tag"))


@query("fn_store_tag", "SELECT doc_id, translate(replace(lower(text), ' & ', '-'), ' ''', '--') AS tag FROM documents")
def _(d):
    return d.documents.select("doc_id", text.store_tag(F.col("text")).alias("tag"))


@query("fn_emb_code", "SELECT id, regexp_replace(regexp_replace(lower(trim(value)), '[ .-]', '', 'g'), 'ce$', 'ec') AS code FROM prediction WHERE type = 'packager_code'")
def _(d):
    return d.prediction.where("type = 'packager_code'").select("id", text.emb_code(F.col("value")).alias("code"))


@query("fn_strip_accents", "SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS plain FROM documents")
def _(d):
    return d.documents.select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query("fn_fold", f"""
SELECT doc_id, regexp_replace({sql_fold('text')}, '[^\\x00-\\x7F]', '', 'g') AS dropped, {sql_fold('text')} AS kept, translate(text, '{FOLD_FROM}', '{FOLD_TO}') AS same_length FROM documents
""")
def _(d):
    t = F.col("text")
    return d.documents.select("doc_id", text.fold(t).alias("dropped"), text.fold(t, "keep").alias("kept"), text.fold(t, "same_length").alias("same_length"))


@query("fn_collapse_spaces", "SELECT page_id, regexp_replace(replace(html, '>', '  '), ' {2,}', ' ', 'g') AS t FROM pages")
def _(d):
    return d.pages.select("page_id", text.collapse_spaces(F.replace("html", F.lit(">"), F.lit("  "))).alias("t"))


@query("fn_is_prefixed", "SELECT doc_id, length(t) > 3 AND substring(t, 3, 1) = ':' AS prefixed FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || ':' || source WHEN 1 THEN lang || ':' ELSE source END AS t FROM documents)")
def _(d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(":"), "source")).when(F.col("doc_id") % 3 == 1, F.concat("lang", F.lit(":"))).otherwise(F.col("source"))
    return d.documents.select("doc_id", text.is_prefixed(t).alias("prefixed"))


@query("fn_valid_lang", "SELECT doc_id, regexp_matches(t, '^\\p{L}{2}$') AS valid FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || 'x' WHEN 1 THEN '9' || lang ELSE lang END AS t FROM documents)")
def _(d):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat("lang", F.lit("x"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("9"), "lang")).otherwise(F.col("lang"))
    return d.documents.select("doc_id", text.valid_lang(t).alias("valid"))


# --- paths --------------------------------------------------------------------


@query("fn_image_id", "SELECT id, nullif(regexp_extract(p, '(^|/)([0-9]+)([.][^/.]*)?$', 2), '') AS image_id FROM (SELECT id, CASE WHEN id % 3 = 0 THEN replace(source_image, '.jpg', '_fr.jpg') ELSE source_image END AS p FROM image)")
def _(d):
    p = F.when(F.col("id") % 3 == 0, F.replace("source_image", F.lit(".jpg"), F.lit("_fr.jpg"))).otherwise(F.col("source_image"))
    return d.image.select("id", paths.image_id(p).alias("image_id"))


@query("fn_source_image", "SELECT id, source_image FROM image")
def _(d):
    url = F.concat(F.lit("https://images.example.org/images/products"), F.when(F.col("id") % 2 == 0, F.regexp_replace("source_image", "jpg$", "json")).otherwise(F.col("source_image")))
    return d.image.select("id", paths.source_image(url).alias("source_image"))


@query("fn_image_path", "SELECT id, source_image AS path FROM image")
def _(d):
    return d.image.select("id", paths.image_path(F.col("barcode"), F.col("image_id")).alias("path"))


@query("fn_display_image", "SELECT id, regexp_replace(source_image, '[.]jpg$', '.400.jpg') AS shown FROM image")
def _(d):
    return d.image.select("id", paths.display_image(F.col("source_image")).alias("shown"))


@query("fn_barcode_prefix", "SELECT code, CASE WHEN length(code) = 13 THEN left(code, 7) || 'xxxxxx' END AS prefix FROM product")
def _(d):
    return d.product.select("code", paths.barcode_prefix(F.col("code")).alias("prefix"))


@query("fn_facet_name", "SELECT page_id, replace(trim(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/'), '-', '_') AS facet FROM pages")
def _(d):
    return d.pages.select("page_id", paths.facet_name(F.col("url")).alias("facet"))


@query("fn_server_type", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'obf' WHEN 2 THEN 'opff' WHEN 3 THEN 'opf' END AS server FROM documents")
def _(d):
    kind = F.array(*[F.lit(x) for x in ("food", "beauty", "petfood", "product", "other")])[(F.col("doc_id") % 5).cast("int")]
    return d.documents.select("doc_id", paths.server_of_product_type(kind).alias("server"))


@query("fn_hash_partition", """
SELECT code, cast(((CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) % 4 + 4) % 4 AS INT) AS bucket FROM (
  SELECT code, cast(('0x' || substring(md5(code), 31, 2) || substring(md5(code), 29, 2) || substring(md5(code), 27, 2) || substring(md5(code), 25, 2)) AS BIGINT) AS u FROM product)
""")
def _(d):
    return d.product.select("code", paths.hash_partition(F.col("code"), 4).alias("bucket"))


BASE = "https://images.example.org"


@query("fn_image_url", f"SELECT id, '{BASE}/images/products' || source_image AS url FROM image")
def _(d):
    return d.image.select("id", paths.image_url(BASE, F.col("source_image")).alias("url"))


@query("fn_device_id", "SELECT id, CASE WHEN id % 2 = 0 THEN device_id ELSE sha1(username) END AS device FROM vote")
def _(d):
    return d.vote.select("id", paths.device_id(F.when(F.col("id") % 2 == 0, F.col("device_id")), F.col("username")).alias("device"))


@query("fn_export_cast", "SELECT id, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%S') AS uploaded_at FROM image")
def _(d):
    return d.image.select("id", paths.iso_timestamp(F.col("uploaded_at")).alias("uploaded_at"))


@query("fn_crop_url", f"""
SELECT id, '{BASE}/api/v1/images/crop?image_url=' || source_image || '&y_min=' || cast(cast(id % 7 AS double) AS string) || '&x_min=1.0&y_max=' || cast(cast(id % 7 + 3 AS double) AS string) || '&x_max=5.0' AS url FROM image
""")
def _(d):
    b = boxes.box(F.col("id") % 7, F.lit(1), F.col("id") % 7 + 3, F.lit(5))
    return d.image.select("id", paths.crop_url(BASE, F.col("source_image"), b).alias("url"))


@query("fn_edit_comment", """
SELECT id, '[larder] Adding ' || type || ', ID: ' || id || CASE WHEN n_votes >= 3 THEN ' (applied after 3 anonymous votes)' WHEN automatic_processing THEN ' (automated edit)' ELSE '' END AS comment FROM insight
""")
def _(d):
    return d.insight.select("id", paths.edit_comment(F.concat(F.lit("Adding "), "type"), F.col("n_votes") >= 3, F.coalesce("automatic_processing", F.lit(False)), F.col("id")).alias("comment"))


# --- measures -----------------------------------------------------------------

UNITS = ["mg", "g", "kg", "oz", "lbs", "ml", "cl", "dl", "l", "fl oz"]
UNIT_SQL = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNITS)) + " END"
FACTOR_SQL = "CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(["0.001e0", "1e0", "1000e0", "28.349523125e0", "453.59237e0", "1e0", "10e0", "100e0", "1000e0", "30e0"])) + " END"


def unit_of(key):
    return F.array(*[F.lit(u) for u in UNITS])[(key % 10).cast("int")]


@query("fn_normalize_weight", f"""
SELECT p_partkey, CASE WHEN abs(v - floor(v)) <= 1e-9 * greatest(abs(v), abs(floor(v))) THEN floor(v) ELSE round(v, 6) END AS amount, CASE WHEN p_partkey % 10 < 5 THEN 'g' ELSE 'ml' END AS unit
FROM (SELECT p_partkey, ((p_partkey % 50) + 0.5e0) * {FACTOR_SQL} AS v FROM part)
""")
def _(d):
    key = F.col("p_partkey")
    value = F.concat((key % 50).cast("string"), F.lit(",5"))
    return d.part.select("p_partkey", F.round(measures.normalize_weight(value, unit_of(key)), 6).alias("amount"), measures.unit_kind(unit_of(key)).alias("unit"))


WEIGHT_TEXT = "CASE p_partkey % 6 WHEN 0 THEN '0' || cast(p_partkey AS string) WHEN 1 THEN cast(p_partkey AS string) || ',5' WHEN 2 THEN 'x' || cast(p_partkey AS string) WHEN 3 THEN '-' || cast(p_partkey AS string) ELSE cast(p_partkey AS string) END"


@query("fn_valid_weight", f"SELECT p_partkey, p_partkey % 6 >= 4 AND p_partkey > 0 AS valid FROM part")
def _(d):
    return d.part.select("p_partkey", measures.is_valid_weight(F.expr(WEIGHT_TEXT)).alias("valid"))


@query("fn_extreme_weight", "SELECT p_partkey, p_partkey % 30 > 20 OR p_partkey >= 10000 OR p_partkey <= 10 AS extreme FROM part")
def _(d):
    return d.part.select("p_partkey", measures.is_extreme_weight(F.col("p_partkey").cast("double"), (F.col("p_partkey") % 30).cast("string")).alias("extreme"))


@query("fn_suspicious_weight", "SELECT o_orderkey, o_totalprice > 1000 AND cast(floor(o_totalprice) AS BIGINT) % 10 <> 0 AS suspicious FROM orders")
def _(d):
    return d.orders.select("o_orderkey", measures.is_suspicious_weight(F.col("o_totalprice")).alias("suspicious"))


@query("fn_parse_date", """
SELECT o_orderkey, CASE WHEN year(x) BETWEEN 2015 AND 2025 THEN strftime(x, '%Y-%m-%d') END AS iso FROM (
  SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 2 = 0 THEN '20' || lpad(cast(10 + o_orderkey % 20 AS string), 2, '0') ELSE cast(2010 + o_orderkey % 20 AS string) END
    || '-' || lpad(cast(1 + o_orderkey % 14 AS string), 2, '0') || '-' || lpad(cast(1 + o_orderkey % 33 AS string), 2, '0') AS DATE) AS x FROM orders)
""")
def _(d):
    key = F.col("o_orderkey")
    year = F.when(key % 2 == 0, F.lpad((10 + key % 20).cast("string"), 2, "0")).otherwise((2010 + key % 20).cast("string"))
    iso = measures.parse_date(F.lpad((1 + key % 33).cast("string"), 2, "0"), F.lpad((1 + key % 14).cast("string"), 2, "0"), year, 2015, 2025)
    return d.orders.select("o_orderkey", iso.alias("iso"))


@query("fn_nutrition_value", """
SELECT o_orderkey, CASE WHEN v IS NULL THEN -1e0 WHEN v < 0 OR v >= CASE WHEN n = 'energy-kcal' THEN 3800 ELSE 101 END THEN -2e0 ELSE v END AS value
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_orderkey % 5000 - 20 AS double) END AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'energy-kcal' ELSE 'salt' END AS n FROM orders)
""")
def _(d):
    key = F.col("o_orderkey")
    value = F.when(key % 7 != 0, (key % 5000 - 20).cast("double"))
    return d.orders.select("o_orderkey", measures.nutrition_value(value, F.when(key % 2 == 0, "energy-kcal").otherwise("salt")).alias("value"))


@query("fn_nutrition_vector", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '-1.0,-1.0,-1.0,-1.0,-1.0,-1.0,-1.0,-1.0,-1.0'
 ELSE cast(cast(o_orderkey % 100 AS double) AS string) || ',-1.0,-1.0,-1.0,-1.0,-1.0,' || CASE WHEN o_orderkey % 200 >= 101 THEN '-2.0' ELSE cast(cast(o_orderkey % 200 AS double) AS string) END
  || ',' || cast(cast(o_orderkey % 3000 AS double) AS string) || ',-1.0' END AS vector FROM orders
""")
def _(d):
    key = F.col("o_orderkey")
    nutrients = F.create_map(F.lit("fat"), (key % 100).cast("double"), F.lit("salt"), (key % 200).cast("double"), F.lit("energy-kcal"), (key % 3000).cast("double"))
    version = F.when(key % 3 == 0, 999).otherwise(1003)
    return d.orders.select("o_orderkey", F.array_join(F.transform(measures.nutrition_vector(nutrients, version), lambda x: x.cast("string")), ",").alias("vector"))


@query("fn_equal_nutrient", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 4 = 0 WHEN 1 THEN false WHEN 2 THEN o_orderkey % 10 <> 0
  WHEN 3 THEN o_orderkey % 10 <> 0 AND o_orderkey % 5 = 3 WHEN 4 THEN o_orderkey % 10 <> 0 ELSE o_orderkey % 10 <> 0 AND o_orderkey % 3 = 0 END AS equal FROM orders
""")
def _(d):
    """Six comparison situations by key: traces, missing, no unit, different, scaled unit, energy."""
    key = F.col("o_orderkey")
    amount = (key % 10).cast("string")
    case = key % 6
    pred = F.when(case == 0, "traces").when(case == 3, F.concat(F.lit("< "), F.when(key % 5 == 3, amount).otherwise("77"))).when(case == 4, ((key % 10) * 1000).cast("string")).when(case == 5, F.when(key % 3 == 0, amount).otherwise("88")).otherwise(amount)
    pred_unit = F.when(case == 2, None).when(case == 4, "mg").when(case == 5, "kcal").otherwise("g")
    value = F.when(case == 0, F.when(key % 4 == 0, "0").otherwise("3")).when(case == 1, None).otherwise(amount)
    unit = F.when(case == 5, "kcal").otherwise("g")
    return d.orders.select("o_orderkey", measures.equal_nutrient(pred, pred_unit, value, unit).alias("equal"))


@query("fn_match_nutrient_value", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN cast(o_orderkey AS string) WHEN 1 THEN '< ' || cast(o_orderkey AS string) || '.5' WHEN 2 THEN '0' WHEN 3 THEN cast(o_orderkey AS string)
    ELSE cast(o_orderkey AS string) || '.1' END AS value,
  CASE o_orderkey % 5 WHEN 0 THEN 'kcal' WHEN 1 THEN 'g' WHEN 2 THEN NULL WHEN 3 THEN 'µg' ELSE 'g' END AS unit, o_orderkey % 5 <> 0 OR o_orderkey % 2 = 0 AS valid FROM orders
""")
def _(d):
    key = F.col("o_orderkey")
    k = key.cast("string")
    case = key % 5
    words = F.when(case == 0, F.concat(k, F.lit(" kcal"))).when(case == 1, F.concat(F.lit("< "), k, F.lit(",5 g"))).when(case == 2, "O").when(case == 3, F.concat(k, F.lit("mcg"))).otherwise(F.concat(k, F.lit(".19")))
    label = F.when(case == 0, F.when(key % 2 == 0, "energy_kcal_100g").otherwise("salt_100g")).when(case == 3, "vitamin_d_100g").when(case == 4, "proteins_100g").otherwise("salt_100g")
    return d.orders.select("o_orderkey", measures.match_nutrient_value(words, label).alias("m")).select("o_orderkey", "m.*")


@query("fn_default_unit", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'mg' END, CASE o_orderkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'kJ' END) AS unit FROM orders
""")
def _(d):
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, "salt").when(key % 3 == 1, "energy-kj").otherwise("unknown")
    entry = F.struct(F.lit("1").alias("value"), F.when(key % 2 == 0, "mg").alias("unit"))
    return d.orders.select("o_orderkey", measures.default_units(F.create_map(name, entry))[name]["unit"].alias("unit"))


@query("fn_box_relative", """
SELECT id, round(greatest(0e0, -5e0 / height), 6) AS y0, round(greatest(0e0, (id % 50) / cast(width AS double)), 6) AS x0, round(least(1e0, (id % 900) / cast(height AS double)), 6) AS y1, round(least(1e0, 2000e0 / width), 6) AS x1 FROM image
""")
def _(d):
    b = boxes.to_relative(boxes.box(F.lit(-5), F.col("id") % 50, F.col("id") % 900, F.lit(2000)), F.col("width"), F.col("height"))
    return d.image.select("id", *[F.round(b[i], 6).alias(n) for i, n in enumerate(("y0", "x0", "y1", "x1"))])


@query("fn_box_rotate", """
SELECT id, CASE a WHEN 90 THEN 20e0 WHEN 180 THEN height - 60e0 WHEN 270 THEN width - 80e0 ELSE 10e0 END AS y0, CASE a WHEN 90 THEN height - 60e0 WHEN 180 THEN width - 80e0 WHEN 270 THEN 10e0 ELSE 20e0 END AS x0,
  CASE a WHEN 90 THEN 80e0 WHEN 180 THEN height - 10e0 WHEN 270 THEN width - 20e0 ELSE 60e0 END AS y1, CASE a WHEN 90 THEN height - 10e0 WHEN 180 THEN width - 20e0 WHEN 270 THEN 60e0 ELSE 80e0 END AS x1
FROM (SELECT *, (id % 4) * 90 AS a FROM image)
""")
def _(d):
    b = boxes.rotate(F.array(*[F.lit(float(x)) for x in (10, 20, 60, 80)]), F.col("width").cast("double"), F.col("height").cast("double"), (F.col("id") % 4) * 90)
    return d.image.select("id", *[b[i].alias(n) for i, n in enumerate(("y0", "x0", "y1", "x1"))])


@query("fn_iou", """
SELECT id, round(i / (0.25e0 + 0.25e0 - i), 6) AS iou FROM (SELECT id, greatest(0e0, least(0.5e0, (id % 10) / 10e0 + 0.5e0) - greatest(0e0, (id % 10) / 10e0)) * greatest(0e0, least(0.5e0, (id % 7) / 10e0 + 0.5e0) - greatest(0e0, (id % 7) / 10e0)) AS i FROM image)
""")
def _(d):
    y, x = (F.col("id") % 10) / 10, (F.col("id") % 7) / 10
    return d.image.select("id", F.round(boxes.iou(boxes.box(F.lit(0), F.lit(0), F.lit(0.5), F.lit(0.5)), boxes.box(y, x, y + 0.5, x + 0.5)), 6).alias("iou"))


@query("fn_polygon_area", "SELECT id, cast(width AS double) * height / 2 AS area FROM image")
def _(d):
    """Triangle over the image: half of its area."""
    pts = [(F.lit(0.0), F.lit(0.0)), (F.col("width").cast("double"), F.lit(0.0)), (F.lit(0.0), F.col("height").cast("double"))]
    return d.image.select("id", boxes.polygon_area(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in pts])).alias("area"))


@query("fn_rotation_angle", "SELECT id, CASE id % 5 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 WHEN 3 THEN 270 ELSE 0 END AS rotation FROM image")
def _(d):
    o = F.array(*[F.lit(x) for x in ("up", "left", "down", "right", "unknown")])[(F.col("id") % 5).cast("int")]
    return d.image.select("id", boxes.rotation_angle(o).alias("rotation"))


@query("fn_json_fields", "SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(d):
    return d.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn_selected_images", f"""
SELECT p.code AS barcode, split_part(m.img_key, '_', 1) AS kind, split_part(m.img_key, '_', 2) AS lang, '{BASE}/images/products' || regexp_replace(i.source_image, '[^/]*$', '') || m.img_key || '.' || m.rev || '.400.jpg' AS url
FROM image_meta m JOIN product p ON m.code = p.code JOIN image i ON i.barcode = p.code AND i.image_id = m.imgid
""")
def _(d):
    rows = Q.selected_image_rows(product_full(d), BASE)
    return rows.where("field = 'display'").select("barcode", "kind", "lang", "url")


@query("fn_generic_image", f"""
WITH s AS (SELECT m.code, m.img_key || '.' || m.rev AS n, CASE WHEN m.img_key LIKE 'front%' THEN 0 WHEN m.img_key LIKE 'ingr%' THEN 1 ELSE 2 END AS o FROM image_meta m WHERE m.imgid IS NOT NULL
  UNION ALL SELECT code, cast(max(o_orderkey) AS string), 3 FROM product_image GROUP BY code),
b AS (SELECT code, arg_min(n, o) AS n FROM s GROUP BY code), f AS (SELECT barcode, any_value(regexp_replace(source_image, '[^/]*$', '')) AS folder FROM image GROUP BY barcode)
SELECT p.code, '{BASE}/images/products' || f.folder || b.n || '.400.jpg' AS url FROM product p LEFT JOIN b ON p.code = b.code LEFT JOIN f ON p.code = f.barcode
""")
def _(d):
    return product_full(d).select("code", Q.generic_image(F.col("code"), F.col("images"), BASE).alias("url"))


@query("fn_ingredient_counts", """
SELECT doc_id, count(*) AS ingredients_n, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS known_ingredients_n, round(sum(CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) / cast(count(*) AS double), 9) AS fraction
FROM (SELECT doc_id, unnest([doc_id % 100 + 1, doc_id % 60 + 1, doc_id % 7 + 1, doc_id % 150 + 1]) AS k FROM documents) GROUP BY doc_id
""")
def _(d):
    """Two levels of nested ingredients per document."""
    key = F.col("doc_id")

    def ident(n):
        return F.concat(F.lit("en:n"), (key % n + 1).cast("string")).alias("id")

    leaf = F.array(F.struct(ident(7)), F.struct(ident(150)))
    trees = d.documents.select("doc_id", F.array(F.struct(ident(100), leaf.alias("ingredients")), F.struct(ident(60), F.lit(None).cast("array<struct<id:string>>").alias("ingredients"))).alias("ingredients"))
    known = d.node.where("p_partkey % 2 = 0")
    out = T.ingredient_counts(trees, known, ["doc_id"])
    return out.select("doc_id", "ingredients_n", "known_ingredients_n", F.round("fraction_known_ingredients", 9).alias("fraction"))


@query("fn_layout_box", """
SELECT id, cast(least(greatest(floor((id % 1300 - 50) * 1000e0 / width), 0), 999) AS INT) AS x0, cast(least(greatest(floor((id % 1300 - 50 + 30) * 1000e0 / width), 0), 999) AS INT) AS x1, cast(least(floor((id % 900 + 10) * 1000e0 / height), 999) AS INT) AS y1 FROM image
""")
def _(d):
    x, y = (F.col("id") % 1300 - 50).cast("double"), (F.col("id") % 900).cast("double")
    pts = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + 30, y), (x + 30, y + 10), (x, y + 10))])
    b = boxes.layout_box(pts, F.col("width").cast("double"), F.col("height").cast("double"))
    return d.image.select("id", b[0].alias("x0"), b[2].alias("x1"), b[3].alias("y1"))


@query("fn_phash_int", "SELECT o_orderkey, o_orderkey * 3 AS hash FROM orders")
def _(d):
    bits = F.transform(F.split(F.lpad(F.bin(F.col("o_orderkey") * 3), 64, "0"), ""), lambda c: c == "1")
    return d.orders.select("o_orderkey", measures.phash_int(F.slice(bits, 1, 64)).alias("hash"))


# --- model output -------------------------------------------------------------

EVENT_LABELS = ["O", "B-SALT", "I-SALT", "B-FAT", "I-FAT"]


def event_tokens(d: Data):
    """Token rows per user: logits from the event value."""
    v = F.col("value")
    logits = F.array(*[((F.floor(v * (i + 3)) % 11) + 0.1 * i).cast("double") for i in range(5)])
    return d.events.select(F.col("user_id").alias("source_image"), F.col("event_id").alias("token_idx"), F.floor(F.col("event_id") / 3).alias("word_id"), (F.col("event_id") % 50 == 0).alias("special"), (F.col("event_id") % 37 == 0).alias("unknown"), logits.alias("logits"))


LOGITS = "[" + ", ".join(f"cast(floor(value * {i + 3}) AS BIGINT) % 11 + {0.1 * i:.1f}e0" for i in range(5)) + "]"


@query("softmax_argmax", f"""
WITH t AS (SELECT user_id, event_id, event_id // 3 AS word_id, event_id % 50 = 0 AS special, event_id % 37 = 0 AS unknown, {LOGITS} AS l FROM events),
f AS (SELECT *, coalesce(word_id <> lag(word_id) OVER (PARTITION BY user_id ORDER BY event_id), true) OR unknown AS first FROM t),
s AS (SELECT *, list_max(l) AS top, list_position(l, list_max(l)) AS p FROM f WHERE NOT special AND first)
SELECT user_id AS source_image, event_id AS token_idx, ['O', 'SALT', 'SALT', 'FAT', 'FAT'][p] AS entity, round(1e0 / list_sum(list_transform(l, lambda x: exp(x - top))), 9) AS score FROM s
""")
def _(d):
    out = T.softmax_argmax(event_tokens(d), EVENT_LABELS)
    return out.select("source_image", "token_idx", "entity", F.round("score", 9).alias("score"))


@query("token_offsets", """
WITH t AS (SELECT user_id, event_id, event_id // 3 AS word_id, event_id % 50 = 0 AS special FROM events)
SELECT user_id AS source_image, event_id AS token_idx, substring('lorem ipsum dolor sit amet' || cast(user_id AS string), event_id % 20 + 1, 3) AS word, is_subword FROM (
  SELECT *, coalesce(word_id = lag(word_id) OVER (PARTITION BY user_id ORDER BY event_id), false) AS is_subword FROM t) WHERE NOT special
""")
def _(d):
    rows = event_tokens(d).withColumns({"start": (F.col("token_idx") % 20).cast("int"), "end": (F.col("token_idx") % 20 + 3).cast("int")})
    sentences = d.events.select(F.col("user_id").alias("source_image")).distinct().withColumn("sentence", F.concat(F.lit("lorem ipsum dolor sit amet"), F.col("source_image").cast("string")))
    return T.token_offsets(rows, sentences).select("source_image", "token_idx", "word", "is_subword")


def run_rows(d: Data):
    entity = F.when(F.col("event_type") == "error", "O").when(F.col("event_type").isin("view", "click"), "SALT_100G").otherwise("FAT_100G")
    return d.events.select(F.col("user_id").alias("source_image"), F.col("event_id").alias("index"), F.col("event_type").alias("word"), entity.alias("entity"), F.col("value").alias("score"))


RUNS = """
e AS (SELECT user_id, event_id, event_type, value, CASE WHEN event_type = 'error' THEN 'O' WHEN event_type IN ('view', 'click') THEN 'SALT_100G' ELSE 'FAT_100G' END AS entity FROM events),
c AS (SELECT *, CASE WHEN entity IS DISTINCT FROM lag(entity) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS chg FROM e),
g AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
runs AS (SELECT user_id, run, entity, string_agg(event_type, ' ' ORDER BY event_id) AS words, min(event_id) AS s, max(event_id) + 1 AS e, arg_min(value, event_id) AS score FROM g WHERE entity <> 'O' GROUP BY user_id, run, entity)
"""


@query("entity_runs", f"WITH {RUNS} SELECT user_id AS source_image, entity, words, s AS start, e AS \"end\", score FROM runs")
def _(d):
    return T.entity_runs(run_rows(d)).select("source_image", "entity", F.array_join("words", " ").alias("words"), "start", "end", "score")


@query("run_lengths", f"WITH {RUNS} SELECT user_id AS source_image, entity, count(*) AS runs, max(e - s) AS longest FROM runs GROUP BY 1, 2")
def _(d):
    runs = T.entity_runs(run_rows(d))
    return runs.groupBy("source_image", "entity").agg(F.count(F.lit(1)).alias("runs"), F.max(F.col("end") - F.col("start")).alias("longest"))


ENTITY_SQL = """
en AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'ENERGY_KJ_100G' WHEN 1 THEN 'SATURATED_FAT_SERVING' WHEN 2 THEN 'SERVING_SIZE' WHEN 3 THEN 'SALT_100G' ELSE 'PROTEINS_100G' END AS entity,
  CASE event_id % 5 WHEN 0 THEN cast(event_id % 900 + 1 AS string) || ' kJ' WHEN 1 THEN '< ' || cast(event_id % 9 AS string) || ' g' WHEN 2 THEN cast(event_id % 90 + 1 AS string) || ' 9'
    WHEN 3 THEN 'traces' ELSE cast(event_id % 9 + 1 AS string) || '.5 kcal' END AS t FROM events)
"""


def entity_rows(d: Data):
    k = F.col("event_id")
    case = k % 5
    entity = F.when(case == 0, "ENERGY_KJ_100G").when(case == 1, "SATURATED_FAT_SERVING").when(case == 2, "SERVING_SIZE").when(case == 3, "SALT_100G").otherwise("PROTEINS_100G")
    words = (
        F.when(case == 0, F.array(F.concat(F.lit("kJ/"), (k % 900 + 1).cast("string")), F.lit("(kJ)"))).when(case == 1, F.array(F.lit("<"), (k % 9).cast("string"), F.lit("g")))
        .when(case == 2, F.array((k % 90 + 1).cast("string"), F.lit("9"))).when(case == 3, F.array(F.lit(" traces "))).otherwise(F.array(F.concat((k % 9 + 1).cast("string"), F.lit(".5")), F.lit("kcal")))
    )
    return d.events.select(F.col("user_id").alias("source_image"), k.alias("start"), entity.alias("entity"), words.alias("words"), F.col("value").alias("score"))


NORMAL = """
SELECT user_id, event_id, CASE event_id % 5 WHEN 0 THEN 'energy-kj_100g' WHEN 1 THEN 'saturated-fat_serving' WHEN 2 THEN 'serving_size' WHEN 3 THEN 'salt_100g' ELSE 'proteins_100g' END AS entity, t AS text,
  CASE event_id % 5 WHEN 0 THEN cast(event_id % 900 + 1 AS string) WHEN 1 THEN '< ' || cast(event_id % 9 AS string) WHEN 2 THEN cast(event_id % 90 + 1 AS string) || ' g' WHEN 3 THEN 'traces' ELSE cast(event_id % 9 + 1 AS string) || '.5' END AS value,
  CASE event_id % 5 WHEN 0 THEN 'kj' WHEN 1 THEN 'g' WHEN 4 THEN 'kcal' END AS unit, event_id % 5 <> 4 AS valid FROM en
"""


@query("entity_normalize", f"WITH {ENTITY_SQL} SELECT event_id AS start, entity, text, value, unit, valid FROM ({NORMAL})")
def _(d):
    return T.entity_normalize(entity_rows(d)).select("start", "entity", "text", "value", "unit", "valid")


@query("entity_multi_invalid", f"""
WITH {ENTITY_SQL}, n AS ({NORMAL}) SELECT event_id AS start, CASE WHEN count(*) OVER (PARTITION BY user_id, entity) > 1 THEN false ELSE valid END AS valid,
  CASE WHEN count(*) OVER (PARTITION BY user_id, entity) > 1 THEN 'multiple_entities' END AS invalid_reason FROM n
""")
def _(d):
    return T.entity_multi_invalid(T.entity_normalize(entity_rows(d))).select("start", "valid", "invalid_reason")


@query("token_aggregate", f"""
WITH t AS (SELECT user_id, event_id, event_id % 3 <> 0 AS sub, {LOGITS} AS l FROM events),
w AS (SELECT *, sum(CASE WHEN sub THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS w FROM t),
f AS (SELECT user_id, w, min(event_id) AS event_id, arg_min(l, event_id) AS l, arg_max(event_id, event_id) AS last FROM w GROUP BY user_id, w),
n AS (SELECT *, ['O', 'SALT', 'SALT', 'FAT', 'FAT'][list_position(l, list_max(l))] AS tag, ['O', 'B', 'I', 'B', 'I'][list_position(l, list_max(l))] AS bi, list_max(l) AS score FROM f),
g AS (SELECT *, sum(CASE WHEN bi = 'B' OR tag IS DISTINCT FROM ptag THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM (
  SELECT *, lag(tag) OVER (PARTITION BY user_id ORDER BY event_id) AS ptag FROM n))
SELECT user_id AS source_image, any_value(tag) AS entity_group, round(avg(score), 6) AS score, min(event_id) AS start, max(last) + 1 AS "end" FROM g GROUP BY user_id, grp
""")
def _(d):
    rows = event_tokens(d).select("source_image", "token_idx", (F.col("token_idx") % 3 != 0).alias("is_subword"), F.col("token_idx").alias("start"), (F.col("token_idx") + 1).alias("end"), F.col("logits").alias("scores"))
    return T.token_aggregate(rows, EVENT_LABELS, "first").withColumn("score", F.round("score", 6))


@query("ingredient_spans", """
SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ', organic farming' ELSE '' END AS ingredients FROM documents
""")
def _(d):
    """A whole text, extended by an organic phrase that follows in a third of them."""
    from larder.operators.extractors import extend_span_mentions

    follow = F.when(F.col("doc_id") % 3 == 0, F.lit(', * organic farming')).otherwise(F.lit(" x organic"))
    rows = d.documents.select("doc_id", F.concat("text", follow).alias("text"), F.length("text").alias("end"))
    out = extend_span_mentions(rows)
    return out.select("doc_id", F.replace(F.substring(F.col("text"), F.lit(1), F.col("end")), F.lit(", * organic"), F.lit(", organic")).alias("ingredients"))


@query("extend_span_mentions", """
SELECT doc_id, length(text) + CASE doc_id % 3 WHEN 0 THEN length('. Produits issus de l''agriculture bio, de cultivo ecologico certificado') WHEN 1 THEN length(' may contain nuts') ELSE 0 END AS "end" FROM documents
""")
def _(d):
    from larder.operators.extractors import extend_span_mentions

    tail = F.when(F.col("doc_id") % 3 == 0, ". Produits issus de l'agriculture bio, de cultivo ecologico certificado. fin").when(F.col("doc_id") % 3 == 1, " may contain nuts and more").otherwise(" .,")
    rows = d.documents.select("doc_id", F.length("text").alias("end"), F.concat("text", tail).alias("text"))
    return extend_span_mentions(rows, ["may contain nuts"]).select("doc_id", F.col("end").cast("long").alias("end"))


@query("known_ingredient_tags", """
SELECT doc_id, 'en:n' || cast(doc_id % 90 + 1 AS string) || CASE WHEN doc_id % 2 = 0 THEN ',en:n' || cast(doc_id % 30 + 1 AS string) ELSE '' END AS tags FROM documents
""")
def _(d):
    ids = F.array(F.concat(F.lit("EN:N"), (F.col("doc_id") % 90 + 1).cast("string")), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("en:n"), (F.col("doc_id") % 30 + 1).cast("string"))).otherwise("en:unknown thing"))
    out = T.known_ingredient_tags(d.documents.select("doc_id", ids.alias("ingredient_ids")), d.node, "doc_id")
    return out.select("doc_id", F.array_join("ingredient_tags", ",").alias("tags"))


def category_score_rows(d: Data):
    """Score arrays over eight labels per product."""
    labels = F.array(*[F.concat(F.lit("en:n"), (1 + (F.col("c_custkey") * (i + 1)) % 150).cast("string")) for i in range(8)])
    scores = F.array(*[((F.col("c_custkey") * (i + 3)) % 100) / 100 for i in range(8)])
    return d.product.select("code", scores.alias("scores"), labels.alias("labels"))


SCORES = "sc AS (SELECT code, unnest([" + ", ".join(f"'en:n' || cast(1 + (c_custkey * {i + 1}) % 150 AS string)" for i in range(8)) + "]) AS value_tag, unnest([" + ", ".join(f"((c_custkey * {i + 3}) % 100) / 100e0" for i in range(8)) + "]) AS confidence FROM product)"


@query("category_scores", f"WITH {SCORES} SELECT code, value_tag, confidence FROM sc WHERE confidence >= 0.5")
def _(d):
    return T.category_scores(category_score_rows(d))


@query("category_neighbor_scores", f"""
WITH {SCORES}, k AS (SELECT * FROM sc WHERE confidence >= 0.9), ed AS (SELECT DISTINCT parent, child FROM edge), kt AS (SELECT DISTINCT value_tag FROM k),
nb AS (SELECT value_tag, parent AS neighbor, 'parent' AS relation FROM kt JOIN edge ON child = value_tag UNION ALL SELECT value_tag, child, 'child' FROM kt JOIN edge ON parent = value_tag
  UNION ALL SELECT DISTINCT value_tag, b.child, 'sibling' FROM kt JOIN edge a ON a.child = value_tag JOIN edge b ON b.parent = a.parent WHERE b.child <> value_tag)
SELECT k.code, k.value_tag, nb.relation, nb.neighbor, s.confidence AS neighbor_score FROM k JOIN nb ON k.value_tag = nb.value_tag LEFT JOIN sc s ON s.code = k.code AND s.value_tag = nb.neighbor
""")
def _(d):
    scores = category_score_rows(d)
    return T.category_neighbor_scores(T.category_scores(scores, 0.9), scores, d.edge).select("code", "value_tag", "relation", "neighbor", "neighbor_score")


@query("category_deepest", f"""
WITH {CLOSURE}, {SCORES}, k AS (SELECT * FROM sc WHERE confidence >= 0.6 AND value_tag IN (SELECT id FROM node))
SELECT code, value_tag, confidence FROM k WHERE NOT EXISTS (SELECT 1 FROM k o JOIN up u ON o.value_tag = u.descendant WHERE o.code = k.code AND u.ancestor = k.value_tag)
""")
def _(d):
    rows = T.category_scores(category_score_rows(d), 0.6)
    return T.category_deepest(rows, d.node, closure(d, rows.select("value_tag"))).select("code", "value_tag", "confidence")


@query("pad_vectors", "SELECT c_custkey, 10 AS n, greatest(least(c_custkey % 13, 10), 1) AS ones FROM customer")
def _(d):
    vectors = F.transform(F.sequence(F.lit(1), F.col("c_custkey") % 13), lambda i: F.array_repeat(F.lit(1.0).cast("float"), 4))
    vectors = F.when(F.col("c_custkey") % 13 > 0, vectors)
    out = d.customer.select("c_custkey", T.pad_vectors(vectors, 10, 4).alias("p"))
    return out.select("c_custkey", F.size("p.vectors").alias("n"), F.aggregate("p.mask", F.lit(0), lambda s, x: s + x).cast("long").alias("ones"))


@query("nutriscore_label", """
SELECT l_orderkey AS image, CASE WHEN count(*) FILTER (score >= 0.8) = 1 THEN 'en:nutriscore-grade-' || ['a', 'b', 'c', 'd', 'e'][cast(min(idx % 5) FILTER (score >= 0.8) AS BIGINT) + 1] END AS label FROM logo GROUP BY l_orderkey
""")
def _(d):
    grade = F.concat(F.lit("nutriscore-"), F.array(*[F.lit(x) for x in "abcde"])[F.col("idx") % 5])
    rows = d.logo.groupBy("l_orderkey").agg(F.collect_list(F.struct("score", grade.alias("label"))).alias("objects"))
    return rows.select(F.col("l_orderkey").alias("image"), T.nutriscore_label(F.col("objects"), 0.8).alias("label"))


@query("upc_class", "SELECT id, CASE WHEN id % 4 = 0 THEN 'NO_UPC' WHEN (id % 90) * (id % 700) / (width * height * 1e0) > 0.09 THEN 'UPC_IMAGE' ELSE 'SMALL_UPC' END AS kind FROM image")
def _(d):
    area = F.when(F.col("id") % 4 != 0, ((F.col("id") % 90) * (F.col("id") % 700)).cast("double"))
    return d.image.select("id", T.upc_class(area, F.col("width"), F.col("height")).alias("kind"))


@query("detections_to_logos", """
SELECT l_orderkey AS image_prediction_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY id, score) - 1 AS INT) AS index, score, 'l' || cast(idx % 3 AS string) AS label FROM logo QUALIFY score > 0.1
""")
def _(d):
    rows = detections(d).select(F.col("image_id").cast("long").alias("id"), F.col("result").alias("objects"))
    return T.detections_to_logos(rows).select("image_prediction_id", "index", "score", "label")


@query("filter_logos")
def _(d):
    rows = detections(d).select("image_id", F.array_sort("result", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)).alias("objects"))
    return rows.select("image_id", F.explode(T.filter_logos(F.col("objects"), 0.2, 0.7)).alias("x")).select("image_id", "x.index", "x.logo.score")


@query("ingredient_entity_rows", """
SELECT id, round(least(1e0, 50e0 / height), 6) AS y1, round((id % 4) / 4e0, 6) AS fraction FROM image WHERE id % 3 <> 0
""")
def _(d):
    entity = F.struct(
        F.lit("water, salt").alias("text"), F.when(F.col("id") % 3 == 0, "fra").otherwise("fr").alias("lang"), F.lit(0.9).alias("score"),
        boxes.box(F.lit(0), F.lit(0), F.lit(50), F.lit(60)).alias("bounding_box"), F.lit(4).alias("ingredients_n"), (F.col("id") % 4).alias("known_ingredients_n"),
    )
    out = T.ingredient_entity_rows(d.image.withColumn("entities", F.array(entity)))
    return out.select("id", F.round(F.col("bounding_box")[2], 6).alias("y1"), F.round("fraction_known_ingredients", 6).alias("fraction"))


@query("nutrition_prediction_rows", f"""
WITH {ENTITY_SQL}, n AS ({NORMAL}), u AS (SELECT *, event_id // 5 AS img FROM n)
SELECT img AS source_image, string_agg(entity || '=' || value, ',' ORDER BY entity) FILTER (valid) AS nutrients, count(*) AS n_entities FROM u GROUP BY img HAVING count(*) FILTER (valid) > 0
""")
def _(d):
    rows = entity_rows(d).withColumn("source_image", F.floor(F.col("start") / 5))
    out = T.nutrition_prediction_rows(T.entity_normalize(rows))
    pairs = F.array_sort(F.transform(F.map_entries("nutrients"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"])))
    return out.select("source_image", F.array_join(pairs, ",").alias("nutrients"), F.size("entities").cast("long").alias("n_entities"))


@query("batch_score", "SELECT id, width * height AS area FROM image")
def _(d):
    def scorer(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "area": (pdf["width"] * pdf["height"]).astype("int64")})

    return T.batch_score(d.image.select("id", "width", "height"), scorer, "id long, area long")


@query("score_missing_only", """
SELECT id, round((id % 10) / 10e0, 6) AS max_confidence, 'nutriscore' AS model_name FROM image i WHERE NOT EXISTS (SELECT 1 FROM image_prediction p WHERE p.image_id = i.id AND p.model_name = 'nutriscore')
""")
def _(d):
    def scorer(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "objects": [[{"score": float(i % 10) / 10, "label": "x"}] for i in pdf["id"]]})

    out = T.score_missing_only(d.image.select("id"), d.image_prediction, "nutriscore", "v1", scorer, "id long, objects array<struct<score:double,label:string>>")
    return out.select("id", F.round("max_confidence", 6).alias("max_confidence"), "model_name")


@query("category_run", f"""
WITH {SCORES} SELECT s.code AS barcode, s.value_tag, s.confidence FROM sc s JOIN product p ON s.code = p.code
WHERE p.schema_version >= 1003 AND p.server_type = 'off' AND s.confidence >= 0.5 AND s.value_tag IN (SELECT id FROM node)
""")
def _(d):
    from larder.plans.flows import category_run

    def scorer(batches):
        for pdf in batches:
            yield pd.DataFrame({
                "code": pdf["code"],
                "scores": [[((k * (i + 3)) % 100) / 100 for i in range(8)] for k in pdf["c_custkey"]],
                "labels": [[f"en:n{1 + (k * (i + 1)) % 150}" for i in range(8)] for k in pdf["c_custkey"]],
            })

    products = d.product.select("code", "c_custkey", "server_type", "schema_version")
    return category_run(products, scorer, d.node, None, "model-3").select("barcode", "value_tag", "confidence")


@query("classify_top", "SELECT c_custkey, CASE WHEN c_custkey % 10 >= 5 THEN 'a' ELSE 'b' END AS label FROM customer")
def _(d):
    a = (F.col("c_custkey") % 10) / 10
    best = T.classify_top(F.array(F.lit("b"), F.lit("a")), F.array(F.lit(0.45), a))
    return d.customer.select("c_custkey", best[0]["label"].alias("label"))


