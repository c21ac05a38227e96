"""Candidate insights per type.

Input: prediction rows (``data`` is a JSON string) and catalogue rows from
``product_defaults`` keyed by ``code``.  Output: candidate rows ready for
``changeset.merge_candidates`` with the key columns named in ``CONFLICT_KEYS``.
``products=None`` switches the catalogue checks off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder import fixed
from larder.functions import boxes, measures, paths, text
from larder.functions.binding import bind
from larder.operators import ranking, taxonomy
from larder.operators.dedup import required_types_superset
from larder.operators.joins import brand_range_join
from larder.operators.keys import keyed_products, product_key

PRODUCT = ["barcode", "server_type"]

CONFLICT_KEYS = {
    "packager_code": ["value"],
    "label": ["value_tag"],
    "category": ["value_tag"],
    "product_weight": ["value"],
    "expiration_date": ["value"],
    "brand": ["value_tag"],
    "store": ["value_tag"],
    "is_upc_image": ["source_image"],
    "nutrition_image": ["value_tag"],
    "ingredient_spellcheck": ["value_tag"],
    "ingredient_detection": ["value_tag"],
    "packaging": ["shape_tag"],
    "image_orientation": ["image_key", "source_image"],
}


def json_field(path: str, kind: str = "string", column: str = "data") -> Column:
    return F.get_json_object(F.col(column), f"$.{path}").try_cast(kind)


def of_type(predictions: DataFrame, type: str) -> DataFrame:
    return predictions.where(F.col("type") == type)


def with_priority(df: DataFrame) -> DataFrame:
    return df if "priority" in df.columns else df.withColumn("priority", F.coalesce(json_field("priority", "int"), F.lit(1)))


def with_product(df: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    return df.join(keyed_products(df, products, *columns), product_key(df, products))


def cand_packager_code(predictions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Codes the product does not carry yet in any spelling."""
    rows = with_priority(of_type(predictions, "packager_code"))
    if products is None:
        return rows
    rows = with_product(rows, products).withColumn("__code", text.emb_code(F.col("value")))
    key = product_key(rows, products)
    owned = keyed_products(rows, products, F.explode("emb_codes_tags").alias("c")).select(*key, text.emb_code(F.col("c")).alias("__code"))
    return rows.join(owned, [*key, "__code"], "left_anti").drop("__code")


def _without_product_tags(rows: DataFrame, products: DataFrame, column: str, closure: DataFrame) -> DataFrame:
    """Rows whose tag is neither one of the product's nor an ancestor of one."""
    key = product_key(rows, products)
    own = keyed_products(rows, products, F.explode(column).alias("value_tag"))
    above = taxonomy.tags_above(own, closure, key, "value_tag").withColumnRenamed("__tags", "__above")
    tags = own.groupBy(*key).agg(F.collect_set("value_tag").alias("__own"))
    among = lambda tags: F.coalesce(F.array_contains(tags, F.col("value_tag")), F.lit(False))
    return rows.join(tags, key, "left").join(above, key, "left").where(~among("__own") & ~among("__above")).drop("__own", "__above")


def cand_label(predictions: DataFrame, nodes: DataFrame, synonyms: DataFrame, closure: DataFrame, authorized: DataFrame,
               products: DataFrame | None = None) -> DataFrame:
    """Labels that add information, canonical and deepest only.

    The check against the product uses the raw tag, before canonicalisation.
    """
    rows = with_priority(of_type(predictions, "label"))
    if products is not None:
        rows = with_product(rows, products)
        rows = rows.where(~F.coalesce(F.col("value_tag").isin(fixed.LABELS_DISABLED), F.lit(False)))
        rows = _without_product_tags(rows, products, "labels_tags", closure)
    rows = taxonomy.canonical_tag(rows, nodes, synonyms)
    rows = rows.where(F.col("canonical").isNotNull()).withColumn("value_tag", F.col("canonical")).drop("canonical")
    rows = taxonomy.deepest_nodes(rows, closure, PRODUCT)
    allowed = authorized.select("value_tag", F.lit(True).alias("__ok")).distinct()
    rows = rows.join(allowed, "value_tag", "left")
    automatic = F.when(
        F.col("automatic_processing").isNull() & F.col("predictor").isin("flashtext", "regex"), F.coalesce("__ok", F.lit(False))
    ).otherwise(F.col("automatic_processing"))
    return rows.withColumn("automatic_processing", automatic).drop("__ok")


def cand_category(predictions: DataFrame, nodes: DataFrame, synonyms: DataFrame, closure: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Canonical categories the product does not have or imply; deepest only; campaigns.

    ``nodes``: (id, properties map).
    """
    rows = taxonomy.canonical_tag(with_priority(of_type(predictions, "category")), nodes, synonyms)
    rows = rows.where(F.col("canonical").isNotNull()).withColumn("value_tag", F.col("canonical")).drop("canonical")
    missing = F.lit(False)
    if products is not None:
        rows = with_product(rows, products, "categories_tags")
        rows = _without_product_tags(rows, products, "categories_tags", closure)
        missing = F.size("categories_tags") == 0
    rows = taxonomy.deepest_nodes(rows, closure, PRODUCT)
    linked = nodes.select(F.col("id").alias("value_tag"), F.map_contains_key("properties", "agribalyse_food_code").alias("__agri"))
    rows = rows.join(linked, "value_tag", "left")
    campaign = F.array_compact(
        F.array(F.when(F.col("__agri"), F.lit("agribalyse-category")), F.when(missing, F.lit("missing-category")))
    )
    return rows.withColumn("campaign", campaign).drop("__agri", "categories_tags")


def cand_product_weight(predictions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Best prediction of products without quantity.

    Not automatic when its matcher subtype found several values or it comes from the
    product name.  Aggregates per (product, subtype) are small, so no window holds a
    product's predictions.
    """
    rows = with_priority(of_type(predictions, "product_weight"))
    rows = rows.withColumns({"matcher_type": json_field("matcher_type"), "name_source": json_field("source")})
    if products is not None:
        rows = with_product(rows, products, "quantity").where(F.col("quantity").isNull()).drop("quantity")
    best = ranking.first_per_product(rows)
    spread = rows.groupBy(*PRODUCT, "matcher_type").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    joined = best.join(spread, [*PRODUCT, "matcher_type"], "left")
    doubtful = (F.col("__lo") != F.col("__hi")) | F.coalesce(F.col("name_source") == "product_name", F.lit(False))
    return joined.withColumn(
        "automatic_processing", F.when(doubtful, False).otherwise(F.col("automatic_processing"))
    ).drop("__lo", "__hi", "name_source")


def cand_expiration_date(predictions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    rows = with_priority(of_type(predictions, "expiration_date"))
    if products is not None:
        rows = with_product(rows, products, "expiration_date").where(F.col("expiration_date").isNull()).drop("expiration_date")
    return ranking.latest_value(rows)


def cand_brand(predictions: DataFrame, prefixes: DataFrame, blacklist: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Brands of products without one, inside the brand's barcode range."""
    rows = with_priority(of_type(predictions, "brand"))
    if products is not None:
        rows = with_product(rows, products, "brands_tags").where(F.size("brands_tags") == 0).drop("brands_tags")
    rows = brand_range_join(rows, prefixes, blacklist).where("brand_allowed").drop("brand_allowed")
    named = F.coalesce(json_field("source") == "product_name", F.lit(False))
    return rows.withColumn("automatic_processing", F.coalesce("automatic_processing", named))


def cand_store(predictions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    rows = with_priority(of_type(predictions, "store")).withColumn("automatic_processing", F.lit(True))
    return rows if products is None else with_product(rows, products)


def cand_upc_image(predictions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Barcode images that some selected image uses."""
    rows = with_priority(of_type(predictions, "is_upc_image")).withColumn("__img", paths.image_id(F.col("source_image")))
    rows = rows.where(F.col("__img").isNotNull())
    if products is not None:
        rows = with_product(rows, products, "images")
        used = F.exists(
            F.map_entries("images"), lambda e: ~e["key"].rlike("^[0-9]+$") & (e["value"]["imgid"] == F.col("__img"))
        )
        rows = rows.where(F.map_contains_key("images", F.col("__img")) & F.coalesce(used, F.lit(False))).drop("images")
    return rows.drop("__img")


_MENTION = "array<struct<raw:string,languages:array<string>,bounding_box_absolute:array<double>>>"


def cand_nutrition_image(predictions: DataFrame, tables: DataFrame, products: DataFrame | None = None,
                         min_mentions: int = 4, min_values: int = 3, margin: float = 10.0) -> DataFrame:
    """Images that show a nutrition table in the product's main language.

    Needs a mention and an orientation prediction of the image; ``tables`` holds
    (source_image, objects) of the table detector.
    """
    image = [*PRODUCT, "source_image"]
    rows = predictions.where(F.col("source_image").isNotNull() & F.col("type").isin("nutrient_mention", "nutrient", "image_orientation"))
    complete = required_types_superset(rows, fixed.REQUIRED_TYPES["nutrition_image"], image)
    first = ranking.best_per(with_priority(rows), [*image, "type"], ranking.prediction_order()).join(complete, image, "left_semi")
    wide = first.groupBy(*image).agg(
        F.max(F.when(F.col("type") == "nutrient_mention", F.struct("id", "data"))).alias("mention"),
        F.max(F.when(F.col("type") == "image_orientation", F.get_json_object("data", "$.rotation"))).cast("int").alias("rotation"),
        F.max(F.when(F.col("type") == "nutrient", F.col("id"))).alias("nutrient_id"),
    )
    mentions = F.from_json(F.get_json_object(F.col("mention.data"), "$.mentions"), f"map<string,{_MENTION}>")
    wide = wide.withColumn("mentions", mentions)
    values = F.coalesce(F.try_element_at("mentions", F.lit("nutrient_value")), F.from_json(F.lit("[]"), _MENTION))
    energy = F.exists(values, lambda v: F.lower(v["raw"]).rlike("kcal|kj"))
    wide = wide.where((F.size(values) >= min_values) & energy)
    objects = tables.select(
        "source_image", F.filter("objects", lambda o: (o["label"] == "nutrition-table") & (o["score"] >= 0.8)).alias("tables")
    )
    wide = wide.join(objects, "source_image", "left")
    one = F.size("tables") == 1
    all_boxes = F.filter(
        F.transform(F.flatten(F.map_values("mentions")), lambda m: m["bounding_box_absolute"]), lambda b: b.isNotNull()
    )
    wide = wide.withColumns(
        {
            "bounding_box": F.when(one, F.col("tables")[0]["bounding_box"]),
            "crop_score": F.when(one, F.col("tables")[0]["score"]),
            "bounding_box_absolute": F.when(F.coalesce(~one, F.lit(True)), boxes.union_box(all_boxes, margin)),
        }
    )
    named = F.map_filter("mentions", lambda k, v: k != "nutrient_value")
    pairs = F.flatten(
        F.transform(
            F.map_entries(named),
            lambda e: F.transform(F.array_distinct(F.flatten(F.transform(e["value"], lambda m: m["languages"]))), lambda lang: F.struct(lang.alias("lang"), e["key"].alias("nutrient"))),
        )
    )
    keep = [*image, "rotation", "nutrient_id", F.col("mention.id").alias("id"), "bounding_box", "crop_score", "bounding_box_absolute"]

    def by_language(found: Column) -> Column:
        langs = F.array_distinct(F.transform(found, lambda p: p["lang"]))
        return F.transform(
            langs, lambda lang: F.struct(lang.alias("value_tag"), F.transform(F.filter(found, lambda p: p["lang"] == lang), lambda p: p["nutrient"]).alias("nutrients"))
        )

    per_lang = bind(pairs, by_language)
    out = wide.select(*keep, F.explode(per_lang).alias("l")).select("*", "l.*").drop("l").where(F.size("nutrients") >= min_mentions)
    out = out.withColumns(
        {
            "type": F.lit("nutrition_image"), "priority": F.when(F.col("nutrient_id").isNull(), 2).otherwise(1),
            "automatic_processing": F.lit(True), "predictor": F.lit(None).cast("string"), "predictor_version": F.lit("1"),
        }
    )
    if products is None:
        return out
    out = with_product(out, products, "lang", "images")
    taken = F.map_contains_key("images", F.concat(F.lit("nutrition_"), F.col("value_tag")))
    return out.where((F.col("value_tag") == F.col("lang")) & ~F.coalesce(taken, F.lit(False))).drop("lang", "images")


def cand_ingredient_spellcheck(predictions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    rows = with_priority(of_type(predictions, "ingredient_spellcheck")).withColumns(
        {"original": json_field("original"), "correction": json_field("correction"), "lc": F.array("value_tag")}
    )
    rows = rows.where(F.col("original") != F.col("correction"))
    if products is None:
        return rows
    rows = with_product(rows, products, "lang", "ingredients_text")
    current = F.try_element_at("ingredients_text", F.col("value_tag"))
    return rows.where((F.col("original") == current) & (F.col("value_tag") == F.col("lang"))).drop("lang", "ingredients_text")


def mention_languages(mentions: Column) -> Column:
    """Languages with two mentions or more, else the first one seen."""

    def chosen(langs: Column) -> Column:
        twice = F.filter(F.array_distinct(langs), lambda lang: F.size(F.filter(langs, lambda x: x == lang)) >= 2)
        return F.when(F.size(twice) > 0, twice).when(F.size(langs) > 0, F.slice(langs, 1, 1))

    none = F.array().cast("array<string>")
    return bind(F.flatten(F.transform(F.flatten(F.map_values(mentions)), lambda m: F.coalesce(m["languages"], none))), chosen)


def _input_nutrient(sets: Column, nutrient: Column, per: Column | str) -> Column:
    """Value/unit of a nutrient in the packaging input set of one per."""
    hit = F.filter(sets, lambda s: (s["per"] == per) & (s["source"] == "packaging") & F.map_contains_key(s["nutrients"], nutrient))
    return F.try_element_at(F.try_element_at(hit, F.lit(1))["nutrients"], nutrient)


def nutrients_bring_news(nutrients: Column, sets: Column, serving_size: Column) -> Column:
    """Some predicted value differs from the stored one, or a missing serving size comes in."""

    # bound, so that each nutrient's stored value is looked up once and not wherever it is compared
    def differs(e: Column, sets: Column) -> Column:
        key = e["key"]
        per = F.when(key.endswith("_100g"), "100g").otherwise("serving")

        def stored(name: Column) -> Column:
            return F.coalesce(_input_nutrient(sets, name, per), F.when(per == "100g", _input_nutrient(sets, name, "100ml")))

        found = bind(F.regexp_replace(key, "_100g$|_serving", ""), stored)
        return bind(found, lambda own: ~measures.equal_nutrient(e["value"]["value"], e["value"]["unit"], own["value"], own["unit"]))

    def news(nutrients: Column, sets: Column) -> Column:
        serving = F.exists(sets, lambda s: (s["per"] == "serving") & (s["source"] == "packaging"))
        brings = serving & (F.coalesce(serving_size, F.lit("")) == "") & F.map_contains_key(nutrients, F.lit("serving_size"))
        return F.exists(F.map_entries(nutrients), lambda e: differs(e, sets)) | F.coalesce(brings, F.lit(False))

    return bind(nutrients, lambda found: bind(sets, lambda own: news(found, own)))


def cand_nutrient_extraction(predictions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Extractions that add or correct nutrition, with rotation, languages and campaign."""
    rows = with_priority(of_type(predictions, "nutrient_extraction"))
    side = with_priority(predictions.where(F.col("type").isin("image_orientation", "nutrient_mention")))
    first = ranking.best_per(side, [*PRODUCT, "type"], ranking.prediction_order())
    mentions = F.from_json(F.get_json_object("data", "$.mentions"), f"map<string,{_MENTION}>")
    extra = first.groupBy(*PRODUCT).agg(
        F.max(F.when(F.col("type") == "image_orientation", F.get_json_object("data", "$.rotation"))).cast("int").alias("rotation"),
        F.max(F.when(F.col("type") == "nutrient_mention", mention_languages(mentions))).alias("lc"),
    )
    rows = rows.join(extra, PRODUCT, "left")
    nutrients = F.from_json(F.get_json_object("data", "$.nutrients"), "map<string,struct<value:string,unit:string>>")
    if products is None:
        return rows
    rows = with_product(rows, products, "nutrition", "serving_size", "schema_version").where(F.col("schema_version") >= 1003)
    sets = F.col("nutrition.input_sets")
    empty = F.col("nutrition").isNull()
    prepared = F.coalesce(F.exists(sets, lambda s: s["preparation"] == "prepared"), F.lit(False))
    news = nutrients_bring_news(nutrients, F.coalesce(sets, F.array().cast("array<struct<nutrients:map<string,struct<value:string,unit:string>>,per:string,preparation:string,source:string>>")), F.col("serving_size"))
    rows = rows.where(empty | (~prepared & news))
    has_sets = F.coalesce(F.size(sets), F.lit(0)) > 0
    campaign = F.array(F.when(has_sets, "incomplete-nutrition").otherwise("missing-nutrition"))
    return rows.withColumn("campaign", campaign).drop("nutrition", "serving_size", "schema_version")


def cand_ingredient_detection(predictions: DataFrame, products: DataFrame | None = None, min_known: float = 0.6) -> DataFrame:
    """Ingredient lists for languages without text and mostly known ingredients.

    A selected photo sets priority 2 and therefore ranks after priority 1; the order is
    kept as it is and shown in ``from_selected_photo``.
    """
    rows = of_type(predictions, "ingredient_detection").withColumns(
        {"known_fraction": json_field("fraction_known_ingredients", "double"), "lc": F.array("value_tag")}
    )
    side = with_priority(of_type(predictions, "image_orientation"))
    turn = ranking.best_per(side, PRODUCT, ranking.prediction_order()).select(*PRODUCT, json_field("rotation", "int").alias("rotation"))
    rows = rows.join(turn, PRODUCT, "left")
    if products is None:
        return rows.withColumns({"priority": F.lit(1), "from_selected_photo": F.lit(False)})
    rows = with_product(rows, products, "ingredients_text", "images")
    current = F.try_element_at("ingredients_text", F.col("value_tag"))
    rows = rows.where(current.isNull() & ~F.coalesce(F.col("known_fraction") < min_known, F.lit(False)))
    photo = F.try_element_at("images", F.concat(F.lit("ingredients_"), F.col("value_tag")))["imgid"]
    selected = F.coalesce(photo == paths.image_id(F.col("source_image")), F.lit(False))
    return rows.withColumns({"priority": F.when(selected, 2).otherwise(1), "from_selected_photo": selected}).drop("ingredients_text", "images")


PROPERTIES = ["shape", "material", "recycling"]


def cand_packaging(predictions: DataFrame, closures: dict[str, DataFrame], nodes: dict[str, DataFrame], products: DataFrame | None = None) -> DataFrame:
    """Packaging elements that say more than the product's own elements.

    ``closures``/``nodes`` per property.  The element tags are columns ``shape_tag``,
    ``material_tag``, ``recycling_tag`` read from ``data.element``.
    """
    rows = of_type(predictions, "packaging")
    for p in PROPERTIES:
        rows = rows.withColumn(f"{p}_tag", json_field(f"element.{p}.value_tag"))
    has = {p: F.get_json_object("data", f"$.element.{p}").isNotNull() for p in PROPERTIES}
    rows = rows.withColumn("n_properties", sum((has[p].cast("int") for p in PROPERTIES), F.lit(0)))
    excluded = F.col("shape_tag").isNull() | F.col("shape_tag").isin(fixed.SHAPE_ONLY_EXCLUDED)
    alone = F.col("material_tag").isNull() & F.col("recycling_tag").isNull()
    rows = rows.where(has["shape"] & ~(excluded & alone)).withColumn("priority", F.lit(1))
    if products is None:
        return rows
    # a row for each element of the product, the first of them is the row itself
    pairs = with_product(rows, products, "packagings").select("*", F.posexplode_outer("packagings").alias("el", "e")).drop("packagings")
    pairs = pairs.select(*rows.columns, "el", *[F.col(f"e.{p}").alias(f"ref_{p}") for p in PROPERTIES])
    verdict = None
    for p in PROPERTIES:
        cand, ref = F.col(f"{p}_tag"), F.col(f"ref_{p}")
        known = nodes[p].select("id").distinct()
        pairs = (
            pairs.join(known.select(F.col("id").alias(f"{p}_tag"), F.lit(True).alias(f"ck_{p}")), f"{p}_tag", "left")
            .join(known.select(F.col("id").alias(f"ref_{p}"), F.lit(True).alias(f"rk_{p}")), f"ref_{p}", "left")
            .join(closures[p].select(F.col("ancestor").alias(f"ref_{p}"), F.col("descendant").alias(f"{p}_tag"), F.lit(True).alias(f"finer_{p}")), [f"ref_{p}", f"{p}_tag"], "left")
        )
        # what this property alone decides: keep, drop, or go on to the next property
        step = (
            F.when(cand.isNull(), "next").when(ref.isNull(), "keep").when(F.col(f"ck_{p}").isNull(), "drop")
            .when(F.col(f"rk_{p}").isNull(), "keep").when(F.col(f"finer_{p}").isNotNull(), "keep").otherwise("next")
        )
        verdict = step if verdict is None else F.when(verdict == "next", step).otherwise(verdict)
    shape = closures["shape"].select(F.col("ancestor").alias("shape_tag"), F.col("descendant").alias("ref_shape"), F.lit(True).alias("broader"))
    pairs = pairs.join(shape, ["shape_tag", "ref_shape"], "left")
    covered = F.coalesce(F.col("broader"), F.lit(False)) | F.coalesce(F.col("shape_tag") == F.col("ref_shape"), F.lit(False))
    drop = F.col("el").isNotNull() & ((verdict == "drop") | ((verdict == "next") & covered))
    own = Window.partitionBy(*product_key(rows, products), "id")
    pairs = pairs.withColumn("__dropped", F.bool_or(F.coalesce(drop, F.lit(False))).over(own) & F.col("id").isNotNull())
    return pairs.where((F.coalesce("el", F.lit(0)) == 0) & ~F.col("__dropped")).select(*rows.columns)


def cand_image_orientation(predictions: DataFrame, products: DataFrame, min_share: float = 0.95, min_words: int = 10) -> DataFrame:
    """One row per selected image whose angle differs from the detected rotation."""
    rows = with_priority(of_type(predictions, "image_orientation")).withColumns(
        {
            "orientation": json_field("orientation"), "rotation": json_field("rotation", "int"),
            "counts": F.from_json(F.get_json_object("data", "$.count"), "map<string,long>"),
        }
    )
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, v: s + v)
    share = F.coalesce(F.try_element_at("counts", F.col("orientation")), F.lit(0)) / total
    upright = F.coalesce(F.col("orientation") == "up", F.lit(False)) | F.coalesce(F.col("rotation") == 0, F.lit(False))
    rows = rows.withColumns({"total_words": total}).where(~upright & (F.col("total_words") > 0)).withColumn("confidence", share)
    rows = rows.withColumn("__img", paths.image_id(F.col("source_image"))).where(F.col("__img").isNotNull() & (F.col("confidence") >= min_share))
    rows = with_product(rows, products, "images")
    out = rows.select("*", F.explode("images").alias("image_key", "meta")).drop("images")
    raw = F.coalesce(F.nullif(F.col("meta.angle"), F.lit("")), F.lit("0")).try_cast("int")
    angle = F.when(raw < 0, raw + 360).otherwise(raw)
    selected = F.col("image_key").rlike("^(front|ingredients|nutrition|packaging)") & (F.col("meta.imgid") == F.col("__img"))
    out = out.where(selected & (angle != F.col("rotation")))
    return out.withColumns(
        {"image_rev": F.col("meta.rev"), "value_tag": F.col("orientation"), "automatic_processing": F.col("total_words") >= min_words}
    ).drop("meta", "__img", "counts")
