"""Votes, annotation state and outcomes.

Nothing is sent anywhere: an outcome row says what an update would carry
(``status``, ``status_code``, ``payload``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions import boxes, measures, paths, text
from larder.operators.aggregates import vote_tally
from larder.operators.keys import keyed_products, product_key


def vote_resolve(votes: DataFrame) -> DataFrame:
    """Decision per insight from its 0/1/2 votes.

    Top value with three votes applies; top and second both with two or more is
    ambiguous (-1) and overrides.  Votes per value are summed first, so an insight with
    millions of votes still reaches the decision as at most three rows.
    """
    tally = vote_tally(votes)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("num_votes")).alias("neg"), F.col("value").alias("value"))))
    tops = tally.groupBy("insight_id").agg(F.sum("num_votes").alias("n_votes"), ordered.alias("v"))
    first, second = F.try_element_at("v", F.lit(1)), F.try_element_at("v", F.lit(2))
    decision = (
        F.when((-first["neg"] >= 2) & F.coalesce(-second["neg"] >= 2, F.lit(False)), F.lit(-1))
        .when(-first["neg"] >= 3, first["value"])
    )
    return tops.select("insight_id", "n_votes", decision.cast("int").alias("annotation"), decision.isNotNull().alias("verified"))


def vote_requests(requests: DataFrame, insights: DataFrame, votes: DataFrame) -> DataFrame:
    """Incoming annotation requests to their status.

    ``requests``: (insight_id, annotation, trusted).  Unknown and annotated insights are
    refused; untrusted requests and any -1 are votes, decided with the stored votes.
    """
    known = insights.select(F.col("id").alias("insight_id"), F.col("annotation").alias("stored"), F.lit(True).alias("known"))
    is_vote = ~F.col("trusted") | (F.col("annotation") == -1)
    rows = requests.join(known, "insight_id", "left").withColumn("is_vote", is_vote)
    cast = rows.where("is_vote and known and stored is null").select("insight_id", F.col("annotation").alias("value"))
    # resolve only insights that just got a vote
    touched = cast.select("insight_id").distinct()
    pool = votes.join(touched, "insight_id", "left_semi").select("insight_id", "value").unionByName(cast)
    resolved = vote_resolve(pool).select("insight_id", "n_votes", F.col("annotation").alias("resolved"), "verified")
    out = rows.join(resolved, "insight_id", "left")
    applied = F.when(F.col("is_vote"), F.col("resolved")).otherwise(F.col("annotation"))
    status = (
        F.when(F.col("known").isNull(), "error_unknown_insight")
        .when(F.col("stored").isNotNull(), "error_already_annotated")
        .when(F.col("is_vote") & ~F.coalesce("verified", F.lit(False)), "vote_saved")
    )
    return out.withColumns({"status": status, "applied": F.when(status.isNull(), applied)})


def due_automatic(insights: DataFrame, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return insights.where(F.col("annotation").isNull() & (F.col("process_after") <= now))


def status_code(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.OUTCOME_CODES.items() for x in kv]), status)


def annotation_state(requests: DataFrame, now: Column | None = None) -> DataFrame:
    """Base transition of an insight row: data/annotation compatibility and saved columns.

    ``requests``: insight columns plus ``new_annotation``, ``has_data``, ``update``,
    ``user`` and ``outcome`` (status of the update for annotations 1 and 2).
    """
    now = F.current_timestamp() if now is None else now
    two = F.col("new_annotation") == 2
    bad = two != F.col("has_data")
    processed = F.col("new_annotation").isin(1, 2) & F.col("update")
    status = F.when(bad, "error_invalid_data").when(processed, F.col("outcome")).otherwise("saved")
    out = requests.withColumn("status", status)
    stored = F.col("status").isin(fixed.OUTCOMES_STORED)
    # a row to process is saved before its update is tried, whatever comes out of it
    saved = ~bad & (processed | stored)
    return out.withColumns(
        {
            "status_code": status_code(F.col("status")),
            "annotation": F.when(saved, F.col("new_annotation")),
            "username": F.when(saved, F.col("user")),
            "completed_at": F.when(saved, now),
            "annotated_result": F.when(~bad & stored, status_code(F.col("status"))),
        }
    )


def _with_product(insights: DataFrame, products: DataFrame, *columns: str) -> DataFrame:
    right = keyed_products(insights, products, F.lit(True).alias("found"), *[F.col(c).alias("p_" + c) for c in columns])
    return insights.join(right, product_key(insights, products), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _finish(rows: DataFrame, status: Column, payload: Column, drop: Sequence[str] = ()) -> DataFrame:
    """Missing product first; the payload only with an update."""
    full = F.when(~F.col("found"), "error_missing_product").otherwise(status)
    sent = full.isin("updated", "user_input_updated")
    return rows.select("id", "barcode", "type", full.alias("status"), F.when(sent, F.to_json(payload)).alias("payload"))


def outcome_packager_code(insights: DataFrame, products: DataFrame) -> DataFrame:
    """Append the code unless an equal spelling is there (``emb_codes`` is comma text)."""
    rows = _with_product(insights, products, "emb_codes").withColumn("__code", text.emb_code(F.col("value")))
    key = product_key(insights, products)
    owned = keyed_products(insights, products, F.explode(F.split("emb_codes", ",")).alias("c")).where("c <> ''")
    owned = owned.select(*key, text.emb_code(F.col("c")).alias("__code"), F.lit(True).alias("owned")).distinct()
    rows = rows.join(owned, [*key, "__code"], "left")
    status = F.when(F.col("owned"), "error_already_annotated").otherwise("updated")
    codes = F.concat_ws(",", F.nullif(F.col("p_emb_codes"), F.lit("")), F.col("value"))
    return _finish(rows, status, F.struct(codes.alias("emb_codes")))


def _add_tag(insights: DataFrame, products: DataFrame, column: str, field: str, value: str) -> DataFrame:
    rows = _with_product(insights, products, column)
    there = F.coalesce(F.array_contains("p_" + column, F.col("value_tag")), F.lit(False))
    return _finish(rows, F.when(there, "error_already_annotated").otherwise("updated"), F.struct(F.col(value).alias(field)))


def outcome_label(insights: DataFrame, products: DataFrame) -> DataFrame:
    return _add_tag(insights, products, "labels_tags", "add_labels", "value_tag")


def outcome_store(insights: DataFrame, products: DataFrame) -> DataFrame:
    return _add_tag(insights, products, "stores_tags", "add_stores", "value")


def outcome_category(insights: DataFrame, products: DataFrame) -> DataFrame:
    """A user value (``user_value_tag``) replaces the predicted one; the original is kept."""
    rows = _with_product(insights, products, "categories_tags")
    user = F.col("user_value_tag") if "user_value_tag" in insights.columns else F.lit(None).cast("string")
    tag = F.coalesce(user, F.col("value_tag"))
    there = F.coalesce(F.array_contains("p_categories_tags", tag), F.lit(False))
    status = F.when(there, "error_already_annotated").when(user.isNotNull(), "user_input_updated").otherwise("updated")
    payload = F.struct(
        tag.alias("add_categories"), F.when(user.isNotNull(), F.col("value_tag")).alias("original_value_tag"),
        F.when(user.isNotNull(), F.lit(True)).alias("user_input"),
    )
    return _finish(rows, status, payload)


def _set_empty(insights: DataFrame, products: DataFrame, column: str) -> DataFrame:
    rows = _with_product(insights, products, column)
    there = F.coalesce(F.col("p_" + column), F.lit("")) != ""
    return _finish(rows, F.when(there, "error_already_annotated").otherwise("updated"), F.struct(F.col("value").alias(column)))


def outcome_product_weight(insights: DataFrame, products: DataFrame) -> DataFrame:
    return _set_empty(insights, products, "quantity")


def outcome_expiration_date(insights: DataFrame, products: DataFrame) -> DataFrame:
    return _set_empty(insights, products, "expiration_date")


def outcome_brand(insights: DataFrame, products: DataFrame) -> DataFrame:
    """Added without a duplicate check."""
    return _finish(_with_product(insights, products), F.lit("updated"), F.struct(F.col("value").alias("add_brands")))


def outcome_packaging(insights: DataFrame, products: DataFrame) -> DataFrame:
    element = F.get_json_object("data", "$.element")
    return _finish(_with_product(insights, products), F.lit("updated"), F.struct(element.alias("add_packaging")))


def _meta(images: Column, key: Column) -> Column:
    return F.try_element_at(images, key)


def _full_size(meta: Column) -> Column:
    return F.try_element_at(meta["sizes"], F.lit("full"))


def outcome_upc_image(insights: DataFrame, products: DataFrame) -> DataFrame:
    """Selected image keys that use this image, to be unselected."""
    rows = _with_product(insights, products, "images").withColumn("__img", paths.image_id(F.col("source_image")))
    known = F.coalesce(F.map_contains_key("p_images", F.col("__img")), F.lit(False))
    using = F.filter(F.map_entries("p_images"), lambda e: ~e["key"].rlike("^[0-9]+$") & (e["value"]["imgid"] == F.col("__img")))
    keys = F.array_sort(F.transform(using, lambda e: e["key"]))
    return _finish(rows, F.when(known, "updated").otherwise("error_failed_update"), F.struct(keys.alias("unselect")))


def outcome_nutrition_image(insights: DataFrame, products: DataFrame) -> DataFrame:
    """Select the image for the language with rotation and rotated absolute crop."""
    rows = _with_product(insights, products, "images").withColumn("__img", paths.image_id(F.col("source_image")))
    meta = _meta(F.col("p_images"), F.col("__img"))
    key = F.concat(F.lit("nutrition_"), F.col("value_tag"))
    rotation = F.coalesce(F.get_json_object("data", "$.rotation").cast("int"), F.lit(0))
    size = _full_size(meta)
    crop = F.when(F.col("bounding_box").isNotNull(), boxes.crop(F.col("bounding_box"), size["w"], size["h"], rotation))
    status = (
        F.when(F.col("__img").isNull() | meta.isNull(), "error_invalid_image")
        .when(F.map_contains_key("p_images", key), "error_already_annotated")
        .otherwise("updated")
    )
    return _finish(rows, status, F.struct(F.col("__img").alias("image_id"), key.alias("image_key"), rotation.alias("rotate"), crop.alias("crop")))


def outcome_ingredient_spellcheck(insights: DataFrame, products: DataFrame) -> DataFrame:
    """User text, else the correction, for the row's language."""
    user = F.col("user_text") if "user_text" in insights.columns else F.lit(None).cast("string")
    value = F.coalesce(user, F.get_json_object("data", "$.correction"))
    return _finish(_with_product(insights, products), F.lit("updated"), F.struct(F.col("value_tag").alias("lang"), value.alias("ingredients_text")))


def outcome_nutrient_extraction(insights: DataFrame, products: DataFrame, rotations: DataFrame | None = None, tables: DataFrame | None = None) -> DataFrame:
    """Nutrients with default units and, if useful, the image selection.

    ``is_vote`` rows are refused.  ``user_nutrients`` (map) replaces the predicted map
    ``nutrients``.  ``rotations``: (source_image, rotation); ``tables``: (source_image,
    objects) of the table detector.
    """
    rows = _with_product(insights, products, "images", "lang").withColumn("__img", paths.image_id(F.col("source_image")))
    if rotations is not None:
        rows = rows.join(rotations.select("source_image", F.col("rotation").alias("__rot")), "source_image", "left")
    else:
        rows = rows.withColumn("__rot", F.lit(None).cast("int"))
    if tables is not None:
        kept = F.filter("objects", lambda o: (o["label"] == "nutrition-table") & (o["score"] >= 0.5))
        rows = rows.join(tables.select("source_image", kept.alias("__tables")), "source_image", "left")
    else:
        rows = rows.withColumn("__tables", F.lit(None).cast("array<struct<score:double,bounding_box:array<double>,label:string>>"))
    user = F.col("user_nutrients") if "user_nutrients" in insights.columns else F.lit(None).cast("map<string,struct<value:string,unit:string>>")
    chosen = F.coalesce(user, F.col("nutrients"))
    sized = F.map_filter(chosen, lambda k, v: k != "serving_size")
    per = measures.nutrient_per_mode(F.map_keys(sized))
    meta = _meta(F.col("p_images"), F.col("__img"))
    key = F.concat(F.lit("nutrition_"), F.coalesce("p_lang", F.lit("en")))
    done = F.coalesce(_meta(F.col("p_images"), key)["imgid"] == F.col("__img"), F.lit(False))
    one = F.size("__tables") == 1
    rotation = F.when(one, F.coalesce("__rot", F.lit(0))).otherwise(F.col("__rot"))
    size = _full_size(meta)
    crop = F.when(one, boxes.crop(F.col("__tables")[0]["bounding_box"], size["w"], size["h"], rotation))
    select = F.when(meta.isNotNull() & ~done, F.struct(F.col("__img").alias("image_id"), key.alias("image_key"), rotation.alias("rotate"), crop.alias("crop")))
    payload = F.struct(
        measures.default_units(measures.keep_per(sized, per)).alias("nutrients"), per.alias("nutrition_data_per"),
        F.try_element_at(chosen, F.lit("serving_size"))["value"].alias("serving_size"), user.isNotNull().alias("was_updated"), select.alias("select_image"),
    )
    votes = F.col("is_vote") if "is_vote" in insights.columns else F.lit(False)
    status = F.when(votes, "cannot_vote").when(~F.col("found"), "error_missing_product").otherwise("updated")
    return rows.select("id", "barcode", "type", status.alias("status"), F.when(status == "updated", F.to_json(payload)).alias("payload"))


def outcome_image_orientation(insights: DataFrame, products: DataFrame) -> DataFrame:
    """Rotate the selected image and its crop; anything missing means outdated data.

    ``image_key`` and ``rotation`` are columns or ``data`` fields.  No rotation is an error row.
    """
    rows = _with_product(insights, products, "images").withColumn("__img", paths.image_id(F.col("source_image")))
    key = F.col("image_key") if "image_key" in insights.columns else F.get_json_object("data", "$.image_key")
    rotation = (F.col("rotation") if "rotation" in insights.columns else F.get_json_object("data", "$.rotation")).cast("int")
    meta, selected = _meta(F.col("p_images"), F.col("__img")), _meta(F.col("p_images"), key)
    size = _full_size(meta)
    coords = [selected[c] for c in ("y1", "x1", "y2", "x2")]
    uncropped = F.lit(True)
    for c in coords:
        uncropped = uncropped & F.coalesce(c == "-1", F.lit(True))
    box = boxes.rotate(F.array(*[c.try_cast("double") for c in coords]), size["w"], size["h"], rotation)
    complete = coords[0].isNotNull() & coords[1].isNotNull() & coords[2].isNotNull() & coords[3].isNotNull()
    crop = F.when(complete & ~uncropped, box)
    status = (
        F.when(F.col("__img").isNull() | rotation.isNull() | (rotation == 0), "error_invalid_data")
        .when(meta.isNull() | size.isNull() | (F.coalesce(size["w"], F.lit(0)) == 0) | (F.coalesce(size["h"], F.lit(0)) == 0) | selected.isNull(), "error_updated_product")
        .otherwise("updated")
    )
    return _finish(rows, status, F.struct(F.col("__img").alias("image_id"), key.alias("image_key"), rotation.alias("rotate"), crop.alias("crop")))


def outcome_ingredient_detection(insights: DataFrame, products: DataFrame) -> DataFrame:
    """Ingredient text and image selection; votes are refused.

    Optional user columns: ``user_text``, ``user_box``, ``user_rotation``.
    """
    rows = _with_product(insights, products, "images").withColumn("__img", paths.image_id(F.col("source_image")))

    def optional(name: str, kind: str) -> Column:
        return F.col(name) if name in insights.columns else F.lit(None).cast(kind)

    user_text, user_box, user_rotation = optional("user_text", "string"), optional("user_box", "array<double>"), optional("user_rotation", "int")
    value = F.coalesce(user_text, F.get_json_object("data", "$.text"))
    meta = _meta(F.col("p_images"), F.col("__img"))
    key = F.concat(F.lit("ingredients_"), F.col("value_tag"))
    perform = user_text.isNull() | user_box.isNotNull()
    box = F.coalesce(user_box, F.col("bounding_box"))
    rotation = F.coalesce(user_rotation, F.get_json_object("data", "$.rotation").cast("int"), F.lit(0))
    size = _full_size(meta)
    crop = F.when(perform & box.isNotNull(), boxes.crop(box, size["w"], size["h"], rotation))
    done = F.coalesce(_meta(F.col("p_images"), key)["imgid"] == F.col("__img"), F.lit(False)) & crop.isNull()
    select = F.when(meta.isNotNull() & ~done, F.struct(F.col("__img").alias("image_id"), key.alias("image_key"), rotation.alias("rotate"), crop.alias("crop")))
    payload = F.struct(F.col("value_tag").alias("lang"), value.alias("ingredients_text"), select.alias("select_image"))
    votes = optional("is_vote", "boolean")
    status = F.when(F.coalesce(votes, F.lit(False)), "cannot_vote").when(~F.col("found"), "error_missing_product").otherwise("updated")
    return rows.select("id", "barcode", "type", status.alias("status"), F.when(status == "updated", F.to_json(payload)).alias("payload"))


OUTCOMES = {
    "packager_code": outcome_packager_code, "label": outcome_label, "category": outcome_category,
    "product_weight": outcome_product_weight, "expiration_date": outcome_expiration_date, "brand": outcome_brand,
    "store": outcome_store, "packaging": outcome_packaging, "nutrition_image": outcome_nutrition_image,
    "is_upc_image": outcome_upc_image, "ingredient_spellcheck": outcome_ingredient_spellcheck,
    "nutrient_extraction": outcome_nutrient_extraction, "image_orientation": outcome_image_orientation,
    "ingredient_detection": outcome_ingredient_detection,
}


def annotation_outcome(insights: DataFrame, products: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Union of the per-type outcomes, dispatched on ``type``."""
    out = None
    for type in types or OUTCOMES:
        part = OUTCOMES[type](insights.where(F.col("type") == type), products)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("status_code", status_code(F.col("status")))


def register_outcome(type: str, function) -> None:
    OUTCOMES[type] = function


def logo_value_check(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: labels need a language prefix, four types need a value."""
    kind, value = F.col("annotation_type"), F.col("annotation_value")
    reason = F.when((kind == "label") & value.isNotNull() & ~text.is_prefixed(value), "language-prefixed value required").when(
        value.isNull() & kind.isin("brand", "category", "label", "store"), "value required"
    )
    return df.withColumn("reject_reason", reason)


def logo_annotate(logos: DataFrame, annotations: DataFrame, nodes: DataFrame, synonyms: DataFrame, username: str, now: Column, bulk: bool = True) -> DataFrame:
    """Logos changed by ``annotations`` (logo_id, type, value).

    Bulk skips annotated logos; the single form rewrites when type or value differ.
    ``nodes``/``synonyms`` carry a ``taxonomy`` column (brand, label, category).
    """
    a = annotations.select(F.col("logo_id").alias("id"), F.col("type").alias("new_type"), F.col("value").alias("new_value"))
    rows = logos.join(a, "id")
    if bulk:
        rows = rows.where(F.col("annotation_type").isNull())
    else:
        rows = rows.where(~F.col("annotation_type").eqNullSafe(F.col("new_type")) | ~F.col("annotation_value").eqNullSafe(F.col("new_value")))
    rows = rows.withColumn("new_tag", text.tag(F.col("new_value")))
    known = nodes.select(F.col("taxonomy").alias("new_type"), F.col("id").alias("new_tag"), F.lit(True).alias("__known")).distinct()
    alt = synonyms.groupBy(F.col("taxonomy").alias("new_type"), F.col("tag").alias("new_tag")).agg(F.min("id").alias("__alt"))
    rows = rows.join(known, ["new_type", "new_tag"], "left").join(alt, ["new_type", "new_tag"], "left")
    given = F.col("new_value").isNotNull()
    return rows.withColumns(
        {
            "annotation_type": F.col("new_type"),
            "annotation_value": F.when(given, F.col("new_value")).otherwise(F.col("annotation_value")),
            "annotation_value_tag": F.when(given, F.col("new_tag")).otherwise(F.col("annotation_value_tag")),
            "taxonomy_value": F.when(given, F.when(F.col("__known"), F.col("new_tag")).otherwise(F.col("__alt"))).otherwise(F.col("taxonomy_value")),
            "username": F.when(given, F.lit(username)).otherwise(F.col("username")),
            "completed_at": F.when(given, now).otherwise(F.col("completed_at")),
        }
    ).drop("new_type", "new_value", "new_tag", "__known", "__alt")


def logo_bulk_update(logos: DataFrame, source_type: str, source_value: str, target_type: str, target_value: str) -> DataFrame:
    """Rewrite (type, value) of the logos whose (type, value tag) matches."""
    hit = F.coalesce((F.col("annotation_type") == source_type) & (F.col("annotation_value_tag") == text.tag(F.lit(source_value))), F.lit(False))
    return logos.withColumn("changed", hit).withColumns(
        {
            "annotation_type": F.when(F.col("changed"), target_type).otherwise(F.col("annotation_type")),
            "annotation_value": F.when(F.col("changed"), target_value).otherwise(F.col("annotation_value")),
            "annotation_value_tag": F.when(F.col("changed"), text.tag(F.lit(target_value))).otherwise(F.col("annotation_value_tag")),
        }
    )


def logo_reset(logos: DataFrame, predictions: DataFrame, insights: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Clear annotations; delete derived predictions and unannotated insights.

    ``ids``: (logo_id).  Derived rows name the logo in ``data``.
    """
    hit = ids.select(F.col("logo_id").alias("id"), F.lit(True).alias("__hit")).distinct()
    marked = logos.join(hit, "id", "left")
    cleared = ["annotation_type", "annotation_value", "annotation_value_tag", "taxonomy_value", "username", "completed_at"]
    marked = marked.withColumns({c: F.when(F.col("__hit").isNull(), F.col(c)) for c in cleared}).drop("__hit")
    own = ids.select("logo_id").distinct()

    def derived(df: DataFrame) -> DataFrame:
        rows = df.where(F.col("type").isin("brand", "label") & (F.col("predictor") == "universal-logo-detector"))
        return rows.withColumn("logo_id", F.get_json_object("data", "$.logo_id").cast("long")).join(own, "logo_id", "left_semi")

    return {"logo_annotation": marked, "prediction": derived(predictions), "product_insight": derived(insights).where(F.col("annotation").isNull())}


def cleanup_logo_predictions(predictions: DataFrame, logos: DataFrame) -> DataFrame:
    """Predictions left after dropping non-human detector rows of the given logos.

    A missing ``is_annotation`` is unknown, hence not "not human": such rows stay.
    """
    rows = predictions.withColumns(
        {"__logo": F.get_json_object("data", "$.logo_id").try_cast("long"), "__human": F.get_json_object("data", "$.is_annotation").try_cast("boolean")}
    )
    given = logos.select(F.col("id").alias("__logo"), "barcode", F.lit(True).alias("__hit")).distinct()
    out = rows.join(given, ["__logo", "barcode"], "left")
    drop = F.coalesce(F.col("__hit") & ~F.col("__human"), F.lit(False))
    return out.where(~drop).drop("__logo", "__human", "__hit")
