"""Equi, anti, semi and range joins.

No broadcast hints: with adaptive execution Spark broadcasts a side only when its
measured size is below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import boxes, paths
from larder.operators.keys import keyed_products, product_key
from larder.session import cut_lineage
from larder.sources.readers import raw_image_ids

PRODUCT_KEY = ["barcode", "server_type"]
MOST_IN_IMAGE = 256  # boxes or words of an image that meet without a grid


def join_prediction_image(image_predictions: DataFrame, images: DataFrame, columns: Sequence[str] = ("barcode", "server_type", "source_image")) -> DataFrame:
    right = images.select(F.col("id").alias("image_id"), *columns)
    return image_predictions.join(right, "image_id")


def join_logo_image(logos: DataFrame, image_predictions: DataFrame, images: DataFrame,
                    prediction_columns: Sequence[str] = ("model_name",),
                    image_columns: Sequence[str] = ("deleted", "width", "height")) -> DataFrame:
    """Logo -> image prediction -> image."""
    ip = image_predictions.select(F.col("id").alias("image_prediction_id"), "image_id", *prediction_columns)
    im = images.select(F.col("id").alias("image_id"), *image_columns)
    return logos.join(ip, "image_prediction_id").join(im, "image_id")


def join_image_facts(base: DataFrame, rotations: DataFrame, languages: DataFrame, tables: DataFrame) -> DataFrame:
    """Rotation, language counts and nutrition-table boxes (>= 0.5) by source image.

    ``tables`` holds ``(source_image, objects)``.
    """
    kept = F.filter("objects", lambda o: (o["label"] == "nutrition-table") & (o["score"] >= 0.5))
    return (
        base.join(rotations.select("source_image", "rotation"), "source_image", "left")
        .join(languages.select("source_image", "lang_counts"), "source_image", "left")
        .join(tables.select("source_image", kept.alias("nutrition_tables")), "source_image", "left")
    )


def product_ocr_texts(products: DataFrame, texts: DataFrame) -> DataFrame:
    """All texts of a product's raw images, in image order.

    The list is what the feature is; products have tens of images, so it stays small.
    """
    ids = products.select(F.col("code").alias("barcode"), F.explode("image_ids").alias("image_id"))
    joined = ids.join(texts.select("barcode", "image_id", "text"), ["barcode", "image_id"])
    return joined.groupBy("barcode").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col("image_id").cast("long").alias("i"), "text"))), lambda s: s["text"]
        ).alias("texts")
    )


def vector_cache_join(products: DataFrame, cache: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(found, missing): cached vectors of the ``k`` newest images, and ids still to score."""
    from larder.operators.ranking import recent_images_k

    wanted = recent_images_k(products, k).select("barcode", F.explode("recent_ids").alias("image_id"))
    joined = wanted.join(cache.select("barcode", "image_id", "embedding"), ["barcode", "image_id"], "left")
    return joined.where(F.col("embedding").isNotNull()), joined.where(F.col("embedding").isNull()).drop("embedding")


def join_embedding_logo(embeddings: DataFrame, logos: DataFrame, image_predictions: DataFrame) -> DataFrame:
    lg = logos.select(F.col("id").alias("logo_id"), "image_prediction_id", "barcode", "server_type", "source_image")
    ip = image_predictions.select(F.col("id").alias("image_prediction_id"), "model_version")
    return embeddings.join(lg, "logo_id").join(ip, "image_prediction_id")


def images_without_prediction(images: DataFrame, image_predictions: DataFrame, model: str | None = None) -> DataFrame:
    """Images with no prediction (of ``model``); the model variant leaves deleted ones out."""
    if model is not None:
        image_predictions = image_predictions.where(F.col("model_name") == model)
        images = images.where(~F.col("deleted"))
    return images.join(image_predictions.select(F.col("image_id").alias("id")), "id", "left_anti")


def predictions_without_logo(image_predictions: DataFrame, logos: DataFrame) -> DataFrame:
    return image_predictions.join(logos.select(F.col("image_prediction_id").alias("id")), "id", "left_anti")


def exclude_voted(insights: DataFrame, votes: DataFrame, by: str, value: str) -> DataFrame:
    """Insights not voted on by one device or user."""
    if by not in ("device_id", "username"):
        raise ValueError(f"unknown exclusion: {by}")
    seen = votes.where(F.col(by) == value).select(F.col("insight_id").alias("id"))
    return insights.join(seen, "id", "left_anti")


def missing_images(products: DataFrame, images: DataFrame) -> DataFrame:
    """Raw images of the catalogue that the image table lacks."""
    ids = products.select(F.col("code").alias("barcode"), F.explode("image_ids").alias("image_id"))
    out = ids.join(images.select("barcode", "image_id"), ["barcode", "image_id"], "left_anti")
    return out.withColumn("source_image", paths.image_path(F.col("barcode"), F.col("image_id")))


def unseen_detections(detections: DataFrame, images: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """Detections of known images that are not stored for the model yet."""
    known = detections.join(images.select("barcode", "image_id", F.col("id").alias("image_pk")), ["barcode", "image_id"])
    done = stored.where(F.col("model_name") == model).select(F.col("image_id").alias("image_pk"))
    return known.join(done, "image_pk", "left_anti")


def uncategorised_products(products: DataFrame, predictions: DataFrame) -> DataFrame:
    done = predictions.where(F.col("type") == "category").select(F.col("barcode").alias("code"))
    return products.dropDuplicates(["code"]).join(done, "code", "left_anti")


def unindexed_vectors(embeddings: DataFrame, stored_ids: DataFrame) -> DataFrame:
    return embeddings.join(stored_ids.select("logo_id"), "logo_id", "left_anti")


def with_image_exists(insights: DataFrame, images: DataFrame) -> DataFrame:
    """Recompute ``with_image``.

    Unannotated brand/category rows: a live image of the product exists; rows of other
    types: the source image is set; annotated brand/category rows keep their value.
    """
    live = images.where(~F.col("deleted")).select(*PRODUCT_KEY).distinct().withColumn("has_live", F.lit(True))
    joined = insights.join(live, PRODUCT_KEY, "left")
    generic = F.col("type").isin("brand", "category")
    flag = (
        F.when(generic & F.col("annotation").isNull(), F.coalesce("has_live", F.lit(False)))
        .when(generic, F.col("with_image"))
        .otherwise(F.col("source_image").isNotNull())
    )
    return joined.withColumn("with_image", flag).drop("has_live")


def product_enrich(insights: DataFrame, products: DataFrame) -> DataFrame:
    """Copy countries, brands, scans and image presence from the catalogue."""
    right = keyed_products(
        insights, products, F.col("countries_tags").alias("countries"), F.col("brands_tags").alias("brands"),
        "unique_scans_n", (F.size("image_ids") > 0).alias("product_has_image"),
    )
    left = insights.drop("countries", "brands", "unique_scans_n")
    out = left.join(right, product_key(insights, products), "left")
    generic = F.col("type").isin("label", "category")
    flag = F.when(generic, F.col("product_has_image")).otherwise(F.col("source_image").isNotNull())
    return out.withColumn("with_image", flag).drop("product_has_image")


def refresh_catalog(insights: DataFrame, products: DataFrame, brand_prefixes: DataFrame, brand_blacklist: DataFrame,
                    cutoff: str, with_deletion: bool = True) -> DataFrame:
    """Action per unannotated insight: delete, update or keep.

    Rows up to ``cutoff`` are checked against the catalogue; brand rows of any age
    against the brand rule.
    """
    from larder.operators.filters import valid_insight_image

    rows = insights.where(F.col("annotation").isNull())
    right = keyed_products(
        rows, products, "image_ids", F.col("countries_tags").alias("new_countries"),
        F.col("brands_tags").alias("new_brands"), F.col("unique_scans_n").alias("new_scans"), F.lit(True).alias("known"),
    )
    joined = brand_range_join(rows, brand_prefixes, brand_blacklist).join(right, product_key(rows, products), "left")
    old = F.col("timestamp") <= F.lit(cutoff).cast("timestamp")
    changed = ~(
        F.col("brands").eqNullSafe(F.col("new_brands"))
        & F.col("countries").eqNullSafe(F.col("new_countries"))
        & F.col("unique_scans_n").eqNullSafe(F.col("new_scans"))
    )
    gone, bad_image = F.col("known").isNull(), ~valid_insight_image(F.col("source_image"), F.col("image_ids"))
    bad_brand = (F.col("type") == "brand") & ~F.col("brand_allowed")
    delete, update = F.lit("delete" if with_deletion else "keep"), F.lit("update")
    action = F.when(old & gone, delete).when(bad_brand, delete)
    if with_deletion:
        action = action.when(old & bad_image, delete)
    return joined.withColumn("action", action.when(old & changed, update).otherwise("keep"))


def brand_range_join(df: DataFrame, prefixes: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Adds ``brand_allowed``.

    Only the ``taxonomy`` and ``curated-list`` predictors are checked: not blacklisted,
    and for thirteen-digit codes the (brand, prefix) pair is known.
    """
    known = prefixes.select(F.col("brand_tag").alias("value_tag"), F.col("prefix").alias("__prefix"), F.lit(True).alias("__known"))
    banned = blacklist.select(F.col("brand_tag").alias("value_tag"), F.lit(True).alias("__banned")).distinct()
    out = (
        df.withColumn("__prefix", paths.barcode_prefix(F.col("barcode")))
        .join(known.dropDuplicates(["value_tag", "__prefix"]), ["value_tag", "__prefix"], "left")
        .join(banned, "value_tag", "left")
    )
    in_range = F.col("__prefix").isNull() | F.col("__known").isNotNull()
    checked = F.coalesce(F.col("predictor").isin("taxonomy", "curated-list"), F.lit(False))
    return out.withColumn("brand_allowed", ~checked | (F.col("__banned").isNull() & in_range)).drop("__prefix", "__known", "__banned")


def annotation_neighbors_join(neighbors: DataFrame, logos: DataFrame) -> DataFrame:
    """``(logo_id, neighbor_id, distance)`` with the neighbour's label.

    Unannotated, or a value without taxonomy value: UNKNOWN; no value: (type, null).
    """
    right = logos.select(F.col("id").alias("neighbor_id"), "annotation_type", "annotation_value", "taxonomy_value")
    known = F.col("annotation_type").isNotNull() & (F.col("annotation_value").isNull() | F.col("taxonomy_value").isNotNull())
    return (
        neighbors.join(right, "neighbor_id", "left")
        .withColumns(
            {
                "label_type": F.when(known, F.col("annotation_type")).otherwise("UNKNOWN"),
                "label_value": F.when(known & F.col("annotation_value").isNotNull(), F.col("taxonomy_value")),
            }
        )
        .drop("annotation_type", "annotation_value", "taxonomy_value")
    )


def threshold_join(df: DataFrame, thresholds: DataFrame, default: float = 0.2) -> DataFrame:
    """Threshold of each (label_type, label_value); labels without value match null-safely."""
    right = thresholds.select(F.col("type").alias("t_type"), F.col("value").alias("t_value"), "threshold")
    cond = F.col("label_type").eqNullSafe(F.col("t_type")) & F.col("label_value").eqNullSafe(F.col("t_value"))
    return df.join(right, cond, "left").withColumn("threshold", F.coalesce("threshold", F.lit(default))).drop("t_type", "t_value")


def crowded_images(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, int]:
    """(images with more than ``most`` rows, how many): counted and written before anything is joined."""
    return cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key))


def box_containment_join(words: DataFrame, logos: DataFrame, cell: float = 0.125, most: int = MOST_IN_IMAGE) -> DataFrame:
    """Text inside a box: words of the image whose whole box lies in it, in reading order.

    Words meet the boxes of their image, each row once.  In images of more than ``most`` words
    they meet the boxes around them only: a word is in the grid cell (of side ``cell``, in the
    boxes' unit) of its first corner, a box in all cells it covers.
    """
    side = lambda x: F.floor(x / cell).cast("int")
    lb = F.col("lb")
    span = lambda low, high: F.explode(F.sequence(side(low), F.greatest(side(high), side(low))))
    b = F.col("bbox")
    inside = (b[0] >= lb[0]) & (b[1] >= lb[1]) & (b[2] <= lb[2]) & (b[3] <= lb[3])
    right = logos.select(F.col("id").alias("logo_id"), "source_image", F.col("bounding_box").alias("lb")).where("lb is not null")
    left = words.select("source_image", "word_idx", "text", "bbox")
    crowded, n = crowded_images(left, "source_image", most)
    if n == 0:
        joined = left.join(right, "source_image").where(inside)
    else:
        joined = left.join(crowded, "source_image", "left_anti").join(right, "source_image").where(inside)
        placed = left.join(crowded, "source_image", "left_semi").withColumns({"cell_y": side(b[0]), "cell_x": side(b[1])})
        around = right.join(crowded, "source_image", "left_semi").withColumn("cell_y", span(lb[0], lb[2])).withColumn("cell_x", span(lb[1], lb[3]))
        columns = ["logo_id", "word_idx", "text"]
        joined = joined.select(*columns).union(placed.join(around, ["source_image", "cell_y", "cell_x"]).where(inside).select(*columns))
    ordered = F.array_sort(F.collect_list(F.struct("word_idx", "text")))
    return joined.groupBy("logo_id").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def nearby_match_join(matches: DataFrame, texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 10) -> DataFrame:
    """City matches whose own postal code stands within ``distance`` characters.

    ``matches``: (id, start, end, postal_code); the window around the city is cut from
    the text, so the range predicate never compares two position lists.
    """
    joined = matches.join(texts.select(id_col, F.col(text_col).alias("__text")), id_col)
    begin = F.greatest(F.lit(0), F.col("start") - distance)
    window = F.substring(F.col("__text"), begin + 1, F.col("end") + distance - begin)
    pattern = F.concat(F.lit("(?:[^0-9]|^)"), F.col("postal_code"), F.lit("(?:[^0-9]|$)"))
    hit = F.regexp_instr(window, pattern)
    lead = F.when(F.substring(window, hit, 1).rlike("^[0-9]"), 0).otherwise(1)
    pc_start = begin + hit - 1 + lead
    found = joined.where(F.col("postal_code").rlike("^[0-9]+$") & (hit > 0))
    return found.withColumns({"pc_start": pc_start, "pc_end": pc_start + F.length("postal_code")})


def iou_self_join(boxes_df: DataFrame, threshold: float, key: str = "source_image", most: int = MOST_IN_IMAGE) -> DataFrame:
    """Reporting form: box pairs of one image with IoU at or above ``threshold`` (above 0).

    Boxes meet the others of their image, each row once.  In images of more than ``most`` boxes
    the join key is (image, cell): pairs with a high IoU share cells of a coarse grid, so a
    crowded image is spread over its cells instead of paired in full.  There the pair is
    reported from the cell of its intersection's corner only.
    """
    slim = boxes_df.select(key, "index", "bounding_box").where(F.col("bounding_box").isNotNull())
    crowded, n = crowded_images(slim, key, most)
    a, c = F.col("a"), F.col("b")

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        left = rows.select(*on, F.col("index").alias("i"), F.col("bounding_box").alias("a"))
        right = rows.select(*on, F.col("index").alias("j"), F.col("bounding_box").alias("b"))
        return left.join(right, on).where(F.col("i") < F.col("j")).withColumn("iou", boxes.iou(a, c)).where(F.col("iou") >= threshold)

    if n == 0:
        return pairs(slim, [key]).select(key, "i", "j", "iou")
    cells = F.explode(
        F.expr(
            "flatten(transform(sequence(cast(floor(bounding_box[0] * 8) as int), cast(floor(bounding_box[2] * 8) as int)), "
            "y -> transform(sequence(cast(floor(bounding_box[1] * 8) as int), cast(floor(bounding_box[3] * 8) as int)), x -> struct(y, x))))"
        )
    )
    home = F.struct(
        F.floor(F.greatest(a[0], c[0]) * 8).cast("int").alias("y"), F.floor(F.greatest(a[1], c[1]) * 8).cast("int").alias("x")
    )
    apart = pairs(slim.join(crowded, key, "left_anti"), [key])
    spread = pairs(slim.join(crowded, key, "left_semi").withColumn("cell", cells), [key, "cell"]).where(home == F.col("cell"))
    return apart.select(key, "i", "j", "iou").union(spread.select(key, "i", "j", "iou"))
