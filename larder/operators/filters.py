"""Catalogue and row filters (all JVM predicates that push to the scan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import paths
from larder.operators.keys import keyed_products, product_key
from larder.sources.readers import raw_image_ids


def has_tag(column: str, tag: str) -> Column:
    return F.coalesce(F.array_contains(F.col(column), tag), F.lit(False))


def filter_country_tag(df: DataFrame, tag: str, column: str = "countries_tags") -> DataFrame:
    return df.where(has_tag(column, tag))


def filter_state_tag(df: DataFrame, tag: str, column: str = "states_tags") -> DataFrame:
    return df.where(has_tag(column, tag))


def filter_text_eq(df: DataFrame, column: str, value: str) -> DataFrame:
    if value != "":  # plain equality reaches the scan; a missing text equals only ""
        return df.where(F.col(column) == value)
    return df.where(F.coalesce(F.col(column), F.lit("")) == "")


_COMPARE = {
    "eq": lambda a, b: a == b,
    "gt": lambda a, b: a > b,
    "geq": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "leq": lambda a, b: a <= b,
}


def filter_number(df: DataFrame, column: str, ref: float, operator: str, default: float | None = None) -> DataFrame:
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator: {operator}")
    col = F.col(column)
    if default is not None:
        col = F.coalesce(col, F.lit(default))
    return df.where(_COMPARE[operator](col, F.lit(ref)))


def filter_text_nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def filter_text_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) == ""))


def filter_tags_nonempty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.size(column), F.lit(0)) > 0)


def filter_tags_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.coalesce(F.size(column), F.lit(0)) <= 0)


def filter_modified(df: DataFrame, start: int | None = None, end: int | None = None, column: str = "last_modified_t") -> DataFrame:
    """Either bound; when both are given only ``start`` applies, as documented."""
    if start is not None:
        return df.where(F.col(column) >= start)
    if end is not None:
        return df.where(F.col(column) <= end)
    raise ValueError("a start or an end time is needed")


def take_n(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def insight_filter(
    df: DataFrame,
    server_type: str | None = "off",
    annotated: bool | None = False,
    annotation: int | None = None,
    automatically_processable: bool | None = None,
    barcode: str | None = None,
    value_tag: str | None = None,
    types: Sequence[str] | None = None,
    countries: Sequence[str] | None = None,
    brands: Sequence[str] | None = None,
    reserved_barcode: bool | None = None,
    campaigns: Sequence[str] | None = None,
    predictor: str | None = None,
    lc: Sequence[str] | None = None,
    with_image: bool | None = None,
) -> DataFrame:
    """Conjunction of the given predicates; ``None`` leaves one out."""
    tests: list[Column] = []

    def strings(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    for column, value in (
        ("server_type", server_type), ("annotation", annotation),
        ("automatic_processing", automatically_processable), ("reserved_barcode", reserved_barcode),
        ("predictor", predictor), ("with_image", with_image),
    ):
        if value is not None:
            tests.append(F.col(column) == F.lit(value))
    if annotated is not None:
        tests.append(F.col("annotation").isNotNull() if annotated else F.col("annotation").isNull())
    if barcode:
        tests.append(F.col("barcode") == barcode)
    if value_tag:
        tests.append(F.col("value_tag") == value_tag)
    if types is not None:
        tests.append(F.col("type").isin(list(types)))
    if countries is not None:
        tests.append(F.arrays_overlap("countries", strings(countries)))
    if brands:
        tests.append(F.arrays_overlap("brands", strings(brands)))
    if campaigns is not None:
        tests.append(F.size(F.array_except(strings(campaigns), F.col("campaign"))) == 0)
    if lc is not None:
        tests.append(F.arrays_overlap("lc", strings(lc)))
    for test in tests:
        df = df.where(test)
    return df


def _equal(df: DataFrame, **values: object) -> DataFrame:
    for column, value in values.items():
        if value is not None and value != "":
            df = df.where(F.col(column) == F.lit(value))
    return df


def image_filter(images: DataFrame, predictions: DataFrame, server_type: str = "off", barcode: str | None = None,
                 with_predictions: bool = False) -> DataFrame:
    """Images of a project; by default only those without any prediction."""
    out = _equal(images, server_type=server_type, barcode=barcode)
    if with_predictions:
        return out
    return out.join(predictions.select(F.col("image_id").alias("id")), "id", "left_anti")


def prediction_filter(df: DataFrame, server_type: str = "off", barcode: str | None = None, value_tag: str | None = None,
                      types: Sequence[str] | None = None) -> DataFrame:
    out = _equal(df, server_type=server_type, barcode=barcode, value_tag=value_tag)
    return out.where(F.col("type").isin(list(types))) if types else out


def image_prediction_filter(
    image_predictions: DataFrame, images: DataFrame, logos: DataFrame, server_type: str = "off",
    barcode: str | None = None, image_id: str | None = None, type: str | None = None, model_name: str | None = None,
    model_version: str | None = None, min_confidence: float | None = None, with_logo: bool = False,
) -> DataFrame:
    """Image predictions of a project's images; by default only those without a logo."""
    kept = _equal(images, server_type=server_type, barcode=barcode, image_id=image_id)
    out = _equal(image_predictions, type=type, model_name=model_name, model_version=model_version)
    if min_confidence is not None:
        out = out.where(F.col("max_confidence") >= min_confidence)
    out = out.join(kept.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    if with_logo:
        return out
    return out.join(logos.select(F.col("image_prediction_id").alias("id")), "id", "left_anti")


def logo_filter(logos: DataFrame, image_predictions: DataFrame, images: DataFrame, server_type: str = "off",
                barcode: str | None = None, value_tag: str | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """Logos of live images, newest image prediction first when ordered by ``image_prediction_id`` desc."""
    live = images.where((F.col("server_type") == server_type) & ~F.col("deleted")).select(F.col("id").alias("image_id"))
    ids = image_predictions.join(live, "image_id", "left_semi").select(F.col("id").alias("image_prediction_id"))
    out = _equal(logos, barcode=barcode, annotation_value_tag=value_tag)
    if types:
        out = out.where(F.col("annotation_type").isin(list(types)))
    return out.join(ids, "image_prediction_id", "left_semi")


def insight_by_id(insights: DataFrame, insight_id: str) -> DataFrame:
    return insights.where(F.col("id") == insight_id)


def insights_of_product(insights: DataFrame, barcode: str, server_type: str = "off") -> DataFrame:
    return insight_filter(insights, server_type=server_type, annotated=False, barcode=barcode)


def logo_search(
    logos: DataFrame, type: str | None = None, value: str | None = None, taxonomy_value: str | None = None,
    min_confidence: float | None = None, annotated: bool | None = False, server_type: str = "off",
) -> DataFrame:
    """Argument rules first, then plain predicates over logos of live images."""
    from larder.functions.text import tag

    if type is None and (value is not None or taxonomy_value is not None):
        raise ValueError("a type is needed when a value is given")
    if value is not None and taxonomy_value is not None:
        raise ValueError("value and taxonomy_value exclude each other")
    if type == "label" and value is not None:
        raise ValueError("labels are searched by taxonomy_value")
    out = _equal(logos, server_type=server_type, annotation_type=type, taxonomy_value=taxonomy_value)
    if annotated is not None:
        out = out.where(F.col("annotation_value").isNotNull() if annotated else F.col("annotation_value").isNull())
    if value is not None:
        out = out.where(F.col("annotation_value_tag") == tag(F.lit(value)))
    if min_confidence is not None:
        out = out.where(F.col("score") >= min_confidence)
    return out


def annotation_request_check(df: DataFrame) -> DataFrame:
    """``(annotation, data, update, username)`` to a reject reason, or the resolved annotator.

    The user name ``null`` means anonymous; a signed-in user is trusted.
    """
    user = F.when(F.col("username") == "null", None).otherwise(F.col("username"))
    two = F.col("annotation") == 2
    reason = (
        F.when(~F.col("annotation").isin(-1, 0, 1, 2) | F.col("annotation").isNull(), "invalid annotation")
        .when(two & F.col("data").isNull(), "data must be provided if annotation is 2")
        .when(~two & F.col("data").isNotNull(), "data can only be provided if annotation is 2")
        .when(two & ~F.col("update"), "annotation 2 needs update")
        .when(two & user.isNull(), "annotation 2 needs a signed-in user")
    )
    return df.withColumns({"reject_reason": reason, "user": user, "trusted": user.isNotNull()})


def valid_image(source_image: Column, image_ids: Column) -> Column:
    """Digit stem that is among the product's raw images."""
    return F.coalesce(F.array_contains(image_ids, paths.image_id(source_image)), F.lit(False))


def valid_insight_image(source_image: Column, image_ids: Column) -> Column:
    return source_image.isNull() | valid_image(source_image, image_ids)


def special_image(source_image: Column, images: Column, kind: str, lang: str | None = None) -> Column:
    """The raw image is selected as ``<kind>[_<lang>]``."""
    image = paths.image_id(source_image)
    end = "" if lang is None else f"_{lang}"
    used = F.exists(
        F.map_entries(images),
        lambda e: e["key"].startswith(kind) & e["key"].endswith(end) & (e["value"]["imgid"].cast("string") == image),
    )
    return F.coalesce(valid_image(source_image, raw_image_ids(images)) & used, F.lit(False))


def has_special_image(images: Column, kind: str, lang: str | None = None) -> Column:
    start = f"{kind}_" if lang is None else f"{kind}_{lang}"
    return F.coalesce(F.exists(F.map_keys(images), lambda k: k.startswith(start)), F.lit(False))


def selected_image(image: Column, images: Column) -> Column:
    """The image id is used by any front/ingredients/nutrition/packaging selection."""
    return F.coalesce(
        F.exists(
            F.map_entries(images),
            lambda e: e["key"].rlike("^(front|ingredients|nutrition|packaging)") & (e["value"]["imgid"] == image),
        ),
        F.lit(False),
    )


def recent_image(image: Column, images: Column, max_seconds: int) -> Column:
    """No other raw image is more than ``max_seconds`` newer."""
    own = F.try_element_at(images, image)["uploaded_t"].try_cast("long")
    others = F.filter(F.map_entries(images), lambda e: e["key"].rlike("^[0-9]+$") & (e["key"] != image))
    newest = F.array_max(F.transform(others, lambda e: e["value"]["uploaded_t"].try_cast("long")))
    return F.coalesce(newest - own <= max_seconds, F.lit(True))


def authorized_labels(df: DataFrame, allowed: DataFrame, column: str = "value_tag") -> DataFrame:
    """Flag rows whose tag may be applied automatically."""
    right = allowed.select(F.col("value_tag").alias(column)).distinct().withColumn("authorized", F.lit(True))
    return df.join(right, column, "left").withColumn("authorized", F.coalesce("authorized", F.lit(False)))


def existing_insights(insights: DataFrame, keys: DataFrame, type: str) -> DataFrame:
    """Current rows of one type for the given (barcode, server_type) keys."""
    return insights.where(F.col("type") == type).join(
        keys.select("barcode", "server_type"), ["barcode", "server_type"], "left_semi"
    )


def valid_prediction(predictions: DataFrame, products: DataFrame) -> DataFrame:
    """Predictions of existing products whose source image (if any) is a raw image of it."""
    right = keyed_products(predictions, products, "image_ids")
    src = F.coalesce(F.col("source_image"), F.lit(""))
    return predictions.join(right, product_key(predictions, products)).where((src == "") | valid_image(F.col("source_image"), F.col("image_ids"))).drop("image_ids")


def detection_filter(objects: Column, min_score: float, label: str | None = None, strict: bool = True) -> Column:
    """Objects above a score, of one label, with a positive box size."""

    def keep(o: Column) -> Column:
        test = (o["score"] > min_score) if strict else (o["score"] >= min_score)
        if label is not None:
            test = test & (o["label"] == label)
        b = o["bounding_box"]
        return test & (b[2] > b[0]) & (b[3] > b[1])

    return F.filter(objects, keep)


def max_confidence(objects: Column) -> Column:
    return F.array_max(F.transform(objects, lambda o: o["score"]))


def barcode_rewrite(df: DataFrame) -> DataFrame:
    """Rows whose barcode changes when normalised, with the rebuilt source image."""
    new = paths.normalize_barcode(F.col("barcode"))
    out = df.withColumn("new_barcode", new).where(F.col("new_barcode") != F.col("barcode"))
    image = F.regexp_extract("source_image", r"([^/.]+)(?:\.[^/]*)?$", 1)
    return out.withColumn(
        "new_source_image", F.when(F.col("source_image").isNotNull(), paths.image_path(F.col("new_barcode"), image))
    )


# fixed values: JSON keys that repeat a promoted column, by type
REDUNDANT_KEYS = {
    "label": {"label_tag": "value_tag"},
    "brand": {"brand_tag": "value_tag", "brand": "value"},
    "store": {"store_tag": "value_tag", "store": "value"},
    "packaging": {"packaging_tag": "value_tag", "packaging": "value"},
    "category": {"category": "value_tag"},
}


def clean_redundant_data(df: DataFrame) -> DataFrame:
    """Drop ``data`` entries (``map<string,string>``) equal to a promoted column.

    ``source`` repeats the source image for every type; a differing one is an error.
    """

    def redundant(key: Column, value: Column) -> Column:
        test = (key == "source") & value.eqNullSafe(F.col("source_image"))
        for kind, keys in REDUNDANT_KEYS.items():
            for name, column in keys.items():
                test = test | ((F.col("type") == kind) & (key == name) & value.eqNullSafe(F.col(column)))
        return test

    source = F.try_element_at(F.col("data"), F.lit("source"))
    return df.withColumns(
        {
            "cleaned": F.map_filter("data", lambda k, v: ~redundant(k, v)),
            "source_error": F.map_contains_key("data", "source") & ~source.eqNullSafe(F.col("source_image")),
        }
    )
