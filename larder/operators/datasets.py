"""Datasets built from the catalogue and from annotations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.ranking import top_batch_extract
from larder.operators.tokens import batch_score


def category_dataset(products: DataFrame, category_nodes: DataFrame, closure: DataFrame, ingredient_nodes: DataFrame, lang: str | None = None) -> DataFrame:
    """Named products with categories: text features, closed known categories, known ingredients.

    ``products``: (code, product_name, lang, categories_tags, ingredient_tags).
    """
    rows = products.where((F.coalesce("product_name", F.lit("")) != "") & (F.coalesce(F.size("categories_tags"), F.lit(0)) > 0))
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    own = rows.select("code", F.explode("categories_tags").alias("id")).join(category_nodes.select("id").distinct(), "id", "left_semi")
    above = own.join(closure.select(F.col("descendant").alias("id"), "ancestor"), "id").select("code", F.col("ancestor").alias("id"))
    cats = own.unionByName(above).groupBy("code").agg(F.array_sort(F.collect_set("id")).alias("categories"))
    ing = rows.select("code", F.posexplode("ingredient_tags").alias("pos", "id")).join(ingredient_nodes.select("id").distinct(), "id", "left_semi")
    ing = ing.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("known_ingredients"))
    out = rows.select("code", "product_name", "lang").join(cats, "code").join(ing, "code", "left")
    return out.withColumn("known_ingredients", F.coalesce("known_ingredients", F.array().cast("array<string>")))


def split_80_10_10(df: DataFrame, key: str) -> DataFrame:
    """Reproducible split by a digest of the key: no shuffle, stable across runs."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(10))
    return df.withColumn("split", F.when(bucket < 8, "train").when(bucket == 8, "val").otherwise("test"))


def image_dimensions(products: DataFrame) -> DataFrame:
    """(barcode, image_id, width, height) of raw images with a full size."""
    rows = products.select(F.col("code").alias("barcode"), F.explode("images").alias("image_id", "meta"))
    size = F.try_element_at("meta.sizes", F.lit("full"))
    return rows.where(F.col("image_id").rlike("^[0-9]+$") & size.isNotNull()).select("barcode", "image_id", size["w"].alias("width"), size["h"].alias("height"))


def logo_labels(logos: DataFrame) -> DataFrame:
    return logos.where(F.col("annotation_type").isNotNull() & F.col("taxonomy_value").isNotNull()).select(
        "id", "annotation_type", "taxonomy_value"
    )


def spellcheck_extract(products: DataFrame, scorer: Callable, prompt: str = "{text}", **limits: object) -> DataFrame:
    """Batch of main texts, wrapped in a prompt, through a user scorer adding ``correction``."""
    before, _, after = prompt.partition("{text}")
    batch = top_batch_extract(products, **limits).withColumn("prompt", F.concat(F.lit(before), F.col("text"), F.lit(after)))
    return batch_score(batch, scorer, "code string, text string, lang string, correction string")


def spellcheck_import(corrections: DataFrame, version: str, server_type: str = "off") -> DataFrame:
    """Scored corrections to prediction rows."""
    return corrections.select(
        F.col("code").alias("barcode"), F.lit(server_type).alias("server_type"), F.lit("ingredient_spellcheck").alias("type"), F.col("lang").alias("value_tag"),
        F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("source_image"), F.lit(False).alias("automatic_processing"),
        F.lit("fine-tuned-corrector").alias("predictor"), F.lit(version).alias("predictor_version"), F.lit(None).cast("double").alias("confidence"),
        F.to_json(F.struct(F.col("text").alias("original"), F.col("correction"))).alias("data"),
    )


def import_summary(changes: DataFrame) -> DataFrame:
    """Created, updated and deleted counts per (type)."""
    n = [F.count(F.when(F.col("op") == op, 1)).alias(name) for op, name in (("create", "created"), ("update", "updated"), ("delete", "deleted"))]
    return changes.groupBy("type").agg(*n)

