"""Deletes and cascades as keyed semi and anti joins.

Each operator returns, per table, either the rows to delete or the table's new state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import paths
from larder.operators.keys import keyed_products, product_key
from larder.operators.filters import raw_image_ids
from larder.schemas import DIFFS

KEY = ["barcode", "server_type"]


def delete_product(predictions: DataFrame, insights: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Tables after removing all predictions and open insights of ``products`` (key columns)."""
    keys = products.select(*KEY).distinct()
    kept = insights.where(F.col("annotation").isNotNull()).unionByName(insights.where(F.col("annotation").isNull()).join(keys, KEY, "left_anti"))
    return {"prediction": predictions.join(keys, KEY, "left_anti"), "product_insight": kept}


def _targets(images: DataFrame, deleted: DataFrame) -> DataFrame:
    """Stored images named by ``deleted`` (barcode, server_type, image_id)."""
    return images.join(deleted.select(*KEY, "image_id").distinct(), [*KEY, "image_id"], "left_semi")


def _facts(df: DataFrame, targets: DataFrame) -> DataFrame:
    return df.join(targets.select(*KEY, "source_image").distinct(), [*KEY, "source_image"], "left_semi")


def delete_images(images: DataFrame, image_predictions: DataFrame, logos: DataFrame, embeddings: DataFrame, predictions: DataFrame,
                  insights: DataFrame, deleted: DataFrame) -> dict[str, DataFrame]:
    """Rows to delete per table; ``image`` holds the rows to mark deleted.

    All embeddings and the open logos of the images go; image predictions of an image go
    only if none of its logos is annotated.
    """
    gone = _targets(images, deleted)
    ids = gone.select(F.col("id").alias("image_id"))
    ip = image_predictions.join(ids, "image_id", "left_semi")
    hit = logos.join(ip.select(F.col("id").alias("image_prediction_id"), "image_id"), "image_prediction_id")
    kept_images = hit.where(F.col("completed_at").isNotNull()).select("image_id").distinct()
    return {
        "image": gone,
        "logo_embedding": embeddings.join(hit.select(F.col("id").alias("logo_id")), "logo_id", "left_semi"),
        "logo_annotation": hit.where(F.col("completed_at").isNull()).drop("image_id"),
        "image_prediction": ip.join(kept_images, "image_id", "left_anti"),
        "prediction": _facts(predictions, gone),
        "product_insight": _facts(insights, gone).where(F.col("annotation").isNull()),
    }


def delete_image_event(images: DataFrame, image_predictions: DataFrame, logos: DataFrame, predictions: DataFrame, insights: DataFrame,
                       deleted: DataFrame) -> dict[str, DataFrame]:
    """Event form: annotated logos go too, and facts are found by path even for unknown images."""
    gone = _targets(images, deleted)
    ip = image_predictions.join(gone.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    lg = logos.join(ip.select(F.col("id").alias("image_prediction_id")), "image_prediction_id", "left_semi")
    named = deleted.select(*KEY, paths.image_path(F.col("barcode"), F.col("image_id")).alias("source_image")).distinct()
    return {
        "image": gone, "logo_annotation": lg, "image_prediction": ip, "prediction": _facts(predictions, named),
        "product_insight": _facts(insights, named).where(F.col("annotation").isNull()),
    }


def switch_product_type(images: DataFrame, image_predictions: DataFrame, logos: DataFrame, predictions: DataFrame, insights: DataFrame,
                        switched: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Rows to delete under the old type, and images to import under the new one.

    ``switched``: (barcode, server_type, new_server_type); unchanged types and vanished
    products are ignored.  The catalogue may still list a product under its old type; where
    it lists both, the new one tells the images.
    """
    both = products.select(F.col("code").alias("barcode"), "image_ids", *([] if "server_type" not in products.columns else [F.col("server_type").alias("listed")]))
    moved = switched.where(F.col("server_type") != F.col("new_server_type")).join(both.select("barcode"), "barcode", "left_semi")
    keys = moved.select(*KEY).distinct()
    im = images.join(keys, KEY, "left_semi")
    ip = image_predictions.join(im.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    lg = logos.join(ip.select(F.col("id").alias("image_prediction_id")), "image_prediction_id", "left_semi")
    again = moved.join(both, "barcode")
    if "listed" in both.columns:
        again = again.where(F.col("listed").isNull() | F.col("listed").isin(F.col("server_type"), F.col("new_server_type")))
        last = F.struct(F.col("listed").eqNullSafe(F.col("new_server_type")).cast("int").alias("new"), "image_ids")
        again = again.groupBy("barcode", "server_type", "new_server_type").agg(F.max(last).alias("last")).select("*", "last.image_ids")
    again = again.select("barcode", F.col("new_server_type").alias("server_type"), "image_ids")
    return {
        "image": im, "image_prediction": ip, "logo_annotation": lg, "prediction": predictions.join(keys, KEY, "left_semi"),
        "product_insight": insights.join(keys, KEY, "left_semi").where(F.col("annotation").isNull()),
        "reimport": again.select(*KEY, F.explode("image_ids").alias("image_id")),
    }


def save_image(requests: DataFrame, images: DataFrame, products: DataFrame) -> DataFrame:
    """New image rows; known, non-raw, unreferenced and unsized images fall out.

    A missing or non-numeric upload time gives null.
    """
    new = requests.join(images.select("source_image", "server_type"), ["source_image", "server_type"], "left_anti")
    new = new.withColumn("image_id", paths.image_id(F.col("source_image"))).where(F.col("image_id").isNotNull())
    rows = new.join(keyed_products(new, products, "images"), product_key(new, products))
    meta = F.try_element_at("images", F.col("image_id"))
    size = F.try_element_at(meta["sizes"], F.lit("full"))
    rows = rows.where(size.isNotNull())
    uploaded = F.when(meta["uploaded_t"].rlike("^[0-9]+$"), F.timestamp_seconds(meta["uploaded_t"].try_cast("long")))
    return rows.select("barcode", "server_type", "image_id", "source_image", size["w"].alias("width"), size["h"].alias("height"), uploaded.alias("uploaded_at"), F.lit(False).alias("deleted"))


def refresh_images(products: DataFrame, images: DataFrame, server_type: str = "off") -> DataFrame:
    """Image rows for catalogue images the table lacks."""
    if "server_type" in products.columns:
        products = products.where(F.col("server_type") == server_type)
    wanted = products.select(F.col("code").alias("barcode"), F.lit(server_type).alias("server_type"), F.explode(raw_image_ids(F.col("images"))).alias("image_id"))
    wanted = wanted.select("barcode", "server_type", paths.image_path(F.col("barcode"), F.col("image_id")).alias("source_image"))
    return save_image(wanted, images, products)


def refresh_image_deletes(events: DataFrame) -> DataFrame:
    """(barcode, server_type, image_id) deleted by product updates, from their diffs."""
    diffs = F.from_json("diffs", DIFFS)
    return events.select(
        F.col("code").alias("barcode"), paths.server_of_product_type(F.col("product_type")).alias("server_type"), F.explode(diffs["uploaded_images"]["delete"]).alias("image_id")
    ).distinct()
