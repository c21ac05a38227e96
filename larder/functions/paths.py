"""Barcodes, image paths and URLs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder import fixed


def image_id(path: Column) -> Column:
    """Digits-only file stem, else null."""
    name = F.substring_index(path, "/", -1)
    return F.nullif(F.regexp_extract(name, r"^([0-9]+)(?:\.[^.]*)?$", 1), F.lit(""))


def image_rank(path: Column) -> Column:
    """Raw image ids grow with upload time; no id counts as 0."""
    return F.coalesce(image_id(path).cast("long"), F.lit(0).cast("long"))


def split_barcode(barcode: Column) -> Column:
    """3/3/3/rest for codes longer than eight digits."""
    parts = F.concat_ws(
        "/",
        F.substring(barcode, 1, 3),
        F.substring(barcode, 4, 3),
        F.substring(barcode, 7, 3),
        F.substr(barcode, F.lit(10)),
    )
    return F.when(F.length(barcode) > 8, parts).otherwise(barcode)


def image_path(barcode: Column, image: Column, suffix: str = ".jpg") -> Column:
    return F.concat(F.lit("/"), split_barcode(barcode), F.lit("/"), image, F.lit(suffix))


def source_image(url: Column) -> Column:
    """URL of an image or its OCR file to the stored image path."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)
    path = F.regexp_replace(path, "^/images/products", "")
    return F.regexp_replace(path, r"\.json$", ".jpg")


def image_url(base: Column | str, path: Column) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/images/products"), path)


def crop_url(base: Column | str, url: Column, box: Column) -> Column:
    """Crop service address of a (y_min, x_min, y_max, x_max) box."""
    base = F.lit(base) if isinstance(base, str) else base
    args = [F.concat(F.lit(f"{k}="), box[i].cast("string")) for i, k in enumerate(("y_min", "x_min", "y_max", "x_max"))]
    return F.concat(base, F.lit("/api/v1/images/crop?image_url="), url, F.lit("&"), F.concat_ws("&", *args))


def display_image(path: Column) -> Column:
    shown = F.regexp_replace(path, r"([^/.]+)\.[^/]*$", f"$1.{fixed.DISPLAY_IMAGE_SIZE}.jpg")
    return F.when(image_id(path).isNotNull(), shown).otherwise(path)


def barcode_prefix(barcode: Column) -> Column:
    """Seven digits + mask; only thirteen-digit codes have one."""
    return F.when(
        F.length(barcode) == 13, F.concat(F.substring(barcode, 1, 7), F.repeat(F.lit("x"), F.lit(6)))
    )


def is_reserved(barcode: Column) -> Column:
    """Shop-internal numbering: starts with 2 after one optional zero."""
    return F.regexp_replace(barcode, "^0", "").startswith("2")


def normalize_barcode(barcode: Column) -> Column:
    """Digits without leading zeros, padded to thirteen (eight when short)."""
    bare = F.regexp_replace(barcode, "^0+", "")
    padded = (
        F.when(F.length(bare) <= 8, F.lpad(bare, 8, "0"))
        .when(F.length(bare) < 13, F.lpad(bare, 13, "0"))
        .otherwise(bare)
    )
    return F.when(barcode.rlike("^[0-9]+$"), padded).otherwise(barcode)


def facet_name(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), url)
    return F.translate(F.regexp_replace(path, "^/+|/+$", ""), "-", "_")


def server_of_product_type(product_type: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.SERVER_BY_PRODUCT_TYPE.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), product_type)


def is_food_server(server: Column) -> Column:
    return server.isin(fixed.FOOD_SERVERS)


def hash_partition(barcode: Column, buckets: int) -> Column:
    """Stable bucket: last four md5 bytes, little endian, signed, modulo n."""
    digest = F.md5(barcode)
    order = [F.substring(digest, 31, 2), F.substring(digest, 29, 2), F.substring(digest, 27, 2), F.substring(digest, 25, 2)]
    unsigned = F.conv(F.concat(*order), 16, 10).cast("long")
    signed = F.when(unsigned >= 2**31, unsigned - 2**32).otherwise(unsigned)
    return F.pmod(signed, F.lit(buckets)).cast("int")


def device_id(given: Column, address: Column) -> Column:
    return F.coalesce(given, F.sha1(address.cast("binary")))


def edit_comment(
    action: Column, is_vote: Column, is_automatic: Column, insight_id: Column, product: str = "larder"
) -> Column:
    text = F.concat(F.lit(f"[{product}] "), action)
    text = F.concat(text, F.when(F.coalesce(insight_id, F.lit("")) != "", F.concat(F.lit(", ID: "), insight_id)).otherwise(""))
    return F.concat(
        text,
        F.when(is_vote, " (applied after 3 anonymous votes)").when(is_automatic, " (automated edit)").otherwise(""),
    )


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
