"""The key of a product: barcode and, where both sides carry it, server type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product_key(left: DataFrame, products: DataFrame) -> list[str]:
    """One barcode may be a product of several projects; a frame without projects joins on barcode."""
    both = "server_type" in left.columns and "server_type" in products.columns
    return ["barcode", "server_type"] if both else ["barcode"]


def keyed_products(left: DataFrame, products: DataFrame, *columns: str | Column) -> DataFrame:
    """The products' ``product_key`` towards ``left`` and ``columns``."""
    return products.select(F.col("code").alias("barcode"), *product_key(left, products)[1:], *columns)
