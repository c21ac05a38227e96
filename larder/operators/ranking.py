"""Order, top-k and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions import paths

PRODUCT_TYPE = ["barcode", "server_type", "type"]


def priority_of(data: Column) -> Column:
    """``priority`` of a JSON or struct ``data`` column; default 1."""
    return F.coalesce(F.get_json_object(data, "$.priority").cast("int"), F.lit(1))


def prediction_rank(priority: str = "priority", tiebreak: str = "id") -> list[Column]:
    """Priority, newest image, predictor (none last), all ascending; ``tiebreak`` keeps it deterministic."""
    return [
        F.coalesce(priority, F.lit(1)),
        -paths.image_rank(F.col("source_image")),
        F.coalesce(F.nullif(F.col("predictor"), F.lit("")), F.lit("z")),
        F.col(tiebreak),
    ]


def prediction_order(priority: str = "priority", tiebreak: str = "id") -> list[Column]:
    return [c.asc() for c in prediction_rank(priority, tiebreak)]


def candidate_order(priority: str = "priority", tiebreak: str = "id") -> list[Column]:
    """As predictions, with automatic rows first after the image."""
    order = prediction_order(priority, tiebreak)
    automatic = F.when(F.coalesce("automatic_processing", F.lit(False)), 0).otherwise(1)
    return [*order[:2], automatic.asc(), *order[2:]]


def packaging_order(tiebreak: str = "id") -> list[Column]:
    """More element properties first."""
    return [F.col("n_properties").desc(), F.col(tiebreak).asc()]


def ranked(df: DataFrame, order: list[Column], partition: list[str] | None = None, name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*(partition or PRODUCT_TYPE)).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window))


def rank_predictions(df: DataFrame, partition: list[str] | None = None) -> DataFrame:
    return ranked(df, prediction_order(), partition)


def rank_candidates(df: DataFrame, partition: list[str] | None = None) -> DataFrame:
    return ranked(df, candidate_order(), partition)


def rank_packaging(df: DataFrame, partition: list[str] | None = None) -> DataFrame:
    return ranked(df, packaging_order(), partition)


def best_per(df: DataFrame, keys: list[str], order: list[Column], extra: dict[str, Column] | None = None) -> DataFrame:
    """First row per key.

    ``row_number() = 1`` is planned with a per-partition group limit before the
    shuffle, so a hot key moves at most one row per map task.
    """
    out = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")
    return out.withColumns(extra) if extra else out


def last_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last row per key in ``order``."""
    place = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    return df.withColumns({"__rn": F.row_number().over(place), "__n": F.count("*").over(whole)}).where("__rn = __n").drop("__rn", "__n")


def first_per_product(df: DataFrame) -> DataFrame:
    return best_per(df, PRODUCT_TYPE, prediction_order())


def latest_value(df: DataFrame) -> DataFrame:
    """Greatest value per product, of equal ones the best ranked; any disagreement makes it not automatic.

    ``min_by`` + min/max are partial aggregates: no sort of the group.
    """
    row = F.struct(*df.columns)
    rank = F.struct(*[c.alias(f"r{k}") for k, c in enumerate(prediction_rank())])
    per_value = df.groupBy(*PRODUCT_TYPE, "value").agg(F.min_by(row, rank).alias("best"))
    agg = per_value.groupBy(*PRODUCT_TYPE).agg(F.max_by("best", "value").alias("best"), F.count("value").alias("__values"))
    return agg.select("best.*", "__values").withColumn(
        "automatic_processing", F.when(F.col("__values") == 1, F.col("automatic_processing")).otherwise(False)
    ).drop("__values")


def order_insights(df: DataFrame, by: str | None, seed: int | None = None, tiebreak: str = "id") -> DataFrame:
    """``popularity``, ``n_votes``, ``confidence`` (nulls last) or ``random`` weighted by votes + 1."""
    if by is None:
        return df
    if by == "random":
        weight = F.rand(seed) if seed is not None else F.rand()
        return df.orderBy((weight * (F.col("n_votes") + 1)).desc())
    columns = {"popularity": "unique_scans_n", "n_votes": "n_votes", "confidence": "confidence"}
    if by not in columns:
        raise ValueError(f"unknown order: {by}")
    # databases put nulls first when descending; only confidence asks for nulls last
    key = F.col(columns[by])
    return df.orderBy(key.desc_nulls_last() if by == "confidence" else key.desc_nulls_first(), F.col(tiebreak).asc())


def question_type_rank(column: str = "type") -> Column:
    return F.when(F.col(column) == "category", 0).when(F.col(column) == "label", 1).when(F.col(column) == "brand", 2).otherwise(3)


def rank_question_types(df: DataFrame, tiebreak: str = "id") -> DataFrame:
    return df.orderBy(question_type_rank().asc(), F.col(tiebreak).asc())


def page(df: DataFrame, number: int, count: int) -> DataFrame:
    return df.offset((number - 1) * count).limit(count)


def recent_images_k(products: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` greatest raw image ids of each product."""
    ids = F.array_sort(F.transform("image_ids", lambda i: i.cast("long")), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    return products.select(
        F.col("code").alias("barcode"), F.transform(F.slice(ids, 1, k), lambda i: i.cast("string")).alias("recent_ids")
    )


def oldest_of_duplicates(df: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """Rows to delete: all but the lowest id of each duplicate group."""
    # the lowest id is a partial aggregate, so a huge group of copies is never sorted in one task
    kept = df.groupBy(*key).agg(F.min(id_col).alias(id_col))
    return df.join(kept.select(id_col), id_col, "left_anti")


def newest_images_first(images: DataFrame, limit: int | None = None) -> DataFrame:
    out = images.orderBy(F.col("uploaded_at").desc_nulls_last(), F.col("id").desc())
    return out if limit is None else out.limit(limit)


def keyset_batches(df: DataFrame, column: str, partitions: int) -> DataFrame:
    """Range-partitioned scan in key order: what block-wise walks are for."""
    return df.repartitionByRange(partitions, column)


def random_sample_one(embeddings: DataFrame, logos: DataFrame, fraction: float = 0.2, seed: int | None = None) -> DataFrame:
    drawn = embeddings.sample(fraction=fraction, seed=seed).select("logo_id")
    return drawn.join(logos.select(F.col("id").alias("logo_id")), "logo_id", "left_semi").limit(1)


def shuffle_order(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed) if seed is not None else F.rand())


def top_batch_extract(products: DataFrame, limit: int | None, min_fraction: float = 0.0, max_fraction: float = 0.4) -> DataFrame:
    """Main texts of popular products whose unknown share is in (min, max], all or the first ``limit``.

    ``ingredients_text`` is ``array<struct<lang,text>>``; order + limit plans as a
    take-ordered per partition.
    """
    main = F.try_element_at(F.filter("ingredients_text", lambda x: x["lang"] == "main"), F.lit(1))
    fraction = F.try_divide(F.col("unknown_ingredients_n"), F.col("ingredients_n"))
    rows = (
        products.select("code", main["text"].alias("text"), "lang", fraction.alias("fraction"), "popularity_key")
        .where((F.col("fraction") > min_fraction) & (F.col("fraction") <= max_fraction) & (F.col("text") != ""))
        .orderBy(F.col("popularity_key").desc_nulls_last(), "code")
    )
    return (rows if limit is None else rows.limit(limit)).drop("popularity_key")


