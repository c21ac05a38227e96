"""Counts, shares and envelopes: hash aggregates with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import fixed
from larder.functions import paths

METRIC_TAGS = ["type", "annotation", "automatic_processing", "predictor", "reserved_barcode", "server_type"]


def insight_metrics(insights: DataFrame) -> DataFrame:
    """Count and share of total per combination of six columns."""
    return shares(insights.groupBy(*METRIC_TAGS).agg(F.count(F.lit(1)).alias("count")))


def shares(counts: DataFrame) -> DataFrame:
    """Adds each combination's share of the total."""
    # one row per combination of small enums is left here, so the unpartitioned window is tiny
    return counts.withColumn("percent", F.col("count") / F.sum("count").over(Window.partitionBy()))


def facet_metrics(products: DataFrame, facets: dict[str, str], country_column: str = "countries_tags") -> DataFrame:
    """Products and percent per (country, facet, tag); ``facets`` is name -> array column.

    Facets are stacked before the explode: one pass over the catalogue, one shuffle.
    """
    stacked = F.array(
        *[
            F.struct(F.lit(name).alias("facet"), F.coalesce(F.array_distinct(column), F.array().cast("array<string>")).alias("tags"))
            for name, column in facets.items()
        ]
    )
    base = products.select(F.explode(F.array_distinct(country_column)).alias("country"), stacked.alias("facets"))
    tags = base.select("country", F.explode("facets").alias("f")).select("country", "f.facet", F.explode("f.tags").alias("tag_id"))
    counts = tags.groupBy("country", "facet", "tag_id").agg(F.count(F.lit(1)).alias("products"))
    totals = base.groupBy("country").agg(F.count(F.lit(1)).alias("total"))
    return counts.join(totals, "country").select(
        "country", "facet", "tag_id", "products", (F.col("products") * 100 / F.col("total")).alias("percent")
    )


def metric_points(df: DataFrame, measurement: str, tags: list[str], fields: list[str], time: Column) -> DataFrame:
    """Rows to long metric points."""

    def as_map(names: list[str], kind: str) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast(kind) for n in names]))

    return df.select(
        F.lit(measurement).alias("measurement"), as_map(tags, "string").alias("tags"), time.alias("time"),
        as_map(fields, "double").alias("fields"),
    )


def unanswered_by_value(insights: DataFrame) -> DataFrame:
    return insights.groupBy("value_tag").agg(F.count("id").alias("count")).orderBy(F.desc("count"), F.asc_nulls_last("value_tag"))


def vote_tally(votes: DataFrame) -> DataFrame:
    """Votes per (insight, value); "ignore" votes (-1) never count."""
    return votes.where(F.col("value") != -1).groupBy("insight_id", "value").agg(F.count(F.lit(1)).alias("num_votes"))


def duplicate_groups(df: DataFrame, key: str = "source_image") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)


def brand_prefix_counts(products: DataFrame, threshold: int = fixed.BRAND_PREFIX_MIN_COUNT) -> DataFrame:
    """(brand, barcode prefix) pairs seen on at least ``threshold`` thirteen-digit products."""
    brands = F.filter(F.array_distinct("brands_tags"), lambda b: b.isNotNull() & (b != ""))
    rows = products.where(F.length("code") == 13).select(
        F.explode(brands).alias("brand_tag"), paths.barcode_prefix(F.col("code")).alias("prefix")
    )
    return rows.groupBy("brand_tag", "prefix").agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= threshold)


def keep_brand(brand_tag: Column, name: Column, blacklist: Column | None = None, min_length: int = 0) -> Column:
    """Not digits only, long enough, and (``blacklist`` flag) not excluded."""
    test = ~name.rlike("^[0-9]+$") & (F.length(name) >= min_length)
    return test if blacklist is None else test & ~blacklist


def brand_list(nodes: DataFrame, counts: DataFrame, blacklist: DataFrame, threshold: int = fixed.BRAND_MIN_COUNT,
               min_length: int = fixed.BRAND_MIN_LENGTH) -> DataFrame:
    """Dictionary lines of taxonomy brands that the catalogue uses often enough.

    ``nodes``: (id, name); ``counts``: (brand_tag, products).
    """
    key = F.regexp_replace("id", "^en:", "")
    named = nodes.select(key.alias("brand_tag"), "name").where(keep_brand(F.col("brand_tag"), F.col("name"), None, min_length))
    used = counts.where(F.col("products") >= threshold).select("brand_tag")
    return (
        named.join(used, "brand_tag", "left_semi").join(blacklist.select("brand_tag"), "brand_tag", "left_anti").orderBy("brand_tag")
    )


def generic_categories(products: DataFrame, closure: DataFrame, min_total: int = 10_000, min_share: float = 0.8) -> DataFrame:
    """Categories that are mostly not the deepest one of the products carrying them.

    ``products``: (code, categories_tags); ``closure``: (ancestor, descendant) without self.
    """
    own = products.select("code", F.explode(F.array_distinct("categories_tags")).alias("category"))
    parents = own.join(closure, own["category"] == closure["descendant"]).select("code", F.col("ancestor").alias("category"), F.lit(1).alias("covered"))
    closed = own.withColumn("covered", F.lit(0)).unionByName(parents)
    # one row per (product, category); covered = 1 when a deeper category of the product implies it
    per_product = closed.groupBy("code", "category").agg(F.max("covered").alias("covered"))
    stats = per_product.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.sum("covered").alias("not_deepest"))
    share = F.col("not_deepest") / F.col("total")
    return stats.withColumn("share", share).where((F.col("total") >= min_total) & (F.col("share") >= min_share))


def product_languages(image_langs: DataFrame) -> DataFrame:
    """Word counts per (product, language) over images, with percent of all words.

    ``image_langs``: (barcode, counts map) where key ``words`` is the total.
    """
    rows = image_langs.select("barcode", F.explode("counts").alias("lang", "n"))
    sums = rows.groupBy("barcode", "lang").agg(F.sum("n").alias("count"))
    words = sums.where(F.col("lang") == "words").select("barcode", F.col("count").alias("words"))
    return sums.where(F.col("lang") != "words").join(words, "barcode").withColumn(
        "percent", F.col("count") * 100 / F.col("words")
    )


def image_language_share(counts: Column) -> Column:
    """``map<lang,count>`` with ``words`` to percents without it."""
    words = F.try_element_at(counts, F.lit("words"))
    langs = F.map_filter(counts, lambda k, v: k != "words")
    return F.transform_values(langs, lambda k, v: v * 100 / words)


def orientation_mode(words: DataFrame, *keys: str) -> DataFrame:
    """Most common word orientation and the counts; images without words are unknown."""
    keys = keys or ("source_image",)
    counts = words.groupBy(*keys, "orientation").agg(F.count("orientation").alias("n"))
    return counts.groupBy(*keys).agg(
        F.coalesce(F.max_by("orientation", F.when(F.col("n") > 0, F.struct("n", "orientation"))), F.lit("unknown")).alias("orientation"),
        F.map_from_entries(F.collect_list(F.when(F.col("n") > 0, F.struct("orientation", "n")))).alias("count"),
    )


def user_statistics(insights: DataFrame) -> DataFrame:
    return insights.where(F.col("annotation").isNotNull()).groupBy("username").agg(F.count(F.lit(1)).alias("count"))


def bounded_count(df: DataFrame, max_count: int | None = None) -> DataFrame:
    """One-row count that stops reading at ``max_count``."""
    return (df if max_count is None else df.limit(max_count)).agg(F.count(F.lit(1)).alias("count"))


def distinct_barcodes(predictions: DataFrame, type: str | None = None) -> DataFrame:
    rows = predictions if type is None else predictions.where(F.col("type") == type)
    return rows.select("barcode").distinct()


def minmax_bounds(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def import_counts(change_set: DataFrame) -> DataFrame:
    return change_set.groupBy("type", "op").agg(F.count(F.lit(1)).alias("count"))


def value_conflict_flag(predictions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Matcher subtypes of a product that disagree on the value."""
    key = key or ["barcode", "server_type", "matcher_type"]
    # min <> max needs no distinct set
    return predictions.groupBy(*key).agg(
        (~F.min("value").eqNullSafe(F.max("value")) | ((F.count("value") > 0) & (F.count("value") < F.count(F.lit(1))))).alias("conflict")
    )
