"""Scans: dumps, archives, dictionaries, taxonomies and vectors as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import fixed, schemas
from larder.functions import paths


def scan_products_jsonl(
    spark: SparkSession, path: str, schema: str = schemas.PRODUCT, partitions: int | None = None,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """Plain or gzip JSON lines.  A gzip file is one task; pass ``partitions`` to spread it."""
    df = spark.read.schema(schema).option("mode", mode).json(path)
    return df.repartition(partitions) if partitions else df


def scan_products_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def raw_image_ids(images: Column) -> Column:
    """Digit keys of an image map."""
    return F.filter(F.map_keys(images), lambda k: k.rlike("^[0-9]+$"))


def scan_product_project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Projection; ``image_ids`` is derived from the image map."""
    cols = [
        F.coalesce(raw_image_ids(F.col("images")), F.array().cast("array<string>")).alias("image_ids")
        if f == "image_ids"
        else F.col(f)
        for f in fields
    ]
    return df.select(*cols)


_LIST_FIELDS = ["countries_tags", "categories_tags", "emb_codes_tags", "labels_tags", "brands_tags", "stores_tags", "packagings"]


def product_defaults(df: DataFrame) -> DataFrame:
    """Document to product row: empty lists, zero scans, texts keyed by language."""
    types = dict(df.dtypes)
    out = {}
    for name in _LIST_FIELDS:
        if name in types:
            out[name] = F.coalesce(F.col(name), F.array().cast(types[name]))
    for name in ("quantity", "expiration_date"):
        if name in types:
            out[name] = F.nullif(F.col(name), F.lit(""))
    if "unique_scans_n" in types:
        out["unique_scans_n"] = F.coalesce(F.col("unique_scans_n"), F.lit(0))
    out["schema_version"] = F.coalesce(F.col("schema_version"), F.lit(999)) if "schema_version" in types else F.lit(999)
    if "images" in types:
        out["image_ids"] = F.coalesce(raw_image_ids(F.col("images")), F.array().cast("array<string>"))
    texts = [c for c in df.columns if c.startswith("ingredients_text")]
    if texts and all(types[c] == "string" for c in texts):
        langs = F.array(*[F.lit("main" if c == "ingredients_text" else c.rsplit("_", 1)[-1]) for c in texts])
        filled = F.map_filter(
            F.map_from_arrays(langs, F.array(*[F.col(c) for c in texts])), lambda k, v: F.coalesce(v, F.lit("")) != ""
        )
        return df.withColumns(out).withColumn("ingredients_by_lang", filled).drop(*texts).withColumnRenamed(
            "ingredients_by_lang", "ingredients_text"
        )
    return df.withColumns(out)


_KNOWN_FIELDS = [
    "code", "countries_tags", "categories_tags", "emb_codes_tags", "labels_tags", "quantity", "expiration_date",
    "brands_tags", "stores_tags", "unique_scans_n", "images", "lang", "nutriments", "nutrition_data_per",
    "nutrition_data_prepared", "serving_size",
]


def minify_products(df: DataFrame, known: Sequence[str] = tuple(_KNOWN_FIELDS)) -> DataFrame:
    return df.select([c for c in df.columns if c in known or c.startswith("ingredients_text")])


def product_lookup(products: DataFrame, keys: DataFrame, key: Sequence[str] = ("code",), fields: Sequence[str] | None = None) -> DataFrame:
    """Requested keys with their product columns (null when absent)."""
    fields = [c for c in (fields or products.columns) if c not in key]
    right = products.select(*key, *fields, F.lit(True).alias("found"))
    return keys.join(right, list(key), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def _usable_response(response: Column) -> Column:
    return response["error"].isNull()


def scan_ocr_archive(df: DataFrame) -> DataFrame:
    """Archive rows ``{source, content}`` to ``(barcode, source_image, response)``."""
    source = F.regexp_replace(F.replace(F.col("source"), F.lit("//"), F.lit("/")), r"\.json$", ".jpg")
    barcode = F.regexp_replace(F.regexp_extract(source, r"^/?((?:[0-9]+/)+)[^/]+$", 1), "/", "")
    responses = F.col("content.responses")
    return (
        df.where(F.col("content").isNotNull())
        .withColumns({"source_image": source, "barcode": barcode, "response": F.try_element_at(responses, F.lit(1))})
        .where((F.col("barcode") != "") & F.col("response").isNotNull() & _usable_response(F.col("response")))
        .select("barcode", "source_image", "response")
    )


def scan_ocr_files(files: DataFrame) -> DataFrame:
    """Listing ``(path, modificationTime, content)`` to one newest document per image.

    ``max_by`` keeps the pick a partial aggregate: no sort and no window group.
    """
    stem = F.regexp_replace(F.col("path"), r"\.json(\.gz)?$", "")
    newest = files.where(F.col("path").rlike(r"\.json(\.gz)?$")).groupBy(stem.alias("stem")).agg(
        F.max_by(F.struct("path", "content", "modificationTime"), F.struct("modificationTime", "path")).alias("f")
    )
    return newest.select(
        "stem", "f.path", "f.content", F.unix_micros(F.col("f.modificationTime")).alias("created_us")
    )


def parse_ocr_json(df: DataFrame, column: str = "content") -> DataFrame:
    """Undecodable documents and error responses are dropped."""
    parsed = df.withColumn("ocr", F.from_json(F.col(column), schemas.OCR_CONTENT))
    first = F.try_element_at(F.col("ocr.responses"), F.lit(1))
    return parsed.withColumn("response", first).where(F.col("response").isNotNull() & _usable_response(F.col("response")))


def ocr_extract_text(df: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``text`` (full text, else the first annotation) and ``text_contiguous``."""
    r = F.col(response)
    text = F.coalesce(r["fullTextAnnotation"]["text"], F.try_element_at(r["textAnnotations"], F.lit(1))["description"])
    return df.withColumn("text", text).where(F.col("text").isNotNull()).withColumn(
        "text_contiguous", F.regexp_replace("text", "\r\n|\n|\r", " ")
    )


def accepted_types(df: DataFrame, accepted: Sequence[str] = tuple(fixed.PREDICTION_TYPES)) -> DataFrame:
    """An unknown type value is an error, as an enum cast would be."""
    checked = F.when(F.col("type").isin(list(accepted)), F.col("type")).otherwise(
        F.raise_error(F.concat(F.lit("unknown prediction type: "), F.coalesce("type", F.lit("null")))).cast("string")
    )
    return df.withColumn("type", checked)


def scan_predictions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return accepted_types(spark.read.schema(schemas.PREDICTION).json(path))


def dictionary_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``key||name[||pattern]`` lines to ``(key, name, pattern)``; other arities are errors."""
    text = F.trim(F.col(column))
    parts = F.split(text, r"\|\|")
    n = F.size(parts)
    bad = F.raise_error(F.concat(F.lit("invalid dictionary line: "), text)).cast("string")
    return lines.where((text != "") & ~text.startswith("//")).select(
        F.when(n.between(2, 3), parts[0]).otherwise(bad).alias("key"),
        parts[1].alias("name"),
        F.when(n == 3, F.try_element_at(parts, F.lit(3))).otherwise(parts[1]).alias("pattern"),
    )


def scan_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return dictionary_lines(spark.read.text(path))


def taxonomy_nodes(raw: DataFrame, column: str = "value") -> DataFrame:
    """One JSON object ``id -> node`` per row to node rows."""
    parsed = F.from_json(F.col(column), f"map<string,{schemas.TAXONOMY_NODE}>")
    return raw.select(F.explode(parsed).alias("id", "n")).select("id", "n.*")


def scan_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomy documents are a few MB of one JSON object: one row per file."""
    return taxonomy_nodes(spark.read.option("wholetext", "true").text(path))


def scan_detections_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DETECTION).json(path)


def image_prediction_rows(df: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Bulk import rows: derived source image and one timestamp for the run."""
    return df.withColumns(
        {
            "source_image": paths.image_path(F.col("barcode"), F.col("image_id")),
            "timestamp": F.current_timestamp() if stamp is None else stamp,
        }
    )


def scan_vectors(df: DataFrame, column: str = "embedding", dim: int = 512) -> DataFrame:
    """Vectors of the right size with at least one non-zero element."""
    v = F.col(column)
    return df.where((F.size(v) == dim) & F.exists(v, lambda x: x != 0)).withColumn(column, v.cast("array<float>"))


def scan_predictions_for_products(
    predictions: DataFrame, barcodes: DataFrame, server_type: str = "off", types: Sequence[str] | None = None
) -> DataFrame:
    out = predictions.where(F.col("server_type") == server_type)
    if types is not None:
        out = out.where(F.col("type").isin(list(types)))
    return out.join(barcodes.select("barcode"), "barcode", "left_semi")


def dataset_integrity_check(df: DataFrame, min_rows: int = fixed.DATASET_MIN_ROWS) -> DataFrame:
    """One-row report; read with ``mode=FAILFAST`` so a broken line fails the scan."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("valid", F.col("n_rows") >= min_rows)
