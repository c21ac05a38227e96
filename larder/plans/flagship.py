"""The smallest whole path: texts to counted change set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import changeset, extractors
from larder.operators.aggregates import import_counts
from larder.plans import roles  # noqa: F401
from larder.plans.registry import Data


def label_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Labels read from all texts, chosen per document against the stored label rows."""
    d = Data(spark, folder)
    dictionary = spark.createDataFrame(
        [("en:no-preservatives", "No preservatives", "sans conservateur"), ("en:organic", "Organic", "ingredients biologiques")],
        "key string, name string, pattern string",
    )
    found = extractors.extract_label(d.ocr_text, dictionary)
    rows = found.withColumns(
        {
            "barcode": F.col("doc_id").cast("string"), "server_type": F.lit("off"), "source_image": F.lit(None).cast("string"),
            "priority": F.lit(1), "id": F.sha2(F.concat_ws("|", "doc_id", "value_tag", "predictor", "start"), 256),
        }
    )
    stored = d.insight.where("type = 'label'")
    return import_counts(changeset.merge_candidates(rows, stored, ["value_tag"])).orderBy("type", "op")
