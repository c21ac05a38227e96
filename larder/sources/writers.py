"""Sinks.  Row counts come from ``observe`` so nothing is scanned twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

MAX_DUMP_ROWS = 10_000


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> int:
    out, seen = _counted(df)
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return seen.get["n"]


def sink_jsonl(df: DataFrame, path: str, compressed: bool = True, mode: str = "overwrite") -> int:
    out, seen = _counted(df)
    out.write.mode(mode).option("compression", "gzip" if compressed else "none").json(path)
    return seen.get["n"]


def sink_csv_dump(df: DataFrame, path: str, count: int | None = None, refuse_above: int | None = None, mode: str = "overwrite") -> int:
    """All rows, or ``count`` of them; ``refuse_above`` turns larger selections down (interactive callers pass ``MAX_DUMP_ROWS``)."""
    if count is None and refuse_above is not None and df.limit(refuse_above + 1).count() > refuse_above:
        raise ValueError(f"more than {refuse_above} rows: pass an explicit count")
    out, seen = _counted(df if count is None else df.limit(count))
    out.write.mode(mode).option("header", "true").csv(path)
    return seen.get["n"]


def sink_text(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> int:
    out, seen = _counted(df.select(F.col(column).cast("string").alias("value")))
    out.write.mode(mode).text(path)
    return seen.get["n"]


def sink_metrics(points: DataFrame, path: str) -> int:
    """Append metric points ``(measurement, tags, time, fields)`` by day."""
    return sink_parquet(points.withColumn("day", F.to_date("time")), path, "append", ["measurement", "day"])


# fixed values: columns needed to draw logo crops elsewhere
LOGO_EXPORT_COLUMNS = [
    "id", "index", "bounding_box", "score", "annotation_type", "annotation_value",
    "annotation_value_tag", "taxonomy_value", "username", "source_image", "barcode",
]


def logo_export(logos: DataFrame) -> DataFrame:
    return logos.select([c for c in LOGO_EXPORT_COLUMNS if c in logos.columns])


def sink_logo_export(logos: DataFrame, path: str) -> int:
    return sink_jsonl(logo_export(logos), path)


def sink_batch_insert(df: DataFrame, path: str) -> int:
    return sink_parquet(df, path, "append")
