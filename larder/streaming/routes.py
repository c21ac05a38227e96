"""Event routing and debouncing; the same functions take batch and streaming frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder import fixed, schemas
from larder.functions import paths


def stream_events(spark: SparkSession, path: str, schema: str = schemas.PRODUCT_UPDATE, files_per_trigger: int | None = None) -> DataFrame:
    """File source of JSON events; the checkpoint of the query keeps the position."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def stream_events_kafka(spark: SparkSession, servers: str, topic: str, since_ms: int | None = None, schema: str = schemas.PRODUCT_UPDATE) -> DataFrame:
    """Kafka source; ``since_ms`` replays from a timestamp."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if since_ms is not None:
        reader = reader.option("startingTimestamp", str(since_ms))
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")


def replay_events(events: DataFrame, since: str) -> DataFrame:
    return events.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))


def stream_route(events: DataFrame, own_user: str = "larder-app", own_marker: str = "[larder]", bulk_users: Sequence[str] = tuple(fixed.BULK_USERS)) -> DataFrame:
    """Classify product updates; dropped events do not come out.

    Adds server_type, action_kind (delete_product, image_upload, type_switch,
    image_delete, refresh), image_id, priority and delay in seconds.
    """
    diffs = F.from_json("diffs", schemas.DIFFS)
    added = F.try_element_at(diffs["uploaded_images"]["add"], F.lit(1))
    deleted = F.try_element_at(diffs["uploaded_images"]["delete"], F.lit(1))
    switched = F.array_contains(diffs["fields"]["change"], "product_type")
    own = F.coalesce((F.col("user_id") == own_user) | F.contains(F.col("comment"), F.lit(own_marker)), F.lit(False))
    usable = F.col("product_type").isNotNull() & (F.coalesce("code", F.lit("")) != "") & F.col("action").isin("deleted", "updated")
    kind = (
        F.when(F.col("action") == "deleted", "delete_product").when(added.isNotNull(), "image_upload")
        .when(switched, "type_switch").when(deleted.isNotNull(), "image_delete").otherwise("refresh")
    )
    out = events.where(usable & ~own).withColumns(
        {
            "server_type": paths.server_of_product_type(F.col("product_type")), "action_kind": kind,
            "priority": F.when(F.col("user_id").isin(list(bulk_users)), "low").otherwise("high"),
        }
    )
    wait = fixed.UPDATED_PRODUCT_WAIT_SECONDS
    return out.withColumns(
        {
            "image_id": F.when(F.col("action_kind") == "image_upload", added).when(F.col("action_kind") == "image_delete", deleted),
            "delay_seconds": F.when(F.col("action_kind").isin("type_switch", "image_delete", "refresh"), wait).otherwise(0),
        }
    )


def _tasks(names: Sequence[str]):
    return F.array(*[F.lit(n) for n in names])


def upload_tasks(routed: DataFrame) -> DataFrame:
    """Work rows of image uploads: what does not need the text; food-only tasks for food."""
    rows = routed.where((F.col("action_kind") == "image_upload") & F.col("image_id").isNotNull())
    rows = rows.select("timestamp", F.col("code").alias("barcode"), "server_type", "image_id", "priority", F.explode(_tasks(fixed.UPLOAD_TASKS)).alias("task"))
    food_only = F.col("task") == "run_nutrition_table_object_detection"
    return rows.where(~food_only | paths.is_food_server(F.col("server_type")))


def stream_ocr_ready(events: DataFrame) -> DataFrame:
    """Work rows of text-ready events: the tasks that need the text."""
    rows = events.where((F.coalesce("code", F.lit("")) != "") & F.col("image_id").isNotNull())
    rows = rows.withColumn("server_type", paths.server_of_product_type(F.col("product_type")))
    rows = rows.select("timestamp", F.col("code").alias("barcode"), "server_type", "image_id", F.explode(_tasks(fixed.OCR_TASKS)).alias("task"))
    return rows.where((F.col("task") == "run_logo_object_detection") | paths.is_food_server(F.col("server_type")))


def pair_uploads(uploads: DataFrame, ready: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Stream-stream join of uploads and their text-ready events within the watermark."""
    left = uploads.withWatermark("timestamp", watermark).select(F.col("code").alias("barcode"), "image_id", F.col("timestamp").alias("uploaded_at"))
    right = ready.withWatermark("timestamp", watermark).select(F.col("code").alias("r_code"), F.col("image_id").alias("r_image"), F.col("timestamp").alias("ready_at"))
    cond = (F.col("barcode") == F.col("r_code")) & (F.col("image_id") == F.col("r_image"))
    near = F.expr(f"ready_at BETWEEN uploaded_at - INTERVAL {watermark} AND uploaded_at + INTERVAL {watermark}")
    return left.join(right, cond & near).drop("r_code", "r_image")


def stream_delayed_refresh(routed: DataFrame, gap: str = "10 seconds", watermark: str = "10 minutes", key: Sequence[str] = ("code", "server_type"), time: str = "timestamp") -> DataFrame:
    """One refresh per product and burst of updates: session windows closed by the watermark."""
    rows = routed.withWatermark(time, watermark) if routed.isStreaming else routed
    return rows.groupBy(F.session_window(time, gap), *key).agg(F.count(F.lit(1)).alias("n_updates")).select(
        *key, F.col("session_window.start").alias("first_at"), F.col("session_window.end").alias("due_at"), "n_updates"
    )


def stream_serialize_product(events: DataFrame, partitions: int, key: str = "code") -> DataFrame:
    """All events of a product in one partition, with its stable queue number."""
    return events.withColumn("queue", paths.hash_partition(F.col(key), partitions)).repartition(partitions, "queue")


def stream_category_trigger(events: DataFrame) -> DataFrame:
    """Adds ``rerun``: name, ingredients, nutrition or images changed (or no diffs at all)."""
    diffs = F.from_json("diffs", schemas.DIFFS)
    touched = F.array(F.lit("product_name"), F.lit("ingredients_text"))

    def overlaps(part: str):
        return F.coalesce(F.arrays_overlap(diffs["fields"][part], touched), F.lit(False))

    images = diffs["uploaded_images"]
    rerun = (
        F.col("diffs").isNull() | diffs["nutriments"].isNotNull() | diffs["nutrition"].isNotNull()
        | images["add"].isNotNull() | images["delete"].isNotNull() | overlaps("change") | overlaps("add")
    )
    return events.withColumn("rerun", rerun)


def stream_apply(routed: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = True):
    """Run the batch operators per micro-batch and event kind.

    A handler gets (rows of its kind, epoch).  Handlers that write should use the epoch to
    stay idempotent when a batch is replayed after a failure.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            for kind, handle in handlers.items():
                handle(kept.where(F.col("action_kind") == kind), epoch)
        finally:
            kept.unpersist()

    writer = routed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
