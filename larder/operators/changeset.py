"""Change sets: what to create, update and delete on the insight table.

A conflict rule is expressed as key columns.  Candidates and existing rows conflict
when their keys are equal (null equals null), so the greedy selection "best ranked
first, drop what conflicts" is a first-row-per-key, and blocking and matching are
joins on the key.  Rules over a taxonomy expand the existing rows to the tags they
block.  Nothing compares rows pairwise inside a product.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import fixed
from larder.functions import boxes, paths
from larder.operators.dedup import IDENTITY
from larder.operators.filters import valid_image, valid_insight_image
from larder.operators.keys import keyed_products, product_key
from larder.operators.ranking import best_per, candidate_order, last_per

GROUP = ["barcode", "server_type", "type"]


def is_blocking() -> Column:
    """Annotated or soon-applied rows stay and block conflicting candidates."""
    return F.col("annotation").isNotNull() | F.coalesce(F.col("automatic_processing"), F.lit(False))


def _safe_on(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right["r_" + c]) for c in columns])


def _prefixed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select([F.col(c).alias("r_" + c) for c in columns])


def expand_by_closure(references: DataFrame, closure: DataFrame, tag: str = "value_tag") -> DataFrame:
    """Existing rows under their own tag and every ancestor tag."""
    up = references.join(closure.withColumnRenamed("descendant", tag), tag).drop(tag).withColumnRenamed("ancestor", tag)
    return references.unionByName(up)


def merge_candidates(
    candidates: DataFrame,
    references: DataFrame,
    keys: Sequence[str],
    order: list[Column] | None = None,
    closure: DataFrame | None = None,
    group: Sequence[str] = tuple(GROUP),
    dealt: bool = False,
) -> DataFrame:
    """(group..., op, candidate_id, insight_id) for one conflict rule.

    ``candidates`` carry ``id``, the ``keys`` and the order columns; ``references`` are
    the existing rows of the same products and type.  With ``closure`` the single key
    is a tag and a candidate also conflicts with existing descendants of its tag.
    ``dealt``: both frames lie by columns of ``group`` already, and are compared where they lie
    instead of being dealt again by their keys.
    """
    group, keys = list(group), list(keys)
    on = [*group, *keys]
    winners = best_per(candidates, on, order or candidate_order())

    slim = references.select(*dict.fromkeys([*group, *keys, "source_image"]), F.col("id"), is_blocking().alias("blocking"), F.col("annotation").isNull().alias("open"))
    wide = slim if closure is None else expand_by_closure(slim, closure, keys[0])

    match_on = list(dict.fromkeys([*on, "source_image"]))
    if dealt:
        return _with_deletions(slim, _placed_together(winners, wide, on, match_on).select(*group, "op", "candidate_id", "insight_id"), group, candidates)

    blocked = _prefixed(wide.where("blocking"), on)
    free = winners.join(blocked, _safe_on(winners, blocked, on), "left_anti")

    mapped = wide.where("open").groupBy(*match_on).agg(F.min("id").alias("insight_id"))
    mapped = mapped.select(*[F.col(c).alias("r_" + c) for c in match_on], "insight_id")
    placed = free.join(mapped, _safe_on(free, mapped, match_on), "left").select(
        *group,
        F.when(F.col("insight_id").isNull(), "create").otherwise("update").alias("op"),
        F.col("id").alias("candidate_id"),
        "insight_id",
    )
    return _with_deletions(slim, placed, group, candidates)


def _placed_together(winners: DataFrame, references: DataFrame, on: list[str], match_on: list[str]) -> DataFrame:
    """Winners that nothing blocks with the row they update: rows of both are one frame, windows over the keys compare them."""
    types = dict(winners.dtypes)
    new = winners.select(*match_on, F.col("id").alias("candidate_id"), F.lit(None).cast(dict(references.dtypes)["id"]).alias("__row"), F.lit(False).alias("blocking"), F.lit(True).alias("__new"))
    old = references.select(*[F.col(c).cast(types[c]).alias(c) for c in match_on], F.lit(None).cast(types["id"]).alias("candidate_id"), F.when(F.col("open"), F.col("id")).alias("__row"), "blocking", F.lit(False).alias("__new"))
    both = new.unionByName(old).withColumns({"__blocked": F.bool_or("blocking").over(Window.partitionBy(*on)), "insight_id": F.min("__row").over(Window.partitionBy(*match_on))})
    return both.where("__new AND NOT __blocked").withColumn("op", F.when(F.col("insight_id").isNull(), "create").otherwise("update"))


def _with_deletions(references: DataFrame, placed: DataFrame, group: list[str], candidates: DataFrame) -> DataFrame:
    """``placed`` and the existing rows that neither block nor are updated.

    Both meet by the existing row in its group, so that ``placed`` is worked out once; new rows stand alone there.
    """
    id_type = dict(candidates.dtypes)["id"]
    free = references.where(~F.col("blocking")).select(*group, F.lit("delete").alias("op"), F.lit(None).cast(id_type).alias("candidate_id"), F.col("id").alias("insight_id"))
    row = Window.partitionBy(*group, "insight_id", F.when(F.col("op") == "create", F.col("candidate_id")))
    both = placed.unionByName(free).withColumn("__updated", F.bool_or(F.col("op") == "update").over(row))
    return both.where((F.col("op") != "delete") | ~F.col("__updated")).drop("__updated")


def merge_newer_image(candidates: DataFrame, references: DataFrame, order: list[Column] | None = None,
                      group: Sequence[str] = tuple(GROUP)) -> DataFrame:
    """Nutrient extraction rule: one row per product, except that a candidate from a
    newer image may stand beside annotated rows."""
    group = list(group)
    image = paths.image_id(F.col("source_image")).cast("long")
    annotated = F.col("annotation").isNotNull()
    slim = references.select(*group, "id", "source_image", is_blocking().alias("blocking"), (~annotated).alias("open"), annotated.alias("annotated"), image.alias("image"))
    wall = slim.where("blocking").groupBy(*group).agg(
        F.bool_or(~F.col("annotated") | F.col("image").isNull()).alias("all_blocked"), F.max("image").alias("newest")
    )
    passed = F.col("all_blocked").isNull() | (~F.col("all_blocked") & (image > F.col("newest")))
    free = candidates.join(wall, group, "left").where(F.coalesce(passed, F.lit(False))).drop("all_blocked", "newest")
    winners = best_per(free, group, order or candidate_order())
    match_on = [*group, "source_image"]
    mapped = slim.where("open").groupBy(*match_on).agg(F.min("id").alias("insight_id"))
    mapped = mapped.select(*[F.col(c).alias("r_" + c) for c in match_on], "insight_id")
    placed = winners.join(mapped, _safe_on(winners, mapped, match_on), "left").select(
        *group, F.when(F.col("insight_id").isNull(), "create").otherwise("update").alias("op"), F.col("id").alias("candidate_id"), "insight_id"
    )
    return _with_deletions(slim, placed, group, candidates)


def generate_insights(candidates: DataFrame, products: DataFrame) -> DataFrame:
    """Checks and conversions every candidate passes before selection.

    Missing product or bad image: dropped.  Null automatic: false.  Absolute boxes become
    relative (``bounding_box_absolute`` with the image size from the product).
    """
    images = F.col("images").alias("__images") if "images" in products.columns else F.lit(None).alias("__images")
    out = candidates.join(keyed_products(candidates, products, "image_ids", images), product_key(candidates, products)).where(valid_insight_image(F.col("source_image"), F.col("image_ids")))
    out = out.withColumn("automatic_processing", F.coalesce("automatic_processing", F.lit(False)))
    if "bounding_box_absolute" in candidates.columns and "images" in products.columns:
        size = F.try_element_at(F.try_element_at(F.col("__images"), paths.image_id(F.col("source_image")))["sizes"], F.lit("full"))
        relative = boxes.to_relative(F.col("bounding_box_absolute"), size["w"], size["h"])
        own = F.col("bounding_box") if "bounding_box" in candidates.columns else F.lit(None).cast("array<double>")
        out = out.withColumn("bounding_box", F.coalesce(own, relative)).drop("bounding_box_absolute")
    return out.drop("image_ids", "__images")


def deletions_of_missing_products(references: DataFrame, products: DataFrame) -> DataFrame:
    """All rows of vanished products go, annotated ones too."""
    gone = references.join(keyed_products(references, products), product_key(references, products), "left_anti")
    return gone.select(*GROUP, F.lit("delete").alias("op"), F.lit(None).cast("string").alias("candidate_id"), F.col("id").alias("insight_id"))


def stamp_fields(candidates: DataFrame, products: DataFrame, stamp: Column | None = None, wait_minutes: int = fixed.AUTOMATIC_WAIT_MINUTES) -> DataFrame:
    """Mandatory columns of new rows.

    The id is a digest of the natural key, so a re-run after a lost executor writes the
    same rows.
    """
    stamp = F.current_timestamp() if stamp is None else stamp
    right = keyed_products(
        candidates, products, F.col("countries_tags").alias("countries"), F.col("brands_tags").alias("brands"),
        "unique_scans_n", (F.size("image_ids") > 0).alias("__has_image"),
    )
    natural = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (*GROUP, "value_tag", "value", "source_image", "predictor")]), 256)
    generic = F.col("type").isin("label", "category")
    out = candidates.drop("countries", "brands", "unique_scans_n", "with_image").join(right, product_key(candidates, products), "left")
    out = out.withColumns(
        {
            "insight_id": F.concat_ws("-", F.substring(natural, 1, 8), F.substring(natural, 9, 4), F.substring(natural, 13, 4), F.substring(natural, 17, 4), F.substring(natural, 21, 12)),
            "reserved_barcode": paths.is_reserved(F.col("barcode")),
            "timestamp": stamp,
            "n_votes": F.lit(0),
            "with_image": F.when(generic, F.col("__has_image")).otherwise(F.col("source_image").isNotNull()),
        }
    )
    wait = F.expr(f"INTERVAL {int(wait_minutes)} MINUTES")
    return out.withColumn("process_after", F.when(F.col("automatic_processing"), F.col("timestamp") + wait)).drop("__has_image")


def apply_change_set(insights: DataFrame, changes: DataFrame, new_rows: DataFrame, key: str = "id", order: list[Column] | None = None) -> DataFrame:
    """New table state: minus deleted, updated in place, plus created.

    ``changes``: (op, candidate_id, insight_id); ``new_rows``: candidate columns keyed by
    ``candidate_id``.  Identity columns of an updated row stay.  When several candidates
    update one row the last in ``order`` (over the columns of ``new_rows``; by default the
    candidates' own rank, or their id without the columns for it) wins, as successive
    updates would.
    """
    if order is None:
        ranked = {"priority", "source_image", "automatic_processing", "predictor"} <= set(new_rows.columns)
        order = candidate_order(tiebreak="candidate_id") if ranked else [F.col("candidate_id").asc()]
    fixed_cols = {key, "barcode", "type", "server_type"}
    fields = [c for c in insights.columns if c in new_rows.columns and c not in fixed_cols]
    gone = changes.where("op = 'delete'").select(F.col("insight_id").alias(key))
    stay = insights.join(gone, key, "left_anti")
    updates = changes.where("op = 'update'").select("candidate_id", F.col("insight_id").alias("__row"))
    news = last_per(updates.join(new_rows, "candidate_id"), ["__row"], order).select(F.col("__row").alias(key), F.struct(*fields).alias("__new"))
    patched = stay.join(news, key, "left")
    patched = patched.select(
        [F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in insights.columns]
    )
    created = new_rows.join(changes.where("op = 'create'").select("candidate_id"), "candidate_id", "left_semi")
    if "insight_id" in new_rows.columns:
        created = created.withColumn(key, F.col("insight_id"))
    created = created.select([F.col(c) if c in created.columns else F.lit(None).cast(dict(insights.dtypes)[c]).alias(c) for c in insights.columns])
    return patched.unionByName(created)


def changed_fields(updates: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Names of the columns that differ between ``<c>`` and ``new_<c>``; rows without change drop out."""
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("new_" + c)), F.lit(c)) for c in fields]))
    return updates.withColumn("changed", names).where(F.size("changed") > 0)


def judged_predictions(incoming: DataFrame, stored: DataFrame, products: DataFrame) -> DataFrame:
    """Stored rows and valid incoming ones together with ``__new``, ``__stale`` and ``__fresh``.

    ``valid_prediction``, ``stale_versions`` and ``new_predictions`` in one shuffle: all three
    compare rows of one product, so these come together once, in an order that serves every
    comparison.  A task holds no product: its rows are sorted and read in groups that may spill.
    """
    key = product_key(incoming, products)
    rows = stored.withColumn("__new", F.lit(False)).unionByName(incoming.withColumn("__new", F.lit(True)), allowMissingColumns=True).repartition(*key)
    right = _prefixed(keyed_products(incoming, products, "image_ids", F.lit(True).alias("exists")), [*key, "image_ids", "exists"])
    same = reduce(lambda a, b: a & b, [rows[c] == right["r_" + c] for c in key])
    image = F.coalesce("source_image", F.lit(""))
    valid = F.col("r_exists") & ((image == "") | valid_image(F.col("source_image"), F.col("r_image_ids")))
    rows = rows.join(right, same & rows["__new"], "left").where(~F.col("__new") | F.coalesce(valid, F.lit(False))).drop(*right.columns)

    identity = ["barcode", "server_type", "type", "source_image", *[c for c in IDENTITY if c not in ("server_type", "type", "source_image")]]
    rows = rows.sortWithinPartitions(*identity)
    of_type, of_image, equal = (Window.partitionBy(*identity[:n]) for n in (3, 4, len(identity)))
    version = F.when(F.col("__new"), F.col("predictor_version"))
    some, own = F.count(version).over(of_image), F.col("predictor_version")
    alike = F.when(own.isNull(), some == 0).otherwise((some == F.count_if("__new").over(of_image)) & (F.min(version).over(of_image) == own) & (F.max(version).over(of_image) == own))
    newer = F.when(F.col("type") == "category", F.bool_or("__new").over(of_type)).otherwise(F.col("source_image").isNotNull() & F.bool_or("__new").over(of_image) & ~alike)
    known = F.col("barcode").isNotNull() & F.col("server_type").isNotNull() & F.col("type").isNotNull()
    rows = rows.withColumn("__stale", ~F.col("__new") & known & F.coalesce(newer, F.lit(False)))
    held = F.bool_or(~F.col("__new") & ~F.col("__stale")).over(equal)
    return rows.withColumn("__fresh", F.col("__new") & ~held)


def import_predictions(incoming: DataFrame, stored: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """Validated batch against the stored table: rows to delete, rows to insert, types per product."""
    return imported(judged_predictions(incoming, stored, products), incoming, stored)


def imported(judged: DataFrame, incoming: DataFrame, stored: DataFrame) -> dict[str, DataFrame]:
    """The parts of ``import_predictions`` from its judged rows."""

    def like(rows: DataFrame, frame: DataFrame) -> DataFrame:
        return rows.select(*[F.col(c).cast(t).alias(c) for c, t in frame.dtypes])

    table = judged.where(F.col("__fresh") | ~(F.col("__new") | F.col("__stale"))).drop("__new", "__stale", "__fresh")
    updated = judged.where("__new").select("barcode", "server_type", "type").distinct()
    return {"delete": like(judged.where("__stale"), stored), "insert": like(judged.where("__fresh"), incoming), "updated_types": updated, "table": table}
