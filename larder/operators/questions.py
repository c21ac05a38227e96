"""Question lists for reviewers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions import paths
from larder.operators.dedup import intersect_types
from larder.operators.filters import insight_filter
from larder.operators.joins import exclude_voted
from larder.operators.keys import keyed_products, product_key
from larder.operators.ranking import order_insights, page

KINDS = ["front", "nutrition", "ingredients", "packaging"]
SIZES = {"display": fixed.DISPLAY_IMAGE_SIZE, "small": fixed.SMALL_IMAGE_SIZE, "thumb": fixed.THUMB_IMAGE_SIZE}


def selected_image_rows(products: DataFrame, base_url: str) -> DataFrame:
    """(barcode, kind, field, lang, url) of every selected image and offered size."""
    rows = products.select(F.col("code").alias("barcode"), F.posexplode("images").alias("pos", "key", "meta"))
    rows = rows.where(F.col("key").rlike("^(front|nutrition|ingredients|packaging)_"))
    sizes = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(s).alias("size")) for n, s in SIZES.items()]))
    rows = rows.select("barcode", "pos", "key", "meta", sizes.alias("s")).where(F.map_contains_key("meta.sizes", F.col("s.size").cast("string")))
    name = F.concat_ws(".", "key", "meta.rev", F.col("s.size").cast("string"))
    return rows.select(
        "barcode", "pos", F.split_part("key", F.lit("_"), F.lit(1)).alias("kind"), F.col("s.field").alias("field"),
        F.split_part("key", F.lit("_"), F.lit(2)).alias("lang"), paths.image_url(base_url, paths.image_path(F.col("barcode"), name)).alias("url"),
    )


def _entries(images: Column, kind: str) -> Column:
    size = str(fixed.DISPLAY_IMAGE_SIZE)
    return F.filter(F.map_entries(images), lambda e: e["key"].startswith(f"{kind}_") & F.map_contains_key(e["value"]["sizes"], F.lit(size)))


def selected_images(barcode: Column, images: Column, base_url: str) -> Column:
    """map kind -> map field -> map lang -> url of the selected images of one product."""

    def one(kind: str) -> Column:
        entries = F.filter(F.map_entries(images), lambda e: e["key"].startswith(f"{kind}_"))

        def field(size: int) -> Column:
            fitting = F.filter(entries, lambda e: F.map_contains_key(e["value"]["sizes"], F.lit(str(size))))
            url = lambda e: paths.image_url(base_url, paths.image_path(barcode, F.concat_ws(".", e["key"], e["value"]["rev"], F.lit(str(size)))))
            return F.map_from_entries(F.transform(fitting, lambda e: F.struct(F.split_part(e["key"], F.lit("_"), F.lit(2)), url(e))))

        return F.map_filter(F.create_map(*[x for n, s in SIZES.items() for x in (F.lit(n), field(s))]), lambda k, v: F.size(v) > 0)

    return F.create_map(*[x for kind in KINDS for x in (F.lit(kind), one(kind))])


def generic_image(barcode: Column, images: Column, base_url: str, kinds: Sequence[str] = ("front", "ingredients", "nutrition")) -> Column:
    """First selected image in kind order, else the newest raw image."""

    def shown(kind: str) -> Column:
        e = F.try_element_at(_entries(images, kind), F.lit(1))
        name = F.concat(e["key"], F.lit("."), e["value"]["rev"], F.lit(f".{fixed.DISPLAY_IMAGE_SIZE}"))
        return paths.image_url(base_url, paths.image_path(barcode, name))

    newest = F.array_max(F.transform(F.filter(F.map_keys(images), lambda k: k.rlike("^[0-9]+$")), lambda k: k.cast("long")))
    raw = paths.image_url(base_url, paths.image_path(barcode, F.concat(newest.cast("string"), F.lit(f".{fixed.DISPLAY_IMAGE_SIZE}"))))
    return F.coalesce(*[shown(k) for k in kinds], raw)


#: Question types added by callers: type -> (text, value column, image column or None).
EXTRA_QUESTIONS: dict[str, tuple[str, Column, Column | None]] = {}


def register_question(type: str, text: str, value: Column, image: Column | None = None) -> None:
    """Plug in a question type: its text, what it asks about, and its image (by default the insight's own)."""
    EXTRA_QUESTIONS[type] = (text, value, image)


def question_format(insights: DataFrame, products: DataFrame, names: DataFrame, translations: DataFrame, label_images: DataFrame, lang: str, base_url: str) -> DataFrame:
    """Question rows: text, localised value, image and reference image.

    ``names``: (taxonomy, node_id, lang, name); ``translations``: (lang, msg, text);
    ``label_images``: (value_tag, ref_image_url).  One join per dimension for the whole
    page instead of a catalogue lookup per row.
    """
    rows = insights.where(F.col("type").isin([*fixed.QUESTION_TYPES, *EXTRA_QUESTIONS]))
    wording = {**fixed.QUESTION_TEXTS, **{t: text for t, (text, _, _) in EXTRA_QUESTIONS.items()}}
    texts = F.create_map(*[F.lit(x) for kv in wording.items() for x in kv])
    rows = rows.withColumn("msg", texts[F.col("type")])
    local = translations.where(F.col("lang") == lang).select("msg", F.col("text").alias("__text"))
    rows = rows.join(local, "msg", "left").withColumn("question", F.coalesce("__text", "msg"))

    # packaging shows up to three values, the other taxonomised types one
    parts = {"shape": "packaging_shape", "material": "packaging_material", "recycling": "packaging_recycling"}
    element = [
        F.struct(F.lit(t).alias("taxonomy"), F.get_json_object("data", f"$.element.{p}.value_tag").alias("node_id")) for p, t in parts.items()
    ]
    nodes = F.when(F.col("type") == "packaging", F.array(*element)).otherwise(F.array(F.struct(F.col("type").alias("taxonomy"), F.col("value_tag").alias("node_id"))))
    wanted = rows.where(F.col("type").isin("category", "label", "packaging")).select("id", F.posexplode(nodes).alias("p", "n")).select("id", "p", "n.*").where("node_id is not null")
    own = names.where(F.col("lang").isin(lang, "en")).groupBy("taxonomy", "node_id").agg(
        F.max(F.when(F.col("lang") == lang, F.col("name"))).alias("a"), F.max(F.when(F.col("lang") == "en", F.col("name"))).alias("b")
    )
    local_names = wanted.join(own, ["taxonomy", "node_id"], "left").withColumn("name", F.coalesce("a", "b", "node_id"))
    local_names = local_names.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda x: x["name"]), ", ").alias("__name"))
    rows = rows.join(local_names, "id", "left")

    # the two addresses are made beside the catalogue: its image maps do not travel
    front = F.try_element_at(_entries(F.col("images"), "front"), F.lit(1))
    front_url = paths.image_url(base_url, paths.image_path(F.col("code"), F.concat(front["key"], F.lit("."), front["value"]["rev"], F.lit(f".{fixed.DISPLAY_IMAGE_SIZE}"))))
    shown_by = keyed_products(rows, products, generic_image(F.col("code"), F.col("images"), base_url).alias("__generic"), front_url.alias("__front"))
    rows = rows.join(shown_by, product_key(rows, products), "left")
    rows = rows.join(label_images.select("value_tag", F.col("ref_image_url").alias("__ref")), "value_tag", "left")
    shown = paths.image_url(base_url, paths.display_image(F.col("source_image")))
    rotated = paths.image_url(
        base_url,
        paths.image_path(F.col("barcode"), F.concat_ws(".", F.get_json_object("data", "$.image_key"), F.get_json_object("data", "$.image_rev"), F.lit(str(fixed.DISPLAY_IMAGE_SIZE)))),
    )
    listed = F.coalesce(F.col("predictor").isin("curated-list", "taxonomy", "whitelisted-brands"), F.lit(False))
    image = (
        F.when(F.col("type") == "category", F.col("__generic"))
        .when(F.col("type") == "image_orientation", rotated)
        .when((F.col("type") == "brand") & listed, F.coalesce("__front", shown))
        .otherwise(shown)
    )
    value = (
        F.when(F.col("type").isin("category", "label", "packaging"), F.col("__name"))
        .when(F.col("type").isin("product_weight", "brand"), F.col("value"))
        .otherwise(F.col("value_tag"))
    )
    for type, (_, own_value, own_image) in EXTRA_QUESTIONS.items():
        value = F.when(F.col("type") == type, own_value).otherwise(value)
        image = image if own_image is None else F.when(F.col("type") == type, own_image).otherwise(image)
    tagged = F.col("type").isin("category", "label", "brand")
    return rows.select(
        "barcode", "server_type", F.lit("add-binary").alias("question_type"), value.alias("value"), "question",
        F.col("id").alias("insight_id"), F.col("type").alias("insight_type"), F.when(tagged, F.col("value_tag")).alias("value_tag"),
        F.when(F.col("type") == "label", F.col("__ref")).alias("ref_image_url"), image.alias("source_image_url"),
    )


def _at_most_ten(values: Sequence[str] | None) -> list[str] | None:
    if values and len(values) > 10:
        raise ValueError(f"ten values at most, not {len(values)}")
    return list(values) if values else None


def question_rows(insights: DataFrame, types: Sequence[str] | None = None, brands: Sequence[str] | None = None, reserved_barcode: bool | None = False,
                  votes: DataFrame | None = None, voted_by: tuple[str, str] | None = None, **filters: object) -> DataFrame:
    """Open, not automatic insights of question types; at most ten brands.

    ``reserved_barcode``: False leaves reserved codes out; True asks for both kinds.
    """
    rows = insight_filter(
        insights, types=intersect_types(types), automatically_processable=False, brands=_at_most_ten(brands),
        reserved_barcode=None if reserved_barcode else False, **filters,
    )
    if votes is not None and voted_by is not None:
        rows = exclude_voted(rows, votes, *voted_by)
    return rows


def questions_page(insights: DataFrame, number: int = 1, count: int = 25, order: str | None = "popularity", max_count: int | None = None, seed: int | None = None, **options: object) -> tuple[DataFrame, DataFrame]:
    """(page, total - counted up to ``max_count`` if given); a random page ignores the offset."""
    rows = question_rows(insights, **options)
    total = (rows if max_count is None else rows.limit(max_count)).agg(F.count(F.lit(1)).alias("count"))
    ordered = order_insights(rows, order, seed)
    return (ordered.limit(count) if order == "random" else page(ordered, number, count)), total


def list_page(filtered: DataFrame, number: int, count: int, order: Sequence[Column] = (), max_count: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, total) of any filtered list."""
    counted = filtered if max_count is None else filtered.limit(max_count)
    ordered = filtered.orderBy(*order) if order else filtered
    return page(ordered, number, count), counted.agg(F.count(F.lit(1)).alias("count"))


def page_insights(insights: DataFrame, number: int = 1, count: int = 25, types: Sequence[str] | None = None, brands: Sequence[str] | None = None, order: str | None = None, max_count: int | None = None, **filters: object) -> tuple[DataFrame, DataFrame]:
    """Insight list form: ten types and brands at most, random or popularity order, total up to ``max_count`` if given."""
    if order not in (None, "random", "popularity"):
        raise ValueError(f"order not allowed here: {order}")
    rows = insight_filter(insights, types=_at_most_ten(types), brands=_at_most_ten(brands), **filters)
    total = (rows if max_count is None else rows.limit(max_count)).agg(F.count(F.lit(1)).alias("count"))
    ordered = order_insights(rows, order)
    return (ordered.limit(count) if order == "random" else page(ordered, number, count)), total
