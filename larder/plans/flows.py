"""Whole import runs: predictions in, tables and change sets out."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import cut_lineage, fixed
from larder.operators import candidates as C
from larder.operators import changeset as S
from larder.operators import tokens
from larder.operators.dedup import required_types_superset
from larder.operators.extractors import extract_all
from larder.operators.keys import keyed_products, product_key
from larder.operators.ranking import candidate_order, packaging_order

PRODUCT = ["barcode", "server_type"]


class Dimensions:
    """Reference tables the candidate builders join.

    ``taxonomy[name]`` = (nodes, synonyms, closure); packaging properties use the keys
    ``shape``, ``material`` and ``recycling``.
    """

    def __init__(self, taxonomy: dict | None = None, authorized: DataFrame | None = None, prefixes: DataFrame | None = None,
                 blacklist: DataFrame | None = None, tables: DataFrame | None = None) -> None:
        self.taxonomy, self.authorized = taxonomy or {}, authorized
        self.prefixes, self.blacklist, self.tables = prefixes, blacklist, tables


BUILDERS: dict[str, Callable[[DataFrame, DataFrame | None, Dimensions], DataFrame]] = {
    "packager_code": lambda p, c, d: C.cand_packager_code(p, c),
    "label": lambda p, c, d: C.cand_label(p, *d.taxonomy["label"], d.authorized, c),
    "category": lambda p, c, d: C.cand_category(p, *d.taxonomy["category"], c),
    "product_weight": lambda p, c, d: C.cand_product_weight(p, c),
    "expiration_date": lambda p, c, d: C.cand_expiration_date(p, c),
    "brand": lambda p, c, d: C.cand_brand(p, d.prefixes, d.blacklist, c),
    "store": lambda p, c, d: C.cand_store(p, c),
    "packaging": lambda p, c, d: C.cand_packaging(p, {k: d.taxonomy[k][2] for k in C.PROPERTIES}, {k: d.taxonomy[k][0] for k in C.PROPERTIES}, c),
    "is_upc_image": lambda p, c, d: C.cand_upc_image(p, c),
    "nutrition_image": lambda p, c, d: C.cand_nutrition_image(p, d.tables, c),
    "ingredient_spellcheck": lambda p, c, d: C.cand_ingredient_spellcheck(p, c),
    "nutrient_extraction": lambda p, c, d: C.cand_nutrient_extraction(p, c),
    "image_orientation": lambda p, c, d: C.cand_image_orientation(p, c),
    "ingredient_detection": lambda p, c, d: C.cand_ingredient_detection(p, c),
}

BUILT_IN = dict(BUILDERS)
NAMED_BY = {"label": ["label"], "category": ["category"], "packaging": C.PROPERTIES}  # the taxonomies that a type's builder reads


def register_builder(type: str, builder: Callable, keys: list[str], required: list[str]) -> None:
    """Plug in a candidate builder with its conflict key and required prediction types."""
    BUILDERS[type] = builder
    C.CONFLICT_KEYS[type] = keys
    fixed.REQUIRED_TYPES[type] = required


def used_dimensions(dims: Dimensions, predictions: DataFrame, products: DataFrame, types: list[str]) -> Dimensions:
    """``dims`` for the own builders of ``types``: only nodes, synonyms and authorized tags that predictions or products name.

    Few, however large a taxonomy is.  They are written once, so that their size is known when they
    are joined and the predictions need not be dealt by tag to meet them.
    """
    names = [n for t in types if BUILDERS[t] is BUILT_IN.get(t) for n in NAMED_BY.get(t, []) if n in dims.taxonomy]
    few = lambda rows: cut_lineage(rows)[0]
    found = [predictions.where(F.col("type").isin("label", "category")).select(F.col("type").alias("name"), F.col("value_tag").alias("id"))]
    if set(names) & set(C.PROPERTIES):
        elements = [predictions.where("type = 'packaging'").select(*[C.json_field(f"element.{p}.value_tag").alias(p) for p in C.PROPERTIES])]
        if "packagings" in products.columns:
            elements.append(products.select(F.explode("packagings").alias("e")).select(*[F.col(f"e.{p}").alias(p) for p in C.PROPERTIES]))
        each = F.explode(F.array(*[F.struct(F.lit(p).alias("name"), F.col(p).alias("id")) for p in C.PROPERTIES])).alias("t")
        found += [rows.distinct().select(each).select("t.*") for rows in elements]
    tags = few(reduce(DataFrame.unionByName, found).where(F.col("name").isin(names) & F.col("id").isNotNull()).distinct()) if names else None
    taxonomy, authorized, done = dict(dims.taxonomy), dims.authorized, {}
    for name in names:
        nodes, synonyms, closure = dims.taxonomy[name]
        alike = [n for n in names if dims.taxonomy[n][0] is nodes and dims.taxonomy[n][1] is synonyms]
        if alike[0] not in done:
            own = tags.where(F.col("name").isin(alike)).select("id")
            other = few(synonyms.join(own.select(F.col("id").alias("tag")).distinct(), "tag", "left_semi"))
            ids = few(own.unionByName(other.select("id")).distinct())
            done[alike[0]] = few(nodes.join(ids, "id", "left_semi")), other, ids
        used, other, ids = done[alike[0]]
        taxonomy[name] = used, other, closure
        if name == "label" and authorized is not None:
            authorized = few(authorized.join(ids.withColumnRenamed("id", "value_tag"), "value_tag", "left_semi"))
    return Dimensions(taxonomy, authorized, dims.prefixes, dims.blacklist, dims.tables)


def changes_for_type(type: str, predictions: DataFrame, insights: DataFrame, products: DataFrame, scope: DataFrame, dims: Dimensions) -> tuple[DataFrame, DataFrame]:
    """(changes, candidates) of one insight type over the products in ``scope``.

    All rules compare rows of one product: candidates and insights lie by product once they have met
    their products, and are merged where they lie.
    """
    inputs = [*fixed.REQUIRED_TYPES[type], *fixed.EXTRA_INPUT_TYPES.get(type, [])]
    own = lambda rows: rows.join(scope.select(*PRODUCT), PRODUCT, "left_semi")
    rows = own(predictions.where(F.col("type").isin(inputs)))
    # a number of parts, so that adaptive execution leaves them as they are and all frames of a type lie alike
    parts = int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    products = products.repartition(parts, *[c for c in ("code", "server_type") if c in products.columns])
    cand = S.generate_insights(BUILDERS[type](rows, products, dims), products)
    cand = cand.withColumn("type", F.lit(type))
    refs = own(insights.where(F.col("type") == type))
    known = refs.join(keyed_products(refs, products), product_key(refs, products), "left_semi")
    if type == "nutrient_extraction":
        changes = S.merge_newer_image(cand, known, group=PRODUCT)
    else:
        keys = C.CONFLICT_KEYS[type]
        for k in keys:
            if k not in known.columns:
                known = known.withColumn(k, F.get_json_object("data", "$.element.shape.value_tag" if k == "shape_tag" else f"$.{k}"))
        order = packaging_order() if type == "packaging" else candidate_order()
        closure = dims.taxonomy[type][2] if type in ("label", "category") else None
        changes = S.merge_candidates(cand, known, keys, order, closure, PRODUCT, dealt=True)
    changes = changes.select(*PRODUCT, F.lit(type).alias("type"), "op", "candidate_id", "insight_id")  # one type: no part of a key
    gone = S.deletions_of_missing_products(refs, products).withColumn("candidate_id", F.lit(None).cast(dict(changes.dtypes)["candidate_id"]))
    return changes.unionByName(gone), cand


def possible_types(present: DataFrame, types: list[str] | None) -> list[str]:
    """The insight types whose required prediction types occur at all; the others change nothing."""
    named = types or list(BUILDERS)
    required = {r for t in named for r in fixed.REQUIRED_TYPES[t]}
    seen = {r["type"] for r in present.where(F.col("type").isin(*required)).select("type").distinct().collect()}
    return [t for t in named if seen.issuperset(fixed.REQUIRED_TYPES[t])] or named[:1]


def import_run(incoming: DataFrame, stored: DataFrame, insights: DataFrame, products: DataFrame, dims: Dimensions, types: list[str] | None = None) -> dict[str, DataFrame]:
    """Import a batch of predictions, then recompute every insight type whose required
    prediction types were all updated for a product.

    The judged predictions and the updated types are written once; every type scans its own
    rows of that table.
    """
    judged, _ = cut_lineage(S.judged_predictions(incoming, stored, products))
    result = S.imported(judged, incoming, stored)
    table = result["table"]
    updated, _ = cut_lineage(result["updated_types"])
    changes = None
    named = possible_types(updated, types)
    used = used_dimensions(dims, table, products, named)
    for type in named:
        scope = required_types_superset(updated, fixed.REQUIRED_TYPES[type])
        part, _ = changes_for_type(type, table, insights, products, scope, used if BUILDERS[type] is BUILT_IN.get(type) else dims)
        changes = part if changes is None else changes.unionByName(part)
    return {"predictions": table, "deleted_predictions": result["delete"], "new_predictions": result["insert"], "changes": changes}


def refresh_run(stored: DataFrame, insights: DataFrame, products: DataFrame, dims: Dimensions, types: list[str] | None = None) -> DataFrame:
    """Recompute insights from the stored predictions only (a table that each type scans)."""
    changes = None
    named = possible_types(stored, types)
    used = used_dimensions(dims, stored, products, named)
    for type in named:
        scope = required_types_superset(stored, fixed.REQUIRED_TYPES[type])
        part, _ = changes_for_type(type, stored, insights, products, scope, used if BUILDERS[type] is BUILT_IN.get(type) else dims)
        changes = part if changes is None else changes.unionByName(part)
    return changes


def reextract_product(products: DataFrame, texts: DataFrame, types: Sequence[str] = tuple(fixed.OCR_DEFAULT_TYPES), **arguments: dict) -> DataFrame:
    """Predictions from the texts of all raw images of the given products.

    ``arguments``: what the types ask for, see ``extract_all``; ``words`` rows among them
    are narrowed to the same images.
    """
    ids = products.select(F.col("code").alias("barcode"), F.explode("image_ids").alias("image_id"))
    rows = texts.join(ids, ["barcode", "image_id"], "left_semi")
    keep = ["barcode", "source_image"]
    images = rows.select(*keep).distinct()
    for type, own in arguments.items():
        if "words" in own and type != "image_flag":
            arguments[type] = {**own, "words": own["words"].join(images, "source_image")}
    return extract_all(rows, types, keep, "text", **arguments)


def category_run(products: DataFrame, scorer: Callable, nodes: DataFrame, closure: DataFrame | None, model: str, threshold: float = 0.5, deepest_only: bool = False) -> DataFrame:
    """Food products of the current schema -> scores -> category predictions.

    The scorer yields (code, scores, labels).  Only ``deepest_only`` reads the closure.
    """
    food = products.where((F.col("schema_version") >= 1003))
    if "server_type" in products.columns:
        food = food.where(F.col("server_type").isin(fixed.FOOD_SERVERS))
    scores = tokens.batch_score(food, scorer, "code string, scores array<double>, labels array<string>")
    rows = tokens.category_scores(scores, threshold)
    rows = tokens.category_deepest(rows, nodes, closure if deepest_only else None)
    return tokens.category_predictions(rows, model)


def product_refresh(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Products to refresh from routed events, each once."""
    rows = events.where(F.col("action_kind") == "refresh")
    return rows.groupBy(F.col("code").alias("barcode"), "server_type").agg(F.max("timestamp").alias("last_update"))
