"""Post-processing of model output: tokens, boxes and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder import fixed
from larder.functions import boxes, measures, text
from larder.functions.binding import bind
from larder.operators import taxonomy
from larder.operators.filters import max_confidence


def softmax(logits: Column) -> Column:
    def shares(exps: Column) -> Column:
        return bind(F.aggregate(exps, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(exps, lambda x: x / total))

    return bind(F.array_max(logits), lambda top: bind(F.transform(logits, lambda x: F.exp(x - top)), shares))


def argmax(values: Column) -> Column:
    """0-based index of the first maximum."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def softmax_argmax(tokens: DataFrame, labels: Sequence[str], key: str = "source_image") -> DataFrame:
    """Token logits to one labelled row per word.

    ``tokens``: (key, token_idx, word_id, special, unknown, logits).  Special tokens fall
    out, sub-words follow their word's first token, the B-/I- prefix goes.
    """
    order = Window.partitionBy(key).orderBy("token_idx")
    first = F.coalesce(F.col("word_id") != F.lag("word_id").over(order), F.lit(True)) | F.col("unknown")
    scores = softmax(F.col("logits"))
    best = argmax(F.col("logits"))
    names = F.array(*[F.lit(x) for x in labels])
    return (
        tokens.withColumn("__first", first).where(~F.col("special") & F.col("__first"))
        .withColumns({"entity": F.regexp_replace(F.try_element_at(names, best + 1), "^[^-]*-", ""), "score": F.try_element_at(scores, best + 1)})
        .drop("__first", "logits")
    )


def token_offsets(tokens: DataFrame, sentences: DataFrame, key: str = "source_image") -> DataFrame:
    """Scores, covered text and sub-word flag per non-special token.

    ``tokens``: (key, token_idx, word_id, special, start, end, logits).
    """
    order = Window.partitionBy(key).orderBy("token_idx")
    sub = F.coalesce(F.col("word_id") == F.lag("word_id").over(order), F.lit(False))
    rows = tokens.withColumn("is_subword", sub).where(~F.col("special")).withColumn("scores", softmax(F.col("logits"))).drop("logits")
    return rows.join(sentences, key).withColumn("word", F.substring(F.col("sentence"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("sentence")


def entity_runs(df: DataFrame, key: Sequence[str] = ("source_image",), order: str = "index", word: str = "word") -> DataFrame:
    """Consecutive words of equal entity as one row; ``O`` breaks a run.

    The run number is a running count of changes, so the window is a sort by key; the
    words collected are those of one run.
    """
    over = Window.partitionBy(*key).orderBy(order)
    change = (~F.col("entity").eqNullSafe(F.lag("entity").over(over))).cast("int")
    runs = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(word).alias("w")))), lambda x: x["w"])
    aggs = [words.alias("words"), F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.min_by("score", order).alias("score")]
    if "char_start" in df.columns:
        aggs += [F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")]
    return runs.where("entity <> 'O'").groupBy(*key, "run", "entity").agg(*aggs)


def entity_normalize(entities: DataFrame) -> DataFrame:
    """Entity rows (``entity``, ``words``) to name, text, value, unit and validity."""
    label = F.lower("entity")
    serving = label == "serving_size"
    per = F.regexp_extract(label, "_([^_]*)$", 1)
    base = F.translate(F.regexp_replace(label, "_[^_]*$", ""), "_", "-")
    words = F.transform("words", lambda w: F.regexp_replace(F.trim(w), "^[()/]+|[()/]+$", ""))
    head = F.try_element_at(words, F.lit(1))
    split_unit = label.startswith("energy_") & (F.length(head) > 3) & F.lower(F.substring(head, 1, 3)).eqNullSafe(F.lit("kj/"))
    words = F.when(split_unit, F.concat(F.array(F.substr(head, F.lit(4))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))))).otherwise(words)
    joined = F.array_join(words, " ")
    read = measures.match_nutrient_value(F.col("text"), F.col("__label"))
    nine = F.regexp_extract("text", r"^([0-9]+[,.]?[0-9]*)\s*9", 1)
    out = entities.withColumns({"__label": label, "text": joined}).withColumn("__read", read)
    traces = F.col("text").isin("trace", "traces")
    size_value = F.when(nine != "", F.concat(nine, F.lit(" g"))).otherwise(F.col("text"))
    return out.withColumns(
        {
            "entity": F.when(serving, label).otherwise(F.concat(base, F.lit("_"), per)),
            "value": F.when(serving, size_value).when(traces, "traces").otherwise(F.col("__read.value")),
            "unit": F.when(~serving & ~traces, F.col("__read.unit")),
            "valid": F.when(serving | traces, True).otherwise(F.col("__read.valid")),
        }
    ).drop("__label", "__read", "words")


def entity_multi_invalid(df: DataFrame, key: Sequence[str] = ("source_image",)) -> DataFrame:
    """An entity type seen twice on an image makes all its rows invalid."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*key, "entity")) > 1
    return df.withColumn("__many", many).withColumns(
        {"valid": F.when(F.col("__many"), False).otherwise(F.col("valid")), "invalid_reason": F.when(F.col("__many"), "multiple_entities")}
    ).drop("__many")


def token_aggregate(tokens: DataFrame, labels: Sequence[str], strategy: str = "first", key: str = "source_image") -> DataFrame:
    """Sub-word scores to entities.

    ``tokens``: (key, token_idx, is_subword, start, end, scores).  Strategies: ``none`` one
    row per token; ``simple`` groups tokens; ``first``/``max``/``average`` decide per word,
    then group.  Groups join neighbours of equal tag unless a B- starts a new one.
    """
    names = F.array(*[F.lit(x) for x in labels])
    over = Window.partitionBy(key).orderBy("token_idx")
    if strategy in ("none", "simple"):
        words = tokens.select(key, "token_idx", "start", "end", "scores")
    elif strategy in ("first", "max", "average"):
        numbered = tokens.withColumn("w", F.sum((~F.col("is_subword")).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
        if strategy == "first":
            scores = F.min_by("scores", "token_idx")
        elif strategy == "max":
            scores = F.max_by("scores", F.struct(F.array_max("scores"), -F.col("token_idx")))
        else:
            scores = F.array(*[F.avg(F.col("scores")[i]) for i in range(len(labels))])
        words = numbered.groupBy(key, "w").agg(
            F.min("token_idx").alias("token_idx"), F.min_by("start", "token_idx").alias("start"), F.max_by("end", "token_idx").alias("end"), scores.alias("scores")
        ).drop("w")
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    words = words.withColumns({"entity": F.try_element_at(names, argmax(F.col("scores")) + 1), "score": F.array_max("scores")}).drop("scores")
    if strategy == "none":
        return words
    tag = F.regexp_replace("entity", "^[BI]-", "")
    begin = F.col("entity").startswith("B-") | ~tag.eqNullSafe(F.lag(tag).over(over))
    numbered = words.withColumn("__b", begin.cast("int")).withColumn("grp", F.sum("__b").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "grp").agg(
        F.min_by(F.regexp_replace("entity", "^.*-", ""), "token_idx").alias("entity_group"), F.avg("score").alias("score"),
        F.min_by("start", "token_idx").alias("start"), F.max_by("end", "token_idx").alias("end"),
    ).drop("grp")


def ingredient_spans(entities: DataFrame, sentences: DataFrame, traces: Sequence[str] = (), language: Callable[[Column], Column] | None = None, key: str = "source_image") -> DataFrame:
    """Entity groups to extended ingredient texts with their language."""
    from larder.operators.extractors import extend_span_mentions

    rows = entities.where(F.col("entity_group") != "O").join(sentences.select(key, F.col("sentence").alias("text")), key)
    rows = extend_span_mentions(rows, traces).withColumn("ingredients", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    return rows if language is None else rows.withColumn("lang", language(F.col("ingredients")))


def known_ingredient_tags(products: DataFrame, nodes: DataFrame, key: str = "code") -> DataFrame:
    """Top-level ingredient ids as tags, in order, kept when in the taxonomy."""
    rows = products.select(key, F.posexplode("ingredient_ids").alias("pos", "raw")).select(key, "pos", text.tag(F.col("raw")).alias("id"))
    kept = rows.join(nodes.select("id").distinct(), "id", "left_semi")
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ingredient_tags"))


def category_scores(scores: DataFrame, threshold: float = 0.5, excluded: Sequence[str] = tuple(fixed.CATEGORIES_EXCLUDED), key: str = "code") -> DataFrame:
    """(key, scores, labels arrays) to rows at or above the threshold."""
    pairs = F.explode(F.arrays_zip("scores", "labels"))
    rows = scores.select(key, pairs.alias("p")).select(key, F.col("p.labels").alias("value_tag"), F.col("p.scores").cast("double").alias("confidence"))
    return rows.where((F.col("confidence") >= threshold) & ~F.col("value_tag").isin(list(excluded)))


def category_neighbor_scores(kept: DataFrame, all_scores: DataFrame, edges: DataFrame, key: str = "code") -> DataFrame:
    """Scores of parents, children and siblings of the kept categories (null when not predicted)."""
    near = taxonomy.neighbors(edges, kept)
    flat = all_scores.select(key, F.explode(F.arrays_zip("scores", "labels")).alias("p")).select(key, F.col("p.labels").alias("neighbor"), F.col("p.scores").cast("double").alias("neighbor_score"))
    return kept.join(near, "value_tag").join(flat, [key, "neighbor"], "left")


def category_deepest(rows: DataFrame, nodes: DataFrame, closure: DataFrame | None = None, key: str = "code") -> DataFrame:
    """Known categories; with ``closure`` only the deepest of each product."""
    known = rows.join(nodes.select(F.col("id").alias("value_tag")).distinct(), "value_tag", "left_semi")
    return known if closure is None else taxonomy.deepest_nodes(known, closure, [key])


def pad_vectors(vectors: Column, size: int = fixed.MAX_IMAGE_VECTORS, dim: int = 512) -> Column:
    """struct(vectors, mask): fixed number of vectors; no image gives zeros and mask 1, 0, ..."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    given = F.coalesce(vectors, F.array().cast(f"array<array<float>>"))
    n = F.greatest(F.least(F.size(given), F.lit(size)), F.lit(1))
    padded = F.slice(F.concat(given, F.array_repeat(zero, size)), 1, size)
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(size) - n))
    return F.struct(padded.alias("vectors"), mask.alias("mask"))


def nutriscore_label(objects: Column, min_score: float = 0.5) -> Column:
    """Label of the single grade box at or above the score, else null."""
    kept = F.filter(objects, lambda o: o["score"] >= min_score)
    grade = F.try_element_at(kept, F.lit(1))["label"]
    return F.when(F.size(kept) == 1, F.concat(F.lit("en:nutriscore-grade-"), F.lower(F.substring(grade, -1, 1))))


def upc_class(area: Column, width: Column, height: Column, min_share: float = 0.09) -> Column:
    """Barcode polygon area to UPC_IMAGE, SMALL_UPC or NO_UPC."""
    share = area / (width * height)
    return F.when(area.isNull(), "NO_UPC").when(share > min_share, "UPC_IMAGE").otherwise("SMALL_UPC")


def detections_to_logos(image_predictions: DataFrame, min_score: float = 0.1) -> DataFrame:
    """Detected objects to logo rows that keep their index; weak and empty boxes fall out."""
    rows = image_predictions.select(F.col("id").alias("image_prediction_id"), F.posexplode("objects").alias("index", "o"))
    b = F.col("o.bounding_box")
    return rows.where((F.col("o.score") > min_score) & (b[2] > b[0]) & (b[3] > b[1])).select(
        "image_prediction_id", "index", F.col("o.score").alias("score"), b.alias("bounding_box"), F.col("o.label").alias("label")
    )


def filter_logos(objects: Column, score_threshold: float, iou_threshold: float = 0.95, suppress: bool = True) -> Column:
    """Boxes (by descending score) that do not repeat an earlier kept box, above a score.

    Elements keep their index.  ``suppress=False`` is the plain score filter.
    """
    numbered = F.transform(objects, lambda o, i: F.struct(i.alias("index"), o.alias("logo")))
    if suppress:
        numbered = F.aggregate(
            numbered,
            F.slice(numbered, 1, 0),
            lambda kept, x: F.when(
                F.exists(kept, lambda y: boxes.iou(y["logo"]["bounding_box"], x["logo"]["bounding_box"]) >= iou_threshold), kept
            ).otherwise(F.concat(kept, F.array(x))),
        )
    return F.filter(numbered, lambda x: x["logo"]["score"] >= score_threshold)


def ingredient_counts(trees: DataFrame, nodes: DataFrame, key: Sequence[str] = ("id",)) -> DataFrame:
    """Ingredients and known ingredients of a nested list, with the known fraction.

    The tree is flattened level by level to its ids, as deep as the column's type goes, so
    counting is one explode and one semi join.
    """
    level, kind, ids = F.col("ingredients"), trees.schema["ingredients"].dataType, []
    while kind is not None:
        ids.append(F.transform(F.coalesce(level, F.array().cast(kind)), lambda x: x["id"]))
        item = kind.elementType
        kind = item["ingredients"].dataType if "ingredients" in item.fieldNames() else None
        if kind is not None:
            level = F.flatten(F.array_compact(F.transform(level, lambda x: x["ingredients"])))
    rows = trees.select(*key, F.explode_outer(F.concat(*ids)).alias("ingredient_id"))
    known = nodes.select(F.col("id").alias("ingredient_id"), F.lit(1).alias("known")).distinct()
    counted = rows.join(known, "ingredient_id", "left").groupBy(*key).agg(
        F.count("ingredient_id").alias("ingredients_n"), F.coalesce(F.sum("known"), F.lit(0)).alias("known_ingredients_n")
    )
    return counted.withColumns(
        {
            "unknown_ingredients_n": F.col("ingredients_n") - F.col("known_ingredients_n"),
            "fraction_known_ingredients": F.coalesce(F.try_divide("known_ingredients_n", "ingredients_n"), F.lit(0.0)),
        }
    )


def flat_ingredient_counts(rows: DataFrame, nodes: DataFrame, key: Sequence[str]) -> DataFrame:
    """As ``ingredient_counts`` for rows ``(key..., ingredient_id)`` already flat."""
    known = nodes.select(F.col("id").alias("ingredient_id"), F.lit(1).alias("known")).distinct()
    counted = rows.join(known, "ingredient_id", "left").groupBy(*key).agg(F.count("ingredient_id").alias("ingredients_n"), F.coalesce(F.sum("known"), F.lit(0)).alias("known_ingredients_n"))
    return counted.withColumn("fraction_known_ingredients", F.coalesce(F.try_divide("known_ingredients_n", "ingredients_n"), F.lit(0.0)))


def ingredient_entity_rows(image_predictions: DataFrame) -> DataFrame:
    """Entities of an ingredient prediction as rows with known fraction and relative boxes.

    ``image_predictions``: (id, width, height, entities array with text, lang, score,
    bounding_box absolute, ingredients_n, known_ingredients_n).
    """
    rows = image_predictions.select("id", "width", "height", F.posexplode("entities").alias("index", "e"))
    fraction = F.when(F.col("e.ingredients_n").isNotNull(), F.coalesce(F.try_divide("e.known_ingredients_n", "e.ingredients_n"), F.lit(0.0)))
    return rows.where(text.valid_lang(F.col("e.lang"))).select(
        "id", "index", "e.text", "e.lang", "e.score", "e.ingredients_n", "e.known_ingredients_n", fraction.alias("fraction_known_ingredients"),
        boxes.to_relative(F.col("e.bounding_box"), F.col("width"), F.col("height")).alias("bounding_box"),
    )


def nutrition_prediction_rows(entities: DataFrame, key: Sequence[str] = ("source_image",)) -> DataFrame:
    """Valid entities of an image as one prediction row (nutrients map and kept entities)."""
    kept = F.struct("start", F.struct("entity", "text", "value", "unit", "valid", "score").alias("e"))
    nutrients = F.map_from_entries(F.collect_list(F.when(F.col("valid"), F.struct("entity", F.struct("value", "unit").alias("v")))))
    return entities.groupBy(*key).agg(
        nutrients.alias("nutrients"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["e"]).alias("entities")
    ).where(F.size("nutrients") > 0).withColumn("type", F.lit("nutrient_extraction"))


def batch_score(df: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Run a user scorer (iterator of pandas frames) over Arrow batches of the partitions."""
    return df.mapInPandas(scorer, schema)


def score_missing_only(images: DataFrame, stored: DataFrame, model: str, version: str, scorer: Callable, schema: str) -> DataFrame:
    """Result rows of images the model has not seen; ``schema`` must hold id and objects."""
    done = stored.where(F.col("model_name") == model).select(F.col("image_id").alias("id"))
    scored = batch_score(images.join(done, "id", "left_anti"), scorer, schema)
    return scored.withColumns(
        {"model_name": F.lit(model), "model_version": F.lit(version), "max_confidence": max_confidence(F.col("objects"))}
    )


def category_predictions(rows: DataFrame, model: str, key: str = "code") -> DataFrame:
    """Category scores to prediction rows."""
    return rows.select(
        F.col(key).alias("barcode"), F.lit("category").alias("type"), "value_tag", F.lit(None).cast("string").alias("value"),
        F.lit(False).alias("automatic_processing"), F.lit("neural").alias("predictor"), F.lit(model).alias("predictor_version"), "confidence",
    )


def classify_top(labels: Column, scores: Column) -> Column:
    """(label, score) pairs, best first."""
    pairs = F.arrays_zip(scores.alias("score"), labels.alias("label"))
    return F.array_sort(
        pairs, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)
    )
