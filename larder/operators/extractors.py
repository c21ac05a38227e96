"""Text and vision extractors: ``texts -> predictions``.

Each takes a table with key columns ``keep`` and a text column and returns prediction
rows (PREDICTION_COLUMNS) plus the match span.  ``data`` is a JSON string.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions import boxes, measures, text
from larder.operators.text_match import (
    MOST_TERM_CHARS, collected_terms, dict_match, dict_match_join, match_array, match_dictionaries, normalised_terms, regex_extract, scan_texts,
)
from larder.session import cut_lineage

VERSION = "1"
PREDICTION_COLUMNS = [
    "type", "value_tag", "value", "automatic_processing", "predictor", "predictor_version", "confidence", "data", "start", "end",
]


def predictions(df: DataFrame, keep: Sequence[str], type: str, data: dict[str, Column], value_tag: Column | None = None,
                value: Column | None = None, automatic: Column | bool | None = None, predictor: str | None = None,
                confidence: Column | None = None, span: bool = True) -> DataFrame:
    """Uniform prediction rows; JSON leaves null fields out."""

    def col(c: Column | bool | str | None, kind: str) -> Column:
        return (c if isinstance(c, Column) else F.lit(c)).cast(kind)

    return df.select(
        *keep,
        F.lit(type).alias("type"),
        col(value_tag, "string").alias("value_tag"),
        col(value, "string").alias("value"),
        col(automatic, "boolean").alias("automatic_processing"),
        col(predictor, "string").alias("predictor"),
        F.lit(VERSION).alias("predictor_version"),
        col(confidence, "double").alias("confidence"),
        F.to_json(F.struct(*[c.alias(n) for n, c in data.items()])).alias("data"),
        (F.col("start") if span else F.lit(None)).cast("int").alias("start"),
        (F.col("end") if span else F.lit(None)).cast("int").alias("end"),
    )


@dataclass(frozen=True)
class TextType:
    """What one prediction type looks for in texts, and how matches become predictions.

    ``finish`` takes (rows of the patterns, rows of each dictionary, keep).
    """

    patterns: Sequence[tuple]
    finish: Callable[[DataFrame, dict[str, DataFrame], Sequence[str]], DataFrame]
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)


def extract_type(df: DataFrame, kind: TextType, keep: Sequence[str], text_col: str) -> DataFrame:
    """Predictions of one type, lazily."""
    hits = match_dictionaries(df, kind.dictionaries, keep, text_col) if kind.dictionaries else {}
    return kind.finish(regex_extract(df, kind.patterns, keep, text_col) if kind.patterns else None, hits, keep)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def packager_code_type(fishing: DataFrame | None = None) -> TextType:
    """Six pattern families in canonical spelling, and the fishing-code dictionary."""

    def finish(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
        g = F.col("g")
        value = (
            F.when(F.col("name") == "fr_emb", F.upper(F.concat(F.lit("EMB "), F.replace(g[0], F.lit(" "), F.lit("")), g[1])))
            .when(F.col("name") == "fsc", F.upper(F.concat(F.lit("FSC-"), g[0])))
            .when(F.col("name") == "eu_fr", F.upper(F.concat(F.lit("FR "), F.concat_ws(".", g[0], g[1], g[2]), F.lit(" EC"))))
            .when(F.col("name") == "eu_de", F.upper(F.concat(F.lit("DE "), g[0], F.lit("-"), g[1], F.lit(" EC"))))
            .otherwise(F.col("raw"))
        )
        out = predictions(found, keep, "packager_code", {"raw": F.col("raw"), "type": F.col("name")}, value=value, automatic=True)
        if "fishing" not in hits:
            return out
        return out.unionByName(
            predictions(hits["fishing"], keep, "packager_code", {"raw": F.col("matched"), "type": F.lit("fishing")}, value=F.col("key"), automatic=True, predictor="flashtext")
        )

    return TextType(_table(fixed.PACKAGER_PATTERNS), finish, {} if fishing is None else {"fishing": fishing})


def extract_packager_code(df: DataFrame, fishing: DataFrame | None = None, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, packager_code_type(fishing), keep, text_col)


def _groups(pattern: str) -> list[int]:
    """Numbers of the capturing groups of a pattern without escapes of parentheses."""
    count = sum(1 for i, c in enumerate(pattern) if c == "(" and pattern[i + 1] != "?" and (i == 0 or pattern[i - 1] != "\\"))
    return list(range(1, count + 1))


def _table(patterns: Sequence[tuple[str, str, str]]) -> list[tuple]:
    """Pattern rows with their groups and required literals."""
    return [(n, f, p, _groups(p), fixed.PATTERN_LITERALS.get(n, [])) for n, f, p in patterns]


def label_type(dictionary: DataFrame | None = None) -> TextType:
    """Label patterns (organic codes formatted) and the label dictionary."""

    def finish(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
        g = F.col("g")
        body = F.lower(F.translate(F.try_element_at(g, F.lit(2)), "öø", "oo"))
        organic = F.concat(F.lit("en:"), F.lower(F.try_element_at(g, F.lit(1))), F.lit("-"), body, F.lit("-"), F.lower(F.try_element_at(g, F.lit(3))))
        short_german = (F.lower(F.try_element_at(g, F.lit(1))) == "de") & (F.length(F.try_element_at(g, F.lit(3))) != 3)
        spanish = F.lower(F.concat(F.lit("en:es-eco-"), F.try_element_at(g, F.lit(1)), F.lit("-"), F.try_element_at(g, F.lit(2))))
        tag = (
            F.when(F.col("name") == "xx-bio-xx", F.when(~short_german, organic))
            .when(F.col("name") == "es-eco", spanish)
            .otherwise(F.col("name"))
        )
        out = predictions(found.withColumn("__tag", tag).where("__tag is not null"), keep, "label", {"text": F.col("raw")}, value_tag=F.col("__tag"), predictor="regex")
        if "labels" not in hits:
            return out
        return out.unionByName(predictions(hits["labels"], keep, "label", {"text": F.col("matched")}, value_tag=F.col("key"), predictor="flashtext"))

    return TextType(_table(fixed.LABEL_PATTERNS), finish, {} if dictionary is None else {"labels": dictionary})


def extract_label(df: DataFrame, dictionary: DataFrame | None = None, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, label_type(dictionary), keep, text_col)


def vision_logos(df: DataFrame, mapping: DataFrame, type: str, keep: Sequence[str] = ("source_image",), logos: str = "logos") -> DataFrame:
    """Vision logo annotations through a description map ``(description, target)``."""
    rows = df.select(*keep, F.explode(logos).alias("l")).select(*keep, "l.description", "l.score").join(mapping, "description")
    brand = type == "brand"
    return predictions(
        rows, keep, type, {"description": F.col("description")}, value_tag=text.tag(F.col("target")) if brand else F.col("target"),
        value=F.col("target") if brand else None, automatic=False, predictor="google-cloud-vision", confidence=F.col("score"), span=False,
    )


def weight_predictions(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """Four matchers with priorities; implausible weights dropped, odd ones not automatic."""

    def pick(slot: int) -> Column:
        out = F.lit(None).cast("string")
        for entry in fixed.WEIGHT_PATTERNS:
            if entry[slot]:
                out = F.when(F.col("name") == entry[0], F.col("g")[entry[slot] - 1]).otherwise(out)
        return out

    def constant(slot: int) -> Column:
        out = F.lit(None)
        for entry in fixed.WEIGHT_PATTERNS:
            out = F.when(F.col("name") == entry[0], F.lit(entry[slot])).otherwise(out)
        return out

    rows = found.withColumns({"raw_value": pick(3), "unit": measures.fix_fused_unit(pick(4)), "count": pick(5), "prompt": pick(6)})
    rows = rows.where(measures.is_valid_weight(F.col("raw_value")))
    rows = rows.withColumn("value", F.regexp_replace("raw_value", r"^\.+|\.+$", ""))
    rows = rows.withColumns({"normalized_value": measures.normalize_weight(F.col("value"), F.col("unit")), "normalized_unit": measures.unit_kind(F.col("unit"))})
    rows = rows.where(~measures.is_extreme_weight(F.col("normalized_value"), F.col("count")))
    automatic = F.when(F.col("name") == "multi_packaging", True).otherwise(constant(7).cast("boolean")) & ~measures.is_suspicious_weight(F.col("normalized_value"))
    shown = F.concat(F.when(F.col("count").isNotNull(), F.concat(F.col("count"), F.lit(" x "))).otherwise(""), F.col("value"), F.lit(" "), F.col("unit"))
    data = {
        "raw": F.col("raw"), "value": F.col("value"), "unit": F.col("unit"), "count": F.col("count"), "prompt": F.col("prompt"),
        "normalized_value": F.col("normalized_value"), "normalized_unit": F.col("normalized_unit"),
        "automatic_processing": automatic, "matcher_type": F.col("name"), "priority": constant(1).cast("int"),
    }
    return predictions(rows, keep, "product_weight", data, value=shown, automatic=automatic, predictor="regex")


def product_weight_type() -> TextType:
    return TextType(_table([(n, "contiguous", p) for n, _, p, *_ in fixed.WEIGHT_PATTERNS]), weight_predictions)


def extract_product_weight(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, product_weight_type(), keep, text_col)


def expiration_date_type(years: tuple[int, int] = fixed.EXPIRATION_YEARS) -> TextType:
    """Dates in the date patterns whose year lies in ``years``."""

    def finish(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
        g = F.col("g")
        rows = found.withColumn("iso", measures.parse_date(g[0], g[1], g[2], *years)).where("iso is not null")
        return predictions(rows, keep, "expiration_date", {"raw": F.col("raw"), "type": F.col("name")}, value=F.col("iso"), automatic=True, predictor="regex")

    return TextType([(n, "full", p, [1, 2, 3]) for n, p, _ in fixed.DATE_PATTERNS], finish)


def extract_expiration_date(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", years: tuple[int, int] = fixed.EXPIRATION_YEARS) -> DataFrame:
    return extract_type(df, expiration_date_type(years), keep, text_col)


BRAND_SOURCES = (("curated-list", True), ("taxonomy", False))


def brand_type(curated: DataFrame | None, from_taxonomy: DataFrame | None, blacklist: DataFrame | None = None) -> TextType:
    """Curated dictionary (automatic) and taxonomy dictionary (not automatic), filtered."""

    def usable(terms: DataFrame) -> DataFrame:
        kept = terms.where(~F.col("name").rlike("^[0-9]+$"))
        return kept if blacklist is None else kept.join(blacklist.select(F.col("brand_tag").alias("key")), "key", "left_anti")

    def finish(found: DataFrame | None, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
        return union_all([
            predictions(hits[source], keep, "brand", {"text": F.col("matched")}, value_tag=F.col("key"), value=F.col("name"), automatic=automatic, predictor=source)
            for source, automatic in BRAND_SOURCES if source in hits
        ])

    given = zip(BRAND_SOURCES, (curated, from_taxonomy), strict=True)
    return TextType([], finish, {source: usable(terms) for (source, _), terms in given if terms is not None})


def extract_brand(df: DataFrame, curated: DataFrame | None, from_taxonomy: DataFrame | None, blacklist: DataFrame | None = None,
                  keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, brand_type(curated, from_taxonomy, blacklist), keep, text_col)


def category_type(nodes: DataFrame) -> TextType:
    """Protected-origin phrases whose tag is in the category taxonomy."""

    def finish(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
        lang, group = F.split_part("name", F.lit("|"), F.lit(1)), F.split_part("name", F.lit("|"), F.lit(2)).cast("int")
        rows = found.withColumn("id", F.concat(lang, text.taxonomy_tag(F.element_at("g", group))))
        rows = rows.join(nodes.select("id").distinct(), "id")
        return predictions(rows, keep, "category", {"text": F.col("raw")}, value_tag=F.col("id"), automatic=False, predictor="regex")

    return TextType([(f"{lang}|{group}", "contiguous", p, _groups(p)) for lang, p, group in fixed.PROTECTED_ORIGIN_PATTERNS], finish)


def extract_category(df: DataFrame, nodes: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, category_type(nodes), keep, text_col)


def store_type(stores: Sequence[tuple[str, str | None]]) -> TextType:
    """One alternation over store patterns, longest store name first.

    ``stores``: (name, pattern or None); the pattern list is a configuration file of a few
    hundred lines, hence a driver-side argument.  The alternative that matched is found by
    testing the match text in order.
    """
    table: dict[str, str] = {}
    for name, pattern in stores:
        table[name] = pattern or re.sub(r"([^\w\s]| )", r"\\\1", name.lower())
    ordered = sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    whole = "(?iuU)" + "|".join(rf"(?:(?<!\w)(?:{p})(?!\w))" for _, p in ordered)
    entries = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(rf"(?iuU)^(?:{p})$").alias("p")) for n, p in ordered])

    def finish(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
        rows = found.withColumn("store", F.try_element_at(F.filter(entries, lambda e: F.regexp_like(F.col("raw"), e["p"])), F.lit(1))["n"])
        return predictions(rows, keep, "store", {"text": F.col("raw")}, value_tag=text.store_tag(F.col("store")), value=F.col("store"), predictor="regex")

    return TextType([("store", "contiguous", whole, [])], finish)


def extract_store(df: DataFrame, stores: Sequence[tuple[str, str | None]], keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, store_type(stores), keep, text_col)


def extract_trace(df: DataFrame, allergens: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", reach: int = 100) -> DataFrame:
    """Allergens in the 100 characters after a trace prompt."""
    flat = df.select(*keep, text.contiguous(F.col(text_col)).alias("__flat")).where(F.col("__flat").rlike(fixed.TRACE_PROMPT))
    prompts = flat.select(*keep, "__flat", F.explode(match_array(F.col("__flat"), fixed.TRACE_PROMPT)).alias("m"))
    windows = prompts.select(
        *keep, F.col("m.raw").alias("prompt"), F.col("m.start").alias("prompt_start"), F.col("m.end").alias("prompt_end"),
        F.substring(F.col("__flat"), F.col("m.end") + 1, F.lit(reach)).alias("captured"),
    )
    hits = dict_match(windows, allergens, [*keep, "prompt", "prompt_start", "prompt_end"], "captured")
    hits = hits.withColumns({"start": F.col("prompt_end") + F.col("start"), "end": F.col("prompt_end") + F.col("end")})
    return predictions(hits, keep, "trace", {"text": F.col("matched"), "prompt": F.col("prompt")}, value_tag=F.col("key"), predictor="regex")


def _value_patterns() -> list[tuple[str, str, str, list[int]]]:
    out = []
    for nutrient, units in fixed.NUTRIENT_UNITS.items():
        names = "|".join(n for n, _ in fixed.NUTRIENT_MENTIONS[nutrient])
        pattern = rf"(?iuU)(?<!\w)({names}) ?(?:[:-] ?)?([0-9]+[,.]?[0-9]*) ?({'|'.join(units)})(?!\w)"
        out.append((nutrient, "contiguous", pattern, [2, 3]))
    return out


def nutrient_hits(found: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per ``name value unit`` hit."""
    return found.select(*keep, F.col("name").alias("nutrient"), "raw", F.replace(F.col("g")[0], F.lit(","), F.lit(".")).alias("value"), F.col("g")[1].alias("unit"), "start", "end", "seq")


def nutrient_value_rows(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return nutrient_hits(regex_extract(df, _value_patterns(), keep, text_col), keep)


def nutrient_predictions(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """One prediction per text: nutrient -> list of hits in text order."""
    rows = nutrient_hits(found, keep)
    hit = F.struct("start", F.struct("raw", "nutrient", "value", "unit").alias("v"))
    lists = rows.groupBy(*keep, "nutrient").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h["v"]).alias("hits"))
    whole = lists.groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.struct("nutrient", "hits"))).alias("nutrients"))
    return predictions(whole, keep, "nutrient", {"nutrients": F.col("nutrients")}, predictor="regex", span=False)


def nutrient_type() -> TextType:
    return TextType(_value_patterns(), nutrient_predictions)


def extract_nutrient_values(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, nutrient_type(), keep, text_col)


# ASCII stretches, lower case: every mention of the nutrient holds one (none for salt: too short).
MENTION_LITERALS = {
    "energy": ["nerg", "calorie"], "saturated_fat": ["satur", "verzadigde", "ttigte", "ttede", "tett"], "trans_fat": ["trans"],
    "fat": ["mati", "graisse", "lipide", "total fat", "vetten", "fett", "grasas", "grassi", "pidos", "fedt", "zs"],
    "sugar": ["sucre", "sugar", "zuccheri", "suiker", "zucker", "cares", "sukkerarter", "cukrok"],
    "carbohydrate": ["carbohydrate", "glucid", "carboidrati", "koolhydra", "kohlenhydrate", "hidratos", "kulhydrat", "nhidr"],
    "protein": ["prot", "eiwit", "eiwei", "feh"], "salt": [], "fiber": ["fibre", "fiber", "vezel", "ballaststoffe", "fibra", "rost"],
    "nutrition_values": ["nutri", "moyenne", "valori", "waarden", "ringsindhold", "rt"],
}


def _mention_patterns() -> list[tuple[str, str, str, list[int], list[str]]]:
    """One alternation per nutrient.

    The word guards bind only the first and last alternative, as the guards sit outside
    an ungrouped alternation.
    """
    out = []
    for nutrient, names in fixed.NUTRIENT_MENTIONS.items():
        body = "|".join(n for n, _ in names)
        out.append((nutrient, "contiguous", rf"(?iuU)(?<!\w){body}(?!\w)", [], MENTION_LITERALS[nutrient]))
    out.append(("nutrient_value", "contiguous", fixed.NUTRIENT_VALUE_PATTERN, [], []))
    return out


def mention_hits(found: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per mention with its languages (none for bare values)."""
    langs = F.lit(None).cast("array<string>")
    for nutrient, names in fixed.NUTRIENT_MENTIONS.items():
        # the alternative is found again on the short match: the first that is all of it
        own = F.coalesce(*[F.when(F.col("raw").rlike(f"(?iuU)^(?:{n})$"), F.array(*map(F.lit, spoken))) for n, spoken in names])
        langs = F.when(F.col("name") == nutrient, own).otherwise(langs)
    return found.select(*keep, F.col("name").alias("nutrient"), "raw", langs.alias("languages"), "start", "end")


def nutrient_mention_rows(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return mention_hits(regex_extract(df, _mention_patterns(), keep, text_col), keep)


def mention_predictions(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    rows = mention_hits(found, keep)
    hit = F.struct("start", F.struct("raw", F.array("start", "end").alias("span"), "languages").alias("v"))
    lists = rows.groupBy(*keep, "nutrient").agg(F.transform(F.array_sort(F.collect_list(hit)), lambda h: h["v"]).alias("hits"))
    whole = lists.groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.struct("nutrient", "hits"))).alias("mentions"))
    return predictions(whole, keep, "nutrient_mention", {"mentions": F.col("mentions")}, span=False)


def nutrient_mention_type() -> TextType:
    return TextType(_mention_patterns(), mention_predictions)


def extract_nutrient_mentions(df: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    return extract_type(df, nutrient_mention_type(), keep, text_col)


def flag_predictions(found: DataFrame | None, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
    """The first dictionary hit of each text."""
    first = hits["flags"].groupBy(*keep).agg(F.min_by(F.struct("matched", "key", "end"), "start").alias("h"), F.min("start").alias("start"))
    first = first.select(*keep, "start", F.col("h.end").alias("end"), "h.matched", "h.key")
    return predictions(first, keep, "image_flag", {"text": F.col("matched"), "type": F.lit("text"), "label": F.col("key")})


def image_flag_type(words: DataFrame) -> TextType:
    """``words``: (key, name, pattern) with key the flag label."""
    return TextType([], flag_predictions, {"flags": words})


def extract_image_flag(df: DataFrame, words: DataFrame, keep: Sequence[str] = ("source_image",), text_col: str = "text") -> DataFrame:
    """Flags: first dictionary hit, unsafe likelihoods, first flagged label, best face."""
    return union_all([extract_type(df, image_flag_type(words), keep, text_col), *vision_flags(df, keep)])


def vision_flags(df: DataFrame, keep: Sequence[str]) -> list[DataFrame]:
    """Flags of the vision columns there are: ``safe_search`` struct, ``labels`` and ``faces`` arrays."""
    out = []
    if "safe_search" in df.columns:
        worst = fixed.LIKELIHOODS[-1]
        for label in ("adult", "violence"):
            rows = df.where(F.col(f"safe_search.{label}") == worst)
            out.append(predictions(rows, keep, "image_flag", {"type": F.lit("safe_search_annotation"), "label": F.lit(label), "likelihood": F.lit(worst)}, span=False))
    if "labels" in df.columns:
        first = F.try_element_at(F.filter("labels", lambda x: x["description"].isin(fixed.FLAGGED_LABELS) & (x["score"] >= 0.6)), F.lit(1))
        rows = df.withColumn("__l", first).where("__l is not null")
        out.append(predictions(rows, keep, "image_flag", {"type": F.lit("label_annotation"), "label": F.lower("__l.description"), "likelihood": F.col("__l.score")}, confidence=F.col("__l.score"), span=False))
    if "faces" in df.columns:
        best = F.array_max(F.transform("faces", lambda f: F.coalesce(f["detectionConfidence"], F.lit(0.0))))
        rows = df.withColumn("__f", best).where(F.col("__f") >= 0.6)
        out.append(predictions(rows, keep, "image_flag", {"type": F.lit("face_annotation"), "label": F.lit("face"), "likelihood": F.col("__f")}, confidence=F.col("__f"), span=False))
    return out


def flag_moderation_rows(flags: DataFrame, source: str = "larder") -> DataFrame:
    """Flags to moderation rows (reason, comment); beauty texts are not sent."""
    kind, label = F.get_json_object("data", "$.type"), F.get_json_object("data", "$.label")
    reason = (
        F.when(kind == "safe_search_annotation", "inappropriate")
        .when((kind == "label_annotation") & label.isin(fixed.HUMAN_LABELS), "human")
        .when(kind == "face_annotation", "human")
        .otherwise("other")
    )
    comment = (
        F.when(label.isNull(), F.lit(f"{source} detection"))
        .when(kind == "text", F.concat(F.lit(f"{source} detection: '"), F.get_json_object("data", "$.text"), F.lit("' ("), label, F.lit(")")))
        .otherwise(F.concat(F.lit(f"{source} detection: "), label))
    )
    skipped = F.coalesce((kind == "text") & (label == "beauty"), F.lit(False))
    return flags.where(~skipped).withColumns({"reason": reason, "comment": comment})


def extract_location(df: DataFrame, cities: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text",
                     distance: int = 10, extract: int = 30, country: str = "fr") -> DataFrame:
    """Cities with their own postal code nearby.  ``cities``: (name, postal_code)."""
    from larder.operators.joins import nearby_match_join

    plain = F.translate(text.strip_accents(F.lower(F.col(text_col))), "'-", "  ")
    base = df.select(*keep, plain.alias("__plain"))
    terms = cities.where(F.col("postal_code").rlike("^[0-9]{5}$")).select(F.col("postal_code").alias("key"), "name", F.lower("name").alias("pattern"))
    hits = dict_match(base, terms, keep, "__plain").withColumn("postal_code", F.col("key"))
    id_col = keep[0]
    near = nearby_match_join(hits, base.withColumnRenamed("__plain", "text"), id_col, "text", distance)
    begin = F.greatest(F.lit(0), F.least("start", "pc_start") - extract)
    finish = F.greatest("end", "pc_end") + extract
    data = {
        "country_code": F.lit(country), "city_name": F.col("name"), "postal_code": F.col("postal_code"),
        "text_extract": F.substring(F.col("__text"), begin + 1, finish - begin),
    }
    return predictions(near, keep, "location", data)


def packaging_pattern(shapes: Sequence[str], materials: Sequence[str], recyclings: Sequence[str]) -> str:
    """Shape, optional "en", up to two materials, optional "a" + recycling verb."""

    def alternation(names: Sequence[str]) -> str:
        return "|".join(re.sub(r"([^\w\s])", r"\\\1", n) for n in sorted(set(names), key=lambda n: (-len(n), n)))

    s, m, r = alternation(shapes), alternation(materials), alternation(recyclings)
    return rf"\b({s})\b(?:(?:\s+en)?\s+\b({m})\b(?:\s+\b({m})\b)?)?(?:\s+a\s+\b({r})\b)?"


def packaging_type(shapes: dict[str, str], materials: dict[str, str], recyclings: dict[str, str], lang: str = "fr") -> TextType:
    """Packaging elements; of two materials the last counts.

    The maps are name -> tag of one language (a few hundred names each).
    """

    def tagged(value: Column, table: dict[str, str]) -> Column:
        entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        return F.when(value != "", F.struct(value.alias("value"), F.try_element_at(entries, value).alias("value_tag")))

    def finish(found: DataFrame, hits: dict[str, DataFrame], keep: Sequence[str]) -> DataFrame:
        g = F.col("g")
        material = F.when(g[2] != "", g[2]).otherwise(g[1])
        rows = found.withColumns({"shape": tagged(g[0], shapes), "material": tagged(material, materials), "recycling": tagged(g[3], recyclings)})
        weak = F.col("shape.value_tag").isNull() | F.col("shape.value_tag").isin(fixed.SHAPE_ONLY_EXCLUDED)
        rows = rows.where(~(weak & F.col("material").isNull() & F.col("recycling").isNull()))

        def quoted(c: str) -> Column:
            return F.coalesce(F.concat(F.lit("'"), F.col(f"{c}.value_tag"), F.lit("'")), F.lit("None"))

        key = F.concat(F.lit("{'shape': "), quoted("shape"), F.lit(", 'material': "), quoted("material"), F.lit(", 'recycling': "), quoted("recycling"), F.lit("}"))
        data = {"lang": F.lit(lang), "element": F.struct("shape", "material", "recycling")}
        return predictions(rows, keep, "packaging", data, value=key, automatic=False, predictor="grammar")

    return TextType([("packaging", "clean", packaging_pattern(list(shapes), list(materials), list(recyclings)), [1, 2, 3, 4])], finish)


def extract_packaging(df: DataFrame, shapes: dict[str, str], materials: dict[str, str], recyclings: dict[str, str],
                      keep: Sequence[str] = ("doc_id",), text_col: str = "text", lang: str = "fr") -> DataFrame:
    return extract_type(df, packaging_type(shapes, materials, recyclings, lang), keep, text_col)


def extract_image_lang(words: DataFrame, keep: Sequence[str] = ("source_image",)) -> DataFrame:
    """Word counts and percents per language of an image (``words`` rows with ``lang``)."""
    from larder.operators.aggregates import image_language_share

    counts = words.groupBy(*keep, F.coalesce("lang", F.lit("null")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy(*keep).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"), F.sum("n").alias("w"))
    maps = maps.withColumn("count", F.map_concat("m", F.create_map(F.lit("words"), F.col("w"))))
    return predictions(maps, keep, "image_lang", {"count": F.col("count"), "percent": image_language_share(F.col("count"))}, span=False)


def extract_image_orientation(words: DataFrame, keep: Sequence[str] = ("source_image",)) -> DataFrame:
    from larder.operators.aggregates import orientation_mode

    modes = orientation_mode(words, *keep)
    data = {"orientation": F.col("orientation"), "count": F.col("count"), "rotation": boxes.rotation_angle(F.col("orientation"))}
    return predictions(modes, keep, "image_orientation", data, span=False)


def ingredient_dictionary(names: DataFrame, combinations: bool = True) -> DataFrame:
    """(pattern, node_id, lang) from taxonomy names and synonyms, folded and lower-cased.

    With ``combinations`` each word of a multi-word name may be replaced by the synonyms
    of that word in the same language.  Words are joined one position at a time, so the
    expansion is a chain of equi-joins on (word, lang).
    """
    base = (
        names.where(F.col("lang").isin(fixed.INGREDIENT_LANGS) & ~F.col("node_id").isin(fixed.INGREDIENT_EXCLUDED))
        .select("node_id", "lang", text.fold(F.lower("name")).alias("pattern")).where(F.length("pattern") > 1).distinct()
    )
    if not combinations:
        return base
    swaps = base.select(F.col("pattern").alias("word"), "lang", "node_id").join(
        base.select("node_id", "lang", F.col("pattern").alias("alt")), ["node_id", "lang"]
    ).select("word", "lang", "alt").distinct()
    multi = base.select("node_id", "lang", F.split("pattern", " ").alias("words")).where(F.size("words") > 1)
    longest = multi.agg(F.max(F.size("words")).alias("n")).first()["n"] or 0
    built = multi.withColumn("built", F.lit(None).cast("string"))
    for i in range(longest):
        step = built.withColumn("word", F.try_element_at("words", F.lit(i + 1))).join(swaps, ["word", "lang"], "left")
        choices = F.array_compact(F.array_distinct(F.array("word", "alt")))
        step = step.select("node_id", "lang", "words", "built", F.explode_outer(choices).alias("w")).distinct()
        built = step.select("node_id", "lang", "words", F.concat_ws(" ", "built", "w").alias("built"))
    return base.unionByName(built.select("node_id", "lang", F.col("built").alias("pattern"))).distinct()


def extract_ingredient_mentions(texts: DataFrame, dictionary: DataFrame, key: str = "barcode", order: str = "position", text_col: str = "text") -> DataFrame:
    """Distinct ingredient ids of a product's texts, first mention first.

    ``texts``: (key, order, text), a row per text.  ``dictionary``: (pattern, node_id, lang).
    Every text is matched by itself; of a product only the first place of each id is kept
    before its ids come together, so what is gathered is bounded by the dictionary.
    """
    flat = text.collapse_spaces(F.replace(F.col(text_col), F.lit("\n"), F.lit(" ")))
    base = texts.where(F.col(text_col).isNotNull()).select(key, F.col(order).alias("__order"), text.fold(F.lower(flat)).alias("__t"))
    terms = dictionary.groupBy("pattern").agg(F.array_sort(F.collect_set("node_id")).alias("ids")).select(F.lit("").alias("key"), F.col("pattern").alias("name"), "pattern", "ids")
    hits = dict_match(base, terms, [key, "__order"], "__t")
    places = hits.select(key, F.col("__order"), "start", F.posexplode("ids").alias("nth", "node_id"))
    first = places.groupBy(key, "node_id").agg(F.min(F.struct("__order", "start", "nth")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node_id"))), lambda x: x["node_id"]).alias("ingredients"))


def taxonomy_terminals(names: DataFrame, lang: str, ignored: Sequence[str] = ()) -> DataFrame:
    """(name, ids) of one language, longest first; a name of several nodes keeps all ids."""
    rows = names.where((F.col("lang") == lang) & ~F.col("node_id").isin(list(ignored)))
    rows = rows.select(text.collapse_spaces(F.lower(text.fold(F.col("name")))).alias("term"), "node_id")
    return rows.where("term <> ''").groupBy("term").agg(F.array_sort(F.collect_set("node_id")).alias("ids")).withColumn(
        "term_length", F.length("term")
    ).orderBy(F.desc("term_length"), "term")


def extend_span_mentions(df: DataFrame, traces: Sequence[str] = (), organic: Sequence[str] = tuple(fixed.ORGANIC_MENTIONS), text_col: str = "text", end_col: str = "end") -> DataFrame:
    """Move ``end`` over following organic and trace phrases, until none follows.

    The phrase lists are patterns; separators are blanks, dots and commas.  Without a
    phrase the end stays where it was.
    """
    body = "|".join([*organic, *traces])
    pattern = rf"(?iuU)^(?:[\s.,]*(?:{body}))+"
    rest = F.substring(F.col(text_col), F.col(end_col) + 1, F.length(text_col))
    return df.withColumn(end_col, F.col(end_col) + F.length(F.regexp_extract(rest, pattern, 0)))


def detect_language_join(df: DataFrame, scorer: Column, out: str = "languages") -> DataFrame:
    """Attach ``array<struct<lang,confidence>>`` of a user scorer (an Arrow UDF call)."""
    return df.withColumn(out, scorer)


#: Types whose predictions come from patterns and dictionaries over the texts; the arguments are theirs.
TEXT_TYPES: dict[str, Callable[..., TextType]] = {
    "packager_code": packager_code_type,
    "label": label_type,
    "product_weight": product_weight_type,
    "expiration_date": expiration_date_type,
    "brand": brand_type,
    "category": category_type,
    "store": store_type,
    "packaging": packaging_type,
    "image_flag": image_flag_type,
    "nutrient": nutrient_type,
    "nutrient_mention": nutrient_mention_type,
}

#: Other extractors ``(df, keep=..., text_col=..., **arguments) -> predictions``.
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "trace": extract_trace,
    "location": extract_location,
    "image_lang": lambda df, words, keep, text_col: extract_image_lang(words, keep),
    "image_orientation": lambda df, words, keep, text_col: extract_image_orientation(words, keep),
}


def register_extractor(type: str, function: Callable[..., DataFrame]) -> None:
    """Plug in an extractor ``(df, keep=..., text_col=...) -> predictions``; it stands before a built-in one."""
    EXTRACTORS[type] = function


def extract_all(df: DataFrame, types: Sequence[str] = tuple(fixed.OCR_DEFAULT_TYPES), keep: Sequence[str] = ("source_image",), text_col: str = "text", **arguments: dict) -> DataFrame:
    """Predictions of the named types; ``arguments[type]`` holds what a type asks for (dictionaries, ``words``).

    All patterns and dictionaries of the types that look into the texts run in one reading
    of them.  Their matches are written once, tagged with their type, and each type makes
    its predictions of its own matches.
    """
    named = {t: TEXT_TYPES[t](**arguments.get(t, {})) for t in types if t in TEXT_TYPES and t not in EXTRACTORS}
    parts = [EXTRACTORS[t](df, keep=keep, text_col=text_col, **arguments.get(t, {})) for t in types if t not in named]
    if named:
        parts += scanned(df, named, keep, text_col)
    if "image_flag" in named:
        parts += vision_flags(df, keep)
    return union_all(parts)


def scanned(df: DataFrame, types: dict[str, TextType], keep: Sequence[str], text_col: str, most_chars: int = MOST_TERM_CHARS) -> list[DataFrame]:
    """Predictions of each type from one scan; dictionaries over ``most_chars`` meet the texts in joins of their own."""
    tables = {(t, n): normalised_terms(terms) for t, kind in types.items() for n, terms in kind.dictionaries.items()}
    held = dict(zip(tables, collected_terms(list(tables.values()), most_chars), strict=True))
    patterns = [(f"{t}\t{p[0]}", *p[1:]) for t, kind in types.items() for p in kind.patterns]
    small = {f"{t}\t{n}": h for (t, n), h in held.items() if h is not None}
    found, _ = cut_lineage(scan_texts(df, patterns, small, keep, text_col))
    own = found.withColumns({"type": F.split_part("name", F.lit("\t"), F.lit(1)), "name": F.split_part("name", F.lit("\t"), F.lit(2))})
    out = []
    for t, kind in types.items():
        mine = own.where(F.col("type") == t).drop("type")
        hits = {}
        for n, terms in kind.dictionaries.items():
            if held[t, n] is None:
                hits[n] = dict_match_join(df, terms, keep, text_col)
            else:
                rows = mine.where((F.col("name") == n) & (F.col("seq") == len(patterns)))
                hits[n] = rows.select(*keep, F.col("g")[0].alias("pattern"), "start", "end", F.col("raw").alias("matched")).join(tables[t, n], "pattern")
        out.append(kind.finish(mine.where(F.col("seq") < len(patterns)), hits, keep))
    return out


def product_name_predictions(found: DataFrame) -> DataFrame:
    """Predictions read from the product name: never automatic, source noted."""
    marked = F.to_json(F.map_concat(F.from_json("data", "map<string,string>"), F.create_map(F.lit("source"), F.lit("product_name"))))
    return found.where(F.col("type").isin(fixed.PRODUCT_NAME_TYPES)).withColumns({"automatic_processing": F.lit(False), "data": marked})
