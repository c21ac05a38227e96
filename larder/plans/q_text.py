"""Queries: dictionary and pattern matching, extractors over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import fixed
from larder.operators import extractors as E
from larder.operators import language
from larder.operators import text_match as M
from larder.plans import flows
from larder.plans.q_core import ORIENTATION, words
from larder.plans.q_scalar import sql_fold
from larder.plans.registry import ORACLES, Data, query, spread

# Dictionary made of the benchmark passages: their openings of one to three words and long words.
TERM_SQL = """
SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS pattern FROM benchmark WHERE regexp_extract(text, '^([A-Za-z]+)', 1) <> ''
UNION SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1)) FROM benchmark WHERE regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1) <> ''
UNION SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+ [a-z]+ [a-z]+)', 1)) FROM benchmark WHERE regexp_extract(text, '^([A-Za-z]+ [a-z]+ [a-z]+)', 1) <> ''
"""


def benchmark_terms(d: Data):
    t = d.benchmark
    parts = [t.select(F.lower(F.regexp_extract("text", p, 1)).alias("pattern")) for p in ("^([A-Za-z]+)", "^([A-Za-z]+ [a-z]+)", "^([A-Za-z]+ [a-z]+ [a-z]+)")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("pattern <> ''").distinct()
    return rows.select(F.concat(F.lit("k:"), "pattern").alias("key"), F.col("pattern").alias("name"), "pattern")


DICT = f"""
WITH terms AS ({TERM_SQL}), pat AS (SELECT '\\b(?:' || string_agg(pattern, '|' ORDER BY length(pattern) DESC, pattern) || ')\\b' AS p FROM terms),
m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), p)) AS pattern FROM documents, pat)
SELECT doc_id, 'k:' || pattern AS key, count(*) AS n, count(*) AS n_right_span FROM m GROUP BY 1, 2
"""


def spans_counted(hits):
    right = F.sum((F.lower("matched") == F.col("pattern")).cast("long"))
    return hits.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), right.alias("n_right_span"))


@query("dict_match", DICT)
def _(d):
    return spans_counted(M.dict_match(spread(d.documents), benchmark_terms(d)))


@query("dict_match_join", DICT)
def _(d):
    """The same matches through the big-dictionary path."""
    return spans_counted(M.dict_match(spread(d.documents), benchmark_terms(d), joined=True))


@query("dictionary_join", rf"""
WITH t AS (SELECT DISTINCT lower(regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1)) AS pattern FROM benchmark WHERE regexp_extract(text, '^([A-Za-z]+ [a-z]+)', 1) <> ''),
pat AS (SELECT '\b(?:' || string_agg(pattern, '|' ORDER BY length(pattern) DESC, pattern) || ')\b' AS p FROM t)
SELECT conv_id, turn, len(regexp_extract_all(lower(text), p)) AS n FROM conversations, pat WHERE len(regexp_extract_all(lower(text), p)) > 0
""")
def _(d):
    two = benchmark_terms(d).where("pattern rlike '^[a-z]+ [a-z]+$'")
    hits = M.dict_match_join(d.conversations, two, ["conv_id", "turn"])
    return hits.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))


@query("dict_match_fuzzy", """
WITH terms AS (SELECT DISTINCT w AS pattern FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS w FROM benchmark) WHERE length(w) >= 9),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]+')) AS w FROM documents), v AS (SELECT DISTINCT w FROM w),
c AS (SELECT v.w, t.pattern, levenshtein(v.w, t.pattern) AS cost FROM v, terms t WHERE abs(length(v.w) - length(t.pattern)) <= 1 AND levenshtein(v.w, t.pattern) <= 1
  QUALIFY row_number() OVER (PARTITION BY v.w ORDER BY cost, t.pattern) = 1)
SELECT w.doc_id, c.pattern, c.cost, count(*) AS n FROM w JOIN c ON w.w = c.w GROUP BY 1, 2, 3
""")
def _(d):
    long = d.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("pattern")).where(F.length("pattern") >= 9).distinct()
    hits = M.dict_match_fuzzy(d.documents, long.select(F.lit("k").alias("key"), F.col("pattern").alias("name"), "pattern"), 1)
    return hits.groupBy("doc_id", "pattern", F.col("cost").cast("long").alias("cost")).agg(F.count(F.lit(1)).alias("n"))


def generated_terms(n: int):
    """SQL of n terms: every word that begins a passage, and words made of numbers that no text holds."""
    return f"""
SELECT DISTINCT 'k:' || w AS key, w AS pattern FROM (SELECT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS w FROM benchmark) WHERE w <> ''
UNION ALL SELECT 'g:' || cast(l_orderkey * 8 + l_linenumber AS string), 'zq' || cast(l_orderkey * 8 + l_linenumber AS string) || ' term' FROM lineitem WHERE l_orderkey * 8 + l_linenumber < {n}"""


@query("dict_match_large", rf"""
WITH terms AS ({generated_terms(10**9)}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS pattern FROM documents)
SELECT doc_id, key, count(*) AS n, count(*) AS n_right_span FROM w JOIN terms USING (pattern) GROUP BY 1, 2
""")
def _(d):
    """As many terms as there are order lines, and the words that begin passages."""
    terms = d.sql(generated_terms(10**9)).select("key", F.col("pattern").alias("name"), "pattern")
    return spans_counted(M.dict_match(d.documents, terms))


@query("regex_extract", r"""
SELECT page_id AS doc_id, 'href' AS name, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS g FROM pages
UNION ALL SELECT page_id, 'tag', unnest(regexp_extract_all(html, '<(h[1-6])', 1)) FROM pages
""")
def _(d):
    pages = d.pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    hits = M.regex_extract(pages, [("href", "full", 'href="([^"]*)"', [1]), ("tag", "full", "<(h[1-6])", [1])])
    return hits.select("doc_id", "name", F.col("g")[0].alias("g"))


# --- extractors ---------------------------------------------------------------

FLAT = "replace(text, chr(10), ' ')"


@query("extract_packager_code", rf"""
SELECT doc_id, upper('EMB ' || replace(g[1], ' ', '') || g[2]) AS value FROM (SELECT doc_id, [regexp_extract(m, '(?i)emb ?(\d ?\d ?\d ?\d ?\d) ?([a-z])?', 1), regexp_extract(m, '(?i)emb ?(\d ?\d ?\d ?\d ?\d) ?([a-z])?', 2)] AS g
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(emb ?\d ?\d ?\d ?\d ?\d ?[a-z]?)(?:[^a-zA-Z0-9]|$)', 1)) AS m FROM ocr_text))
UNION ALL SELECT doc_id, 'FR ' || upper(replace(substring(m, 4, length(m) - 6), ' ', '.')) || ' EC' FROM (SELECT doc_id, unnest(regexp_extract_all({FLAT}, '(?i)(fr (?:\d{{2,3}}|2[ab])[-\s.]\d{{3}}[-\s.]\d{{3}} (?:ce|ec))(?:[^a-zA-Z0-9]|$)', 1)) AS m FROM ocr_text)
""")
def _(d):
    return E.extract_packager_code(d.ocr_text).select("doc_id", "value")


@query("extract_label", rf"""
SELECT doc_id, 'en:organic' AS value_tag, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({FLAT}, '(?i)ingr[ée]dients?\sbiologiques?|ingr[ée]dients?\sbio[\s.,)]|agriculture bio(?:logique)?[\s.,)]|production bio(?:logique)?[\s.,)]')) FROM ocr_text) GROUP BY 1
UNION ALL SELECT doc_id, 'en:' || lower(m), count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^a-zA-Z])([A-Z]{{2}}-BIO-\d{{2,3}})', 1)) AS m FROM ocr_text) GROUP BY 1, 2
UNION ALL SELECT doc_id, 'en:nutriscore', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'NUTRI-SCORE')) FROM ocr_text) GROUP BY 1
UNION ALL SELECT doc_id, 'en:no-preservatives', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all({FLAT}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:sans|ni) conservateur')) FROM ocr_text) GROUP BY 1
""")
def _(d):
    return E.extract_label(d.ocr_text).groupBy("doc_id", "value_tag").agg(F.count(F.lit(1)).alias("n"))


WP = "(?i)(?:^|[^a-zA-Z])(?:poids|poids net|net weight) ?:? ?([0-9]+[,.]?[0-9]*)\\s?(ge?|mle?|kge?|le?|oz|lbs|cle?|dle?|mge?|fl oz)(?:[^a-zA-Z]|$)"
MP = "(?i)(?:^|[^a-zA-Z])(\\d+)\\s?x\\s?([0-9]+[,.]?[0-9]*)\\s?(ge?|mle?|kge?|le?|oz|lbs|cle?|dle?|mge?|fl oz)(?:[^a-zA-Z]|$)"
NP = "(?i)(?:^|[^a-zA-Z])([0-9]+[,.]?[0-9]*)\\s?(dle|cle|mge|mle|ge|kge)(?:[^a-zA-Z]|$)"


def weight_rows(name: str, pattern: str, count: int, value: int, unit: int) -> str:
    def group(g: int) -> str:
        return f"unnest(regexp_extract_all({FLAT}, '{pattern}', {g}))"

    return f"SELECT doc_id, '{name}' AS matcher, {group(count) if count else 'NULL'} AS c, {group(value)} AS v, {group(unit)} AS u FROM ocr_text"


@query("extract_product_weight", f"""
WITH m AS ({weight_rows('with_mention', WP, 0, 1, 2)} UNION ALL {weight_rows('multi_packaging', MP, 1, 2, 3)} UNION ALL {weight_rows('no_mention', NP, 0, 1, 2)}),
n AS (SELECT *, CASE WHEN lower(u) IN ('ge', 'kge', 'mle', 'cle', 'dle', 'mge', 'le') THEN left(lower(u), length(u) - 1) ELSE lower(u) END AS unit, TRY_CAST(replace(v, ',', '.') AS DOUBLE) AS x FROM m),
a AS (SELECT *, x * CASE unit WHEN 'g' THEN 1 WHEN 'kg' THEN 1000 WHEN 'ml' THEN 1 WHEN 'l' THEN 1000 WHEN 'cl' THEN 10 WHEN 'dl' THEN 100 WHEN 'mg' THEN 0.001e0 END AS amount FROM n WHERE x > 0 AND floor(x) = x AND NOT (v LIKE '0%' AND v NOT LIKE '%.%' AND v NOT LIKE '%,%'))
SELECT doc_id, matcher, coalesce(c || ' x ', '') || trim(v, '.') || ' ' || unit AS value, (matcher <> 'no_mention') AND NOT (amount > 1000 AND cast(floor(amount) AS BIGINT) % 10 <> 0) AS automatic FROM a WHERE amount > 10 AND amount < 10000 AND NOT coalesce(cast(c AS INT) > 20, false)
""")
def _(d):
    out = E.extract_product_weight(d.ocr_text)
    return out.select("doc_id", F.get_json_object("data", "$.matcher_type").alias("matcher"), "value", F.col("automatic_processing").alias("automatic"))


@query("extract_expiration_date", r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^0-9])([0-9]{2}[-./][0-9]{2}[-./][0-9]{2,4})(?:[^0-9]|$)', 1)) AS m FROM ocr_text),
p AS (SELECT doc_id, m, TRY_CAST(CASE WHEN length(m) = 8 THEN CASE WHEN cast(substring(m, 7) AS INT) < 69 THEN '20' ELSE '19' END || substring(m, 7) ELSE substring(m, 7) END || '-' || substring(m, 4, 2) || '-' || substring(m, 1, 2) AS DATE) AS x FROM m WHERE length(m) IN (8, 10))
SELECT doc_id, strftime(x, '%Y-%m-%d') AS value, m AS raw FROM p WHERE year(x) BETWEEN 2015 AND 2025
""")
def _(d):
    return E.extract_expiration_date(d.ocr_text).select("doc_id", "value", F.get_json_object("data", "$.raw").alias("raw"))


@query("extract_expiration_date_years", ORACLES["extract_expiration_date"].replace("BETWEEN 2015 AND 2025", "BETWEEN 2010 AND 2018"))
def _(d):
    return E.extract_expiration_date(d.ocr_text, years=(2010, 2018)).select("doc_id", "value", F.get_json_object("data", "$.raw").alias("raw"))


def literal_terms(d: Data, rows: list[tuple[str, str, str]]):
    return d.spark.createDataFrame(rows, "key string, name string, pattern string")


CURATED = [("auchan", "Auchan", "auchan production"), ("coca-cola", "Coca-Cola", "coca cola")]


@query("extract_brand", rf"""
WITH h AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b(?:auchan production|coca cola)\b')) AS p FROM ocr_text), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\b(?:coca cola light|carrefour)\b')) AS p FROM ocr_text)
SELECT doc_id, CASE p WHEN 'coca cola' THEN 'coca-cola' ELSE 'auchan' END AS value_tag, 'curated-list' AS predictor, true AS automatic_processing FROM h
UNION ALL SELECT doc_id, CASE p WHEN 'carrefour' THEN 'carrefour' ELSE 'coca-cola-light' END, 'taxonomy', false FROM t
""")
def _(d):
    taxonomy = literal_terms(d, [("carrefour", "Carrefour", "carrefour"), ("coca-cola-light", "Coca-Cola light", "coca cola light"), ("the", "The", "the"), ("12", "12", "12")])
    banned = d.spark.createDataFrame([("the",)], "brand_tag string")
    out = E.extract_brand(d.ocr_text, literal_terms(d, CURATED), taxonomy, banned)
    return out.select("doc_id", "value_tag", "predictor", "automatic_processing")


@query("extract_category", """
SELECT doc_id, 'fr:bleu-de-' || cast(doc_id % 50 AS string) AS value_tag FROM ocr_text WHERE doc_id % 12 = 11 AND 'fr:bleu-de-' || cast(doc_id % 50 AS string) IN (SELECT 'fr:bleu-de-' || cast(p_partkey AS string) FROM part WHERE p_partkey % 3 <> 0)
""")
def _(d):
    nodes = d.part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("fr:bleu-de-"), F.col("p_partkey").cast("string")).alias("id"))
    return E.extract_category(d.ocr_text, nodes).select("doc_id", "value_tag")


STORES = [("Carrefour", None), ("Carrefour Market", None), ("Auchan", "auchan"), ("U", "super u")]


@query("extract_store", rf"""
WITH m AS (SELECT doc_id, lower(unnest(regexp_extract_all({FLAT}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(carrefour market|carrefour|auchan|super u)(?:[^\p{{L}}\p{{N}}_]|$)', 1))) AS m FROM ocr_text)
SELECT doc_id, CASE m WHEN 'super u' THEN 'U' WHEN 'auchan' THEN 'Auchan' WHEN 'carrefour' THEN 'Carrefour' ELSE 'Carrefour Market' END AS value, CASE m WHEN 'super u' THEN 'u' ELSE replace(m, ' ', '-') END AS value_tag FROM m
""")
def _(d):
    return E.extract_store(d.ocr_text, STORES).select("doc_id", "value", "value_tag")


ALLERGENS = [("en:soybeans", "soja", "soja"), ("en:milk", "lait", "lait"), ("en:sesame-seeds", "sesame", "sesame")]


@query("extract_trace", rf"""
WITH c AS (SELECT doc_id, lower(unnest(regexp_extract_all({FLAT}, '(?i)(?:possibilit[ée] de traces|conditionné dans un atelier qui manipule|peut contenir(?: des traces)?|traces? [ée]ventuelles? d[e'']|traces? d[e'']|may contain)(.{{0,100}})', 1))) AS c FROM ocr_text),
h AS (SELECT doc_id, unnest(regexp_extract_all(c, '\b(?:sesame|soja|lait)\b')) AS m FROM c)
SELECT doc_id, CASE m WHEN 'soja' THEN 'en:soybeans' WHEN 'lait' THEN 'en:milk' ELSE 'en:sesame-seeds' END AS value_tag FROM h
""")
def _(d):
    return E.extract_trace(d.ocr_text, literal_terms(d, ALLERGENS)).select("doc_id", "value_tag")


def guarded(body: str) -> str:
    return body.replace("'", "''")


def nutrient_value_sql() -> str:
    parts = []
    for nutrient, units in fixed.NUTRIENT_UNITS.items():
        body = guarded("|".join(n for n, _ in fixed.NUTRIENT_MENTIONS[nutrient]))
        pattern = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{body}) ?(?:[:-] ?)?([0-9]+[,.]?[0-9]*) ?({'|'.join(units)})(?:[^\p{{L}}\p{{N}}_]|$)"
        parts.append(f"SELECT doc_id, '{nutrient}' AS nutrient, replace(unnest(regexp_extract_all({FLAT}, '{pattern}', 1)), ',', '.') AS value, unnest(regexp_extract_all({FLAT}, '{pattern}', 2)) AS unit FROM ocr_text")
    return " UNION ALL ".join(parts)


@query("nutrient_value_rows", nutrient_value_sql())
def _(d):
    return E.nutrient_value_rows(d.ocr_text).select("doc_id", "nutrient", "value", "unit")


@query("extract_nutrient_values", f"SELECT doc_id, string_agg(DISTINCT nutrient, ',' ORDER BY nutrient) AS nutrients, count(*) AS n FROM ({nutrient_value_sql()}) GROUP BY doc_id")
def _(d):
    out = E.extract_nutrient_values(d.ocr_text)
    hits = F.from_json(F.get_json_object("data", "$.nutrients"), "map<string,array<struct<raw:string>>>")
    return out.select("doc_id", F.array_join(F.array_sort(F.map_keys(hits)), ",").alias("nutrients"), F.size(F.flatten(F.map_values(hits))).cast("long").alias("n"))


def nutrient_mention_sql() -> str:
    """Guards stand for the first and the last alternative only."""
    parts = []
    for nutrient, names in fixed.NUTRIENT_MENTIONS.items():
        alternatives = [guarded(n) for n, _ in names]
        body = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{alternatives[0]})|" + "|".join(f"(?:{a})" for a in alternatives[1:]) + r"(?:[^\p{L}\p{N}_]|$)"
        parts.append(f"SELECT doc_id, '{nutrient}' AS nutrient, len(regexp_extract_all({FLAT}, '{body}')) AS n FROM ocr_text")
    value = r"(?i)(?:^|[^\p{L}\p{N}_])[0-9]+[,.]?[0-9]* ?(?:g|kj|kcal)(?:[^\p{L}\p{N}_]|$)"
    parts.append(f"SELECT doc_id, 'nutrient_value', len(regexp_extract_all({FLAT}, '{value}')) FROM ocr_text")
    return " UNION ALL ".join(parts)


@query("extract_nutrient_mentions", f"SELECT doc_id, nutrient, n FROM ({nutrient_mention_sql()}) WHERE n > 0")
def _(d):
    out = E.extract_nutrient_mentions(d.ocr_text)
    hits = F.from_json(F.get_json_object("data", "$.mentions"), "map<string,array<struct<raw:string>>>")
    return out.select("doc_id", F.explode(F.transform_values(hits, lambda k, v: F.size(v).cast("long"))).alias("nutrient", "n"))


FLAG_WORDS = [("miscellaneous", "fumer tue", "fumer tue"), ("beauty", "dimethicone", "dimethicone"), ("beauty", "benzoic acid", "benzoic acid")]


def flagged(d: Data):
    k = F.col("doc_id")
    likely = F.when(k % 8 == 0, "VERY_LIKELY").otherwise("LIKELY")
    rows = d.ocr_text.select(
        F.col("doc_id").alias("source_image"), "text", F.struct(likely.alias("adult"), F.lit("UNKNOWN").alias("violence")).alias("safe_search"),
        F.array(F.struct(F.lit("Food").alias("description"), F.lit(0.9).alias("score")), F.struct(F.when(k % 2 == 0, "Face").otherwise("Dog").alias("description"), ((k % 10) / 10).alias("score"))).alias("labels"),
        F.array(F.struct(((k % 5) / 5).alias("detectionConfidence"))).alias("faces"),
    )
    return E.extract_image_flag(rows, literal_terms(d, FLAG_WORDS))


FLAGS = """
SELECT doc_id AS source_image, 'text' AS kind, 'miscellaneous' AS label FROM ocr_text WHERE doc_id % 12 = 9 UNION ALL SELECT doc_id, 'safe_search_annotation', 'adult' FROM ocr_text WHERE doc_id % 8 = 0
UNION ALL SELECT doc_id, 'label_annotation', CASE WHEN doc_id % 2 = 0 THEN 'face' ELSE 'dog' END FROM ocr_text WHERE (doc_id % 10) / 10e0 >= 0.6 UNION ALL SELECT doc_id, 'face_annotation', 'face' FROM ocr_text WHERE (doc_id % 5) / 5e0 >= 0.6
"""


@query("extract_image_flag", FLAGS)
def _(d):
    return flagged(d).select("source_image", F.get_json_object("data", "$.type").alias("kind"), F.get_json_object("data", "$.label").alias("label"))


@query("flag_moderation_rows", f"""
SELECT source_image, CASE WHEN kind = 'safe_search_annotation' THEN 'inappropriate' WHEN kind = 'face_annotation' OR (kind = 'label_annotation' AND label = 'face') THEN 'human' ELSE 'other' END AS reason,
  CASE WHEN kind = 'text' THEN 'larder detection: ''fumer tue'' (miscellaneous)' ELSE 'larder detection: ' || label END AS comment FROM ({FLAGS})
""")
def _(d):
    return E.flag_moderation_rows(flagged(d)).select("source_image", "reason", "comment")


@query("extract_location", """
SELECT doc_id, 'paris' AS city, '75001' AS postal_code FROM ocr_text WHERE doc_id % 12 = 7 UNION ALL SELECT doc_id, 'lyon', '69001' FROM ocr_text WHERE doc_id % 12 = 7
""")
def _(d):
    cities = d.spark.createDataFrame([("paris", "75001"), ("lyon", "69001"), ("lyon", "69002"), ("rendez vous", "12345")], "name string, postal_code string").where("postal_code <> '69002'")
    out = E.extract_location(d.ocr_text, cities)
    return out.select("doc_id", F.get_json_object("data", "$.city_name").alias("city"), F.get_json_object("data", "$.postal_code").alias("postal_code"))


SHAPES = {"bouteille": "en:bottle", "boite": "en:box", "plaque": "en:backing"}
MATERIALS = {"plastique": "en:plastic", "carton": "en:cardboard", "pet": "en:pet"}
RECYCLINGS = {"recycler": "en:recycle", "jeter": "en:discard"}


@query("extract_packaging", """
SELECT doc_id, '{''shape'': ''en:bottle'', ''material'': ''en:plastic'', ''recycling'': ''en:recycle''}' AS value FROM ocr_text WHERE doc_id % 12 = 8
UNION ALL SELECT doc_id, '{''shape'': ''en:box'', ''material'': ''en:cardboard'', ''recycling'': None}' FROM ocr_text WHERE doc_id % 12 = 8
""")
def _(d):
    return E.extract_packaging(d.ocr_text, SHAPES, MATERIALS, RECYCLINGS).select("doc_id", "value")


LANG = "CASE WHEN l_suppkey % 5 = 0 THEN 'null' WHEN l_suppkey % 2 = 0 THEN 'fr' ELSE 'en' END"


@query("extract_image_lang", f"""
WITH c AS (SELECT source_image, {LANG} AS lang, count(*) AS n FROM logo GROUP BY 1, 2)
SELECT source_image, lang, n, round(n * 100 / cast(sum(n) OVER (PARTITION BY source_image) AS DOUBLE), 6) AS percent FROM c
""")
def _(d):
    out = E.extract_image_lang(words(d))
    counts = F.from_json(F.get_json_object("data", "$.count"), "map<string,long>")
    shares = F.from_json(F.get_json_object("data", "$.percent"), "map<string,double>")
    rows = out.select("source_image", F.explode(counts).alias("lang", "n"), shares.alias("s")).where("lang <> 'words'")
    return rows.select("source_image", "lang", "n", F.round(F.col("s")[F.col("lang")], 6).alias("percent"))


@query("extract_image_orientation", f"""
WITH c AS (SELECT source_image, {ORIENTATION} AS o, count(*) AS n FROM logo GROUP BY 1, 2), r AS (SELECT source_image, arg_max(o, n * 100 + ascii(o) ) AS o FROM (SELECT *, 1 FROM c WHERE o IS NOT NULL) GROUP BY source_image)
SELECT s.source_image, CASE coalesce(r.o, 'unknown') WHEN 'left' THEN 90 WHEN 'down' THEN 180 WHEN 'right' THEN 270 ELSE 0 END AS rotation FROM (SELECT DISTINCT source_image FROM logo) s LEFT JOIN r ON s.source_image = r.source_image
""")
def _(d):
    out = E.extract_image_orientation(words(d))
    return out.select("source_image", F.get_json_object("data", "$.rotation").cast("int").alias("rotation"))


# --- ingredients and taxonomy terms --------------------------------------------


def ingredient_names(d: Data):
    """Two-word names of parts; first words have a plural synonym."""
    two = d.part.select(F.concat(F.lit("en:"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("node_id"), F.col("p_name").alias("name"))
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    one = d.part.select(F.concat(F.lit("en:"), first).alias("node_id"), F.explode(F.array(first, F.concat(first, F.lit("s")))).alias("name"))
    return two.unionByName(one).distinct().withColumn("lang", F.lit("en"))


ING = """
p AS (SELECT DISTINCT p_name AS n, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part), w AS (SELECT DISTINCT a FROM p),
ing AS (SELECT 'en:' || replace(n, ' ', '-') AS node_id, n AS pattern FROM p UNION SELECT 'en:' || a, a FROM p UNION SELECT 'en:' || a, a || 's' FROM p UNION SELECT 'en:' || replace(n, ' ', '-'), a || 's ' || b FROM p
 UNION SELECT 'en:' || replace(n, ' ', '-'), a || ' ' || b || 's' FROM p WHERE b IN (SELECT a FROM w) UNION SELECT 'en:' || replace(n, ' ', '-'), a || 's ' || b || 's' FROM p WHERE b IN (SELECT a FROM w))
"""


@query("ingredient_dictionary", f"WITH {ING} SELECT node_id, pattern FROM ing")
def _(d):
    return E.ingredient_dictionary(ingredient_names(d)).select("node_id", "pattern")


@query("extract_ingredient_mentions", rf"""
WITH terms AS ({TERM_SQL}), t AS (SELECT source, {sql_fold("lower(string_agg(regexp_replace(replace(text, chr(10), ' '), ' {2,}', ' ', 'g'), '|' ORDER BY doc_id))")} AS t FROM documents GROUP BY source),
pat AS (SELECT '\b(?:' || string_agg(pattern, '|' ORDER BY length(pattern) DESC, pattern) || ')\b' AS p FROM terms), m AS (SELECT source, unnest(regexp_extract_all(regexp_replace(t, '[^\x00-\x7F]', '', 'g'), p)) AS id, generate_subscripts(regexp_extract_all(regexp_replace(t, '[^\x00-\x7F]', '', 'g'), p), 1) AS i FROM t, pat),
f AS (SELECT source, id, min(i) AS i FROM m GROUP BY 1, 2) SELECT source AS barcode, string_agg(id, ',' ORDER BY i) AS ingredients FROM f GROUP BY source
""")
def _(d):
    dictionary = benchmark_terms(d).select("pattern", F.col("pattern").alias("node_id"), F.lit("en").alias("lang"))
    out = E.extract_ingredient_mentions(d.documents.withColumnRenamed("source", "barcode"), dictionary, order="doc_id")
    return out.select("barcode", F.array_join("ingredients", ",").alias("ingredients"))


@query("taxonomy_terminals", "SELECT lower(p_name) AS term, string_agg(DISTINCT 'en:n' || cast(p_partkey AS string), ',' ORDER BY 'en:n' || cast(p_partkey AS string)) AS ids FROM part WHERE p_partkey >= 1 GROUP BY 1")
def _(d):
    names = d.part.where("p_partkey >= 1").select(F.concat(F.lit("en:n"), F.col("p_partkey").cast("string")).alias("node_id"), F.lit("en").alias("lang"), F.upper("p_name").alias("name"))
    return E.taxonomy_terminals(names, "en").select("term", F.array_join("ids", ",").alias("ids"))


# The model learns from the documents whose id leaves a remainder; accuracy is measured on the others.
LANGUAGE_SCORES = """
g AS (
  SELECT doc_id, lang, unnest(CASE WHEN length(t) < 3 THEN [t] ELSE list_concat(regexp_extract_all(t, '(?s)...'), regexp_extract_all(substr(t, 2), '(?s)...'), regexp_extract_all(substr(t, 3), '(?s)...')) END) AS gram
  FROM (SELECT doc_id, lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text <> '')),
s AS (SELECT doc_id, lang, gram, count(*) AS n FROM g GROUP BY 1, 2, 3),
c AS (SELECT lang, gram, sum(n) AS n FROM s WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY 1, 2),
t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), v AS (SELECT count(DISTINCT gram) + 1 AS kinds FROM c),
m AS (SELECT t.lang, e.gram, round(1000000 * ln(cast(coalesce(c.n, 0) + 1 AS DOUBLE) / (t.total + v.kinds)))::BIGINT AS weight FROM t, v, (SELECT DISTINCT gram FROM c) e LEFT JOIN c ON c.lang = t.lang AND c.gram = e.gram),
u AS (SELECT t.lang, round(1000000 * ln(1e0 / (t.total + v.kinds)))::BIGINT AS weight FROM t, v),
r AS (SELECT s.doc_id, u.lang, sum(s.n * coalesce(m.weight, u.weight))::BIGINT AS score, sum(s.n)::BIGINT AS n_grams FROM s CROSS JOIN u LEFT JOIN m ON m.gram = s.gram AND m.lang = u.lang GROUP BY 1, 2)
"""


def learned_languages(d: Data):
    return language.language_model(d.documents.where("doc_id % 5 <> 0"))


@query("language_scores", f"WITH {LANGUAGE_SCORES} SELECT * FROM r")
def _(d):
    """Log-likelihoods of all documents in every language."""
    return language.language_scores(d.documents, learned_languages(d))


@query("detect_language_join", f"WITH {LANGUAGE_SCORES} SELECT doc_id, lang FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1")
def _(d):
    found = language.detect_languages(d.documents, learned_languages(d))
    return E.detect_language_join(d.documents.join(found, "doc_id"), F.col("languages")).select("doc_id", F.col("languages")[0]["lang"].alias("lang"))


@query("language_accuracy", "SELECT lang, count(*) AS n, true AS enough FROM documents WHERE doc_id % 5 = 0 AND lang IS NOT NULL AND text <> '' GROUP BY lang")
def _(d):
    """Whether nine tenths of the held-out documents of each language are told."""
    texts = d.documents.where("doc_id % 5 = 0")
    told = texts.where("lang is not null").join(language.detect_languages(texts, learned_languages(d)), "doc_id")
    right = (F.col("languages")[0]["lang"] == F.col("lang")).cast("int")
    return told.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.avg(right) >= 0.9).alias("enough"))


@query("vision_logos", "SELECT id, 'value-' || cast(l_suppkey % 20 AS string) AS value_tag, score AS confidence FROM logo WHERE l_suppkey % 20 < 10")
def _(d):
    rows = d.logo.select("id", F.array(F.struct(F.concat(F.lit("logo "), (F.col("l_suppkey") % 20).cast("string")).alias("description"), "score")).alias("logos"))
    mapping = d.region.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).distinct().select(F.concat(F.lit("logo "), F.col("k").cast("string")).alias("description"), F.concat(F.lit("Value "), F.col("k").cast("string")).alias("target"))
    return E.vision_logos(rows, mapping, "brand", ["id"]).select("id", "value_tag", "confidence")


@query("product_name_predictions", "SELECT doc_id, '200 g' AS value, false AS automatic_processing, 'product_name' AS source FROM documents WHERE doc_id % 3 = 0")
def _(d):
    named = d.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "Beurre poids net 200 g").otherwise("Beurre doux").alias("text"))
    out = E.product_name_predictions(E.extract_all(named, ["product_weight", "label"], ["doc_id"]))
    return out.select("doc_id", "value", "automatic_processing", F.get_json_object("data", "$.source").alias("source"))


def all_types_sql() -> str:
    """The types' own checks, side by side."""
    one = {
        "category": "value_tag", "packager_code": "value", "product_weight": "value", "image_flag": "kind || ':' || label", "expiration_date": "value",
        "brand": "value_tag", "store": "value_tag", "packaging": "value", "image_orientation": "cast(rotation AS string)",
    }
    counted = {"label": ("value_tag", "extract_label"), "nutrient": ("nutrients", "extract_nutrient_values"), "nutrient_mention": ("nutrient", "extract_nutrient_mentions"), "image_lang": ("lang", "extract_image_lang")}
    key = {"image_flag": "source_image", "image_lang": "source_image", "image_orientation": "source_image"}
    parts = [f"SELECT cast({key.get(t, 'doc_id')} AS string) AS source_image, '{t}' AS type, {v} AS value, 1 AS n FROM ({ORACLES['extract_' + t]}) AS {t}_rows" for t, v in one.items()]
    parts += [f"SELECT cast({key.get(t, 'doc_id')} AS string), '{t}', {v}, n FROM ({ORACLES[name]}) AS {t}_rows" for t, (v, name) in counted.items()]
    return f"SELECT source_image, type, value, cast(sum(n) AS BIGINT) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2, 3"


def type_arguments(d: Data) -> dict[str, dict]:
    taxonomy = literal_terms(d, [("carrefour", "Carrefour", "carrefour"), ("coca-cola-light", "Coca-Cola light", "coca cola light"), ("the", "The", "the"), ("12", "12", "12")])
    nodes = d.part.where("p_partkey % 3 <> 0").select(F.concat(F.lit("fr:bleu-de-"), F.col("p_partkey").cast("string")).alias("id"))
    return {
        "brand": {"curated": literal_terms(d, CURATED), "from_taxonomy": taxonomy, "blacklist": d.spark.createDataFrame([("the",)], "brand_tag string")},
        "category": {"nodes": nodes}, "store": {"stores": STORES}, "packaging": {"shapes": SHAPES, "materials": MATERIALS, "recyclings": RECYCLINGS},
        "image_flag": {"words": literal_terms(d, FLAG_WORDS)}, "image_lang": {"words": words(d)}, "image_orientation": {"words": words(d)},
    }


def shown(found):
    """(source_image, type, value, n): each type's predictions by what tells them apart."""
    field = lambda f: F.get_json_object("data", f"$.{f}")
    kind = F.col("type")
    hits = F.from_json(field("nutrients"), "map<string,array<struct<raw:string>>>")
    mentions = F.from_json(field("mentions"), "map<string,array<struct<raw:string>>>")
    langs = F.map_filter(F.from_json(field("count"), "map<string,long>"), lambda k, _: k != "words")
    entry = lambda value, n: F.struct(value.cast("string").alias("value"), n.cast("long").alias("n"))
    rows = (
        F.when(kind == "nutrient", F.array(entry(F.array_join(F.array_sort(F.map_keys(hits)), ","), F.size(F.flatten(F.map_values(hits))))))
        .when(kind == "nutrient_mention", F.transform(F.map_entries(mentions), lambda e: entry(e["key"], F.size(e["value"]))))
        .when(kind == "image_lang", F.transform(F.map_entries(langs), lambda e: entry(e["key"], e["value"])))
        .when(kind == "image_flag", F.array(entry(F.concat_ws(":", field("type"), field("label")), F.lit(1))))
        .when(kind == "image_orientation", F.array(entry(field("rotation"), F.lit(1))))
        .otherwise(F.array(entry(F.coalesce("value_tag", "value"), F.lit(1))))
    )
    # stores and weights are told apart by tag and value as their own checks do
    out = found.select("source_image", "type", F.explode(rows).alias("r"))
    return out.groupBy("source_image", "type", "r.value").agg(F.sum("r.n").alias("n"))


@query("extract_all", all_types_sql())
def _(d):
    """All default types over all texts in one reading."""
    k = F.col("doc_id")
    likely = F.when(k % 8 == 0, "VERY_LIKELY").otherwise("LIKELY")
    rows = d.ocr_text.select(
        k.cast("string").alias("source_image"), "text", F.struct(likely.alias("adult"), F.lit("UNKNOWN").alias("violence")).alias("safe_search"),
        F.array(F.struct(F.lit("Food").alias("description"), F.lit(0.9).alias("score")), F.struct(F.when(k % 2 == 0, "Face").otherwise("Dog").alias("description"), ((k % 10) / 10).alias("score"))).alias("labels"),
        F.array(F.struct(((k % 5) / 5).alias("detectionConfidence"))).alias("faces"),
    )
    return shown(E.extract_all(rows, keep=["source_image"], **type_arguments(d)))


@query("reextract_product", """
SELECT i.barcode, i.source_image, cast(i.id % 300 + 100 AS string) || ' g' AS value FROM image i JOIN product p ON p.code = i.barcode WHERE p.c_custkey % 4 = 0 AND i.id % 2 = 0
""")
def _(d):
    texts = d.image.select("barcode", "image_id", "source_image", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Poids net: "), (F.col("id") % 300 + 100).cast("string"), F.lit(" g"))).otherwise("rien").alias("text"))
    return flows.reextract_product(d.product.where("c_custkey % 4 = 0"), texts, ["product_weight", "expiration_date"]).select("barcode", "source_image", "value")
