"""One registered query per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.ann import approximate_topk
from larder.llm.chat import format_chats
from larder.llm.html_text import extract_text
from larder.llm.lexical import LOWER, UPPER, WORD, ranked_search
from larder.llm.licenses import scan_licenses
from larder.llm.mixing import mix
from larder.llm.packing import pack
from larder.llm.polytope import near_duplicates
from larder.llm.prefix_trie import numbered_turns, prefix_trie, share_beginnings
from larder.llm.simhash import simhash_groups
from larder.llm.toxicity import toxicity, train
from larder.llm.topk import exact_topk, usable
from larder.llm.urls import GRAMS, HEX_DIGITS, LABELLED, filter_urls, labelled_urls
from larder.llm.urls import train as train_urls

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: All pairs, and what can be reached over links.
NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1), c AS (SELECT a AS vec_id, min(b) AS least FROM r GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

#: Beginnings as whole strings of turn digests; subtrees by comparing beginnings.
TRIE_SQL = """
WITH RECURSIVE ids AS (
  SELECT conv_id, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, byte: list_reduce(list_concat([xor(c, byte)], list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda y, i: xor(y >> 1, CASE WHEN y & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END))) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), c AS (SELECT conv_id, conv_id - conv_id % 100 AS head, xor(crc, 4294967295) % 6 AS h FROM ids),
o AS (
  SELECT conv_id, length(t) AS size, md5(r) || md5(t) AS digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, size, digest FROM c JOIN o ON o.conv_id = c.head AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, size, digest FROM c JOIN o USING (conv_id) WHERE pos > h
), d AS (SELECT conv_id, size, digest, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM rebuilt),
p AS (
  SELECT conv_id, depth, size, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (SELECT depth, path, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, left(path, 64 * (depth - 1)) AS path, count(*) AS kids FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k USING (depth, path)),
e AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path),
s AS (SELECT u.path, count_if(v.kids = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.size) AS BIGINT) AS saved FROM f AS u JOIN f AS v ON starts_with(v.path, u.path) GROUP BY u.path)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.kids AS n_children, n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN e USING (path) LEFT JOIN n AS up ON up.depth = f.depth - 1 AND up.path = left(f.path, 64 * (f.depth - 1))
"""

#: Every document that holds a term of an item is scored.
RANKED_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS t FROM documents),
s AS (SELECT count_if(len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS term FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT r, term, any_value(doc_id) AS doc_id, any_value(n) AS n, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
i AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))) AS impact FROM p JOIN w USING (term), s),
f AS (SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, r, doc_id HAVING sum(impact) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""

#: The schedule is simulated slot by slot; documents are counted with plain running sums.
MIXING_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(greatest(coalesce(length(text), 0), 1) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS digest FROM documents
), w AS (SELECT source, CAST(greatest(floor(sqrt(CAST(sum(size) AS DOUBLE))), 1) AS BIGINT) AS weight, CAST((sum(size) + 65535) // 65536 AS BIGINT) AS blocks FROM d GROUP BY source),
n AS (SELECT *, (blocks * total + weight - 1) // weight AS ends FROM (SELECT *, CAST(sum(weight) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY source) AS i FROM w)),
c AS (SELECT list(weight ORDER BY i) AS weights, any_value(total) AS total, max(total // weight) + 2 AS longest, coalesce(list_sort(list(ends), 'DESC')[2], 0) AS alone FROM n),
sim AS (
  SELECT CAST(-1 AS BIGINT) AS turn, list_transform(weights, lambda x: CAST(0 AS BIGINT)) AS sent, CAST(0 AS BIGINT) AS pick, CAST(0 AS BIGINT) AS block FROM c
  UNION ALL
  SELECT turn + 1, list_transform(sent, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, sent[p] FROM (
    SELECT turn, sent, list_sort(list_filter(list_transform(sent, lambda x, i: CASE WHEN (x * total) // weights[i] <= turn + 1
      THEN [((x + 1) * total + weights[i] - 1) // weights[i], i] END), lambda y: y IS NOT NULL))[1][2] AS p
    FROM sim, c WHERE turn + 1 < alone + longest)
), q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d),
b AS (SELECT q.doc_id, source, i, before // 65536 AS block, before % 65536 AS "offset", (before // 65536 * total) // weight AS release, ((before // 65536 + 1) * total + weight - 1) // weight AS deadline FROM q JOIN n USING (source))
SELECT doc_id, source, b.block, release, deadline, CASE WHEN release >= alone THEN deadline - 1 ELSE turn END AS slot, "offset"
FROM b CROSS JOIN c LEFT JOIN sim ON sim.turn >= 0 AND sim.pick = b.i AND sim.block = b.block
"""

URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _url_parts_sql(table: str, columns: str) -> str:
    """Host and path, and the distinct hashed n-grams of both."""
    grams = ", ".join(
        f"list_transform(range(1, greatest(length({t}) - {n} + 2, 1)), lambda i: CAST('0x' || substr(md5('{m}' || substr({t}, i, {n})), 1, {HEX_DIGITS}) AS INTEGER))"
        for m, t in (("h", "('^' || host || '$')"), ("p", "(path || '$')")) for n in GRAMS
    )
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    return f"""SELECT *, list_sort(list_distinct(flatten([{grams}]))) AS b FROM (
      SELECT {columns}, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
      FROM (SELECT *, {rest} AS rest FROM {table}))"""


def _url_sql(steps: int = 150, rate: float = 2.0, decay: float = 0.001) -> str:
    """Training, rules and scores in SQL: the descent is a recursive table expression."""
    labelled = ", ".join(f"('{url}', {label})" for label, urls in LABELLED for url in urls.split())
    rules = ", ".join(f"('{verdict}', '{host}', '{path}', {k})" for k, (verdict, host, path) in enumerate(URL_RULES))
    return f"""
WITH RECURSIVE labelled(url, y) AS (VALUES {labelled}), known AS ({_url_parts_sql('labelled', 'url, y')}),
rules(verdict, host, path, k) AS (VALUES {rules}),
used AS (SELECT bucket, row_number() OVER (ORDER BY bucket) AS pos FROM (SELECT DISTINCT unnest(b) AS bucket FROM known)),
numbered AS (SELECT *, row_number() OVER (ORDER BY url, y) AS r FROM known),
pairs AS (SELECT r, y, pos FROM (SELECT r, y, unnest(b) AS bucket FROM numbered) JOIN used USING (bucket)),
t AS (SELECT list({{'y': y, 'k': k}} ORDER BY r) AS t FROM (SELECT r, y, list(pos ORDER BY pos) AS k FROM pairs GROUP BY r, y)),
m AS (SELECT list(m ORDER BY pos) AS members FROM (SELECT pos, list(r ORDER BY r) AS m FROM pairs GROUP BY pos)),
fit AS (
  SELECT 0 AS step, list_transform(members, lambda x: CAST(0 AS DOUBLE)) AS w, CAST(0 AS DOUBLE) AS b FROM m
  UNION ALL
  SELECT step + 1, list_transform(members, lambda x, k: w[k] - {rate}e0 * (list_sum(list_transform(x, lambda i: e[i])) + {decay}e0 * w[k])), b - {rate}e0 * list_sum(e) FROM (
    SELECT step, w, b, list_transform(t, lambda r: (1 / (1 + exp(-(b + list_sum(list_transform(r.k, lambda j: w[j]))))) - r.y) / len(t)) AS e FROM fit, t WHERE step < {steps}), m
), model AS (SELECT w, b AS bias FROM fit WHERE step = {steps}),
weights AS (SELECT bucket, w[pos] AS weight FROM used, model),
p AS ({_url_parts_sql('pages', 'page_id, url')}),
s AS (SELECT page_id, 1 / (1 + exp(-(any_value(bias) + coalesce(sum(weight), 0)))) AS score FROM (SELECT page_id, unnest(b) AS bucket FROM p) LEFT JOIN weights USING (bucket), model GROUP BY page_id),
fits AS (SELECT page_id, rules.host || rules.path AS rule, verdict FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rules.host || rules.path) DESC, k) = 1)
SELECT p.page_id, p.host, p.path, rule, coalesce(verdict, CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(score, 4) AS score
FROM p LEFT JOIN fits USING (page_id) LEFT JOIN s USING (page_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, check: str | None = None) -> Callable:
    def add(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = function
        if check:
            ORACLES[name] = check
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four or fewer differing bits."""
    return simhash_groups(_table(spark, sf_dir, "documents"), words=4, seed=42, radius=4)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 4096 tokens, sources in the corpus's own proportions."""
    packed = pack(_table(spark, sf_dir, "documents"), tokenizer_file(), end=2, window=4096, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


@_query("op10_exact_topk", TOPK_SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest integer products of every hundredth vector against all rows."""
    rows = _table(spark, sf_dir, "embeddings")
    whole = F.when(usable(F.col("embedding")), F.transform("embedding", lambda x: F.floor(1024 * x.cast("double"))))
    found = exact_topk(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 100 == 0, k=10, vector_col="vector", kind="long")
    return found.withColumn("rank", F.col("rank").cast("int"))


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; rows whose crc32(doc_id) mod 5 is 0 are held out of learning."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = toxicity(docs, train(docs, labels.where(~held_out)), keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


@_query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(_table(spark, sf_dir, "pages"))


@_query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and signatures of every document."""
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    named = lambda c: F.transform(c, lambda x: x["label"])
    words = F.transform("base", lambda x: x["word"])
    doubt = F.aggregate("detections", F.lit(1.0), lambda left, x: left * (1 - x["confidence"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(words).alias("first_word"), F.array_max(words).alias("last_word"),
        joined(named("base")).alias("base_labels"), joined(F.concat(named("base"), named("detections"))).alias("labels"), F.round(1 - doubt, 6).alias("score"),
    )


@_query("op2_hilbert_ann")
def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector by inner product."""
    found = approximate_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.withColumn("rank", F.col("rank").cast("int"))


@_query("op4_mixing", MIXING_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' slots in a mixture of sources weighted by the root of their size."""
    return mix(_table(spark, sf_dir, "documents"), block_chars=65_536)


@_query("op5_url_filter", _url_sql())
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the n-gram model, for every page's url."""
    judged = filter_urls(_table(spark, sf_dir, "pages"), URL_RULES, train_urls(labelled_urls(spark)))
    return judged.withColumn("score", F.round("score", 4))


@_query("op8_chat_format")
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical turns of every conversation."""
    return format_chats(_table(spark, sf_dir, "conversations"))


@_query("op13_polytope", NEAR_VECTORS_SQL)
def op13_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9 or more."""
    return near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


@_query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt so that those of a hundred share beginnings."""
    return prefix_trie(*share_beginnings(numbered_turns(_table(spark, sf_dir, "conversations")), group=100, most=6))


@_query("op11_ranked_search", RANKED_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)
