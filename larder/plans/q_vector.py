"""Queries: nearest neighbours, votes and logo predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import cut_lineage
from larder.operators import vectors as V
from larder.operators.vector_index import VectorIndex, refresh_lists
from larder.plans.q_core import NEIGHBORS, neighbors, scratch
from larder.plans.registry import Data, query


@query("vec_normalize", """
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS squared, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS head FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
""")
def _(d):
    unit = V.vec_normalize(d.embeddings.select("vec_id", "embedding", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("squared")))
    return unit.select("vec_id", F.round("squared", 6).alias("squared"), F.round(F.col("embedding")[0], 6).alias("head"))


def vectors(d: Data):
    return d.embeddings.select(F.col("vec_id").alias("logo_id"), "embedding", F.when(F.col("vec_id") % 5 == 0, "obf").otherwise("off").alias("server_type"))


KNN = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE WHEN vec_id % 5 = 0 THEN 'obf' ELSE 'off' END AS s FROM embeddings),
k AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, (1 - list_cosine_similarity(a.v, b.v)) / 2 AS distance FROM e a JOIN e b ON a.s = b.s AND a.vec_id <> b.vec_id),
top AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 10)
"""


@query("knn_join", f"WITH {KNN} SELECT query_id, neighbor_id, round(distance, 6) AS distance FROM top")
def _(d):
    out = V.knn_join(vectors(d), vectors(d), 10, server_col="server_type")
    return out.select("query_id", "neighbor_id", F.round("distance", 6).alias("distance"))


def probed(d: Data):
    """The ten nearest found by the stored index, with the settings it measured for itself."""
    index = VectorIndex.build(vectors(d), scratch(d, "vectors"), server_col="server_type")
    return index.search(vectors(d), index.calibrate(10), 10, server_col="server_type")


@query("knn_join_probes")
def _(d):
    """Approximate form; ``knn_recall`` measures it."""
    return probed(d)


@query("knn_recall", f"WITH {KNN} SELECT s AS server_type, count(*) AS wanted, true AS enough FROM top JOIN e ON e.vec_id = query_id GROUP BY s")
def _(d):
    """Whether the approximate form finds nine tenths of the exact ten neighbours, per project."""
    exact = V.knn_join(vectors(d), vectors(d), 10, server_col="server_type").select("query_id", "neighbor_id")
    found = probed(d).select("query_id", "neighbor_id", F.lit(1).alias("hit"))
    rows = exact.join(found, ["query_id", "neighbor_id"], "left").join(vectors(d).select(F.col("logo_id").alias("query_id"), "server_type"), "query_id")
    return rows.groupBy("server_type").agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("knn_index_refresh", """
WITH now AS (
  SELECT a.vec_id, CASE WHEN a.vec_id % 7 = 3 AND b.vec_id IS NOT NULL THEN b.embedding ELSE a.embedding END::DOUBLE[] AS v, CASE WHEN a.vec_id % 5 = 0 THEN 'obf' ELSE 'off' END AS s
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 11 <> 5
), k AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, (1 - list_cosine_similarity(a.v, b.v)) / 2 AS distance FROM now a JOIN now b ON a.s = b.s AND a.vec_id <> b.vec_id)
SELECT query_id, neighbor_id, round(distance, 6) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbor_id) <= 10
""")
def _(d):
    """Lists of an index after inserted, changed and deleted vectors, brought up to date from those alone."""
    v, k = vectors(d), F.col("logo_id")
    index = VectorIndex.build(v.where("logo_id % 3 <> 1"), scratch(d, "kept_vectors"), server_col="server_type")
    before, _ = cut_lineage(index.exact(index.rows(), 10))
    index.upsert(v.where("logo_id % 3 = 1"), server_col="server_type")
    after = v.select((k - 1).alias("logo_id"), F.col("embedding").alias("next"))
    index.upsert(v.where("logo_id % 7 = 3").join(after, "logo_id").select("logo_id", F.col("next").alias("embedding"), "server_type"), server_col="server_type")
    index.delete(v.where("logo_id % 11 = 5"))
    lists = refresh_lists(index, before, 1, 10)
    return lists.select("query_id", "neighbor_id", F.round("distance", 6).alias("distance"))


@query("knn_refresh", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, (1 - list_cosine_similarity(a.v, b.v)) / 2 AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 3 = 0 AND a.vec_id % 4 <> 1)
SELECT query_id, neighbor_id FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) <= 4
""")
def _(d):
    now = F.lit("2024-01-20").cast("timestamp")
    logos = d.embeddings.select(
        F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 3 != 0, now).alias("completed_at"),
        F.when(F.col("vec_id") % 4 == 0, None).when(F.col("vec_id") % 4 == 1, F.lit("2024-01-19").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp")).alias("neighbors_updated_at"),
    )
    out = V.knn_refresh(logos, vectors(d).drop("server_type"), 4, 7, now)
    return out.select("query_id", "neighbor_id")


VOTES = f"""
{NEIGHBORS}, z AS (SELECT *, max(CASE WHEN distance = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY logo_id) AS has_zero FROM lab),
wt AS (SELECT logo_id, label_type, label_value, CASE WHEN has_zero = 1 THEN CASE WHEN distance = 0 THEN 1e0 ELSE 0e0 END ELSE 1e0 / distance END AS w FROM z),
pr AS (SELECT logo_id, label_type, label_value, sum(w) / sum(sum(w)) OVER (PARTITION BY logo_id) AS proba FROM wt GROUP BY logo_id, label_type, label_value)
"""


@query("knn_vote", f"WITH {VOTES} SELECT logo_id, label_type, label_value, round(proba, 6) AS proba FROM pr")
def _(d):
    return V.knn_vote(neighbors(d), d.logo).withColumn("proba", F.round("proba", 6))


THRESHOLDS = "SELECT 'brand' AS type, 'en:value-' || cast(s_suppkey % 20 AS string) AS value, 0.1e0 + (s_suppkey % 20) / 40e0 AS threshold FROM supplier GROUP BY s_suppkey % 20"


@query("knn_classify", f"""
WITH {VOTES}, b AS (SELECT * FROM pr WHERE label_type <> 'UNKNOWN' QUALIFY row_number() OVER (PARTITION BY logo_id ORDER BY round(proba, 9) DESC, label_type, label_value NULLS FIRST) = 1), th AS ({THRESHOLDS})
SELECT b.logo_id, b.label_type, b.label_value, round(proba, 6) AS proba FROM b LEFT JOIN th ON th.type IS NOT DISTINCT FROM b.label_type AND th.value IS NOT DISTINCT FROM b.label_value WHERE round(proba, 9) >= coalesce(th.threshold, 0.2)
""")
def _(d):
    thresholds = d.supplier.groupBy((F.col("s_suppkey") % 20).alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("brand").alias("type"), F.concat(F.lit("en:value-"), F.col("k").cast("string")).alias("value"), (F.lit(0.1) + F.col("k") / 40).alias("threshold"))
    # nine digits, so that sums in another order keep ties ties
    votes = V.knn_vote(neighbors(d), d.logo).withColumn("proba", F.round("proba", 9))
    return V.knn_classify(votes, thresholds).select("logo_id", "label_type", "label_value", F.round("proba", 6).alias("proba"))


@query("annotated_logo_predictions", """
SELECT id, annotation_type AS type, CASE annotation_type WHEN 'brand' THEN replace(taxonomy_value, ' ', '-') ELSE taxonomy_value END AS value_tag, CASE WHEN annotation_type = 'brand' THEN taxonomy_value END AS value, 1e0 AS confidence
FROM logo WHERE annotation_type IN ('brand', 'label') AND taxonomy_value IS NOT NULL
""")
def _(d):
    logos = d.logo.withColumns({"bounding_box": F.array(F.lit(0.0)), "model_version": F.lit("v1")})
    out = V.annotated_logo_predictions(logos)
    return out.select(F.get_json_object("data", "$.logo_id").cast("long").alias("id"), "type", "value_tag", "value", "confidence")


@query("image_fingerprint_fill", "SELECT id, CASE WHEN id % 3 = 0 THEN 7 ELSE id * 5 END AS fingerprint FROM image")
def _(d):
    images = d.image.withColumn("fingerprint", F.when(F.col("id") % 3 == 0, F.lit(7)).cast("long"))
    bits = F.transform(F.split(F.lpad(F.bin(F.col("id") * 5), 64, "0"), ""), lambda c: c == "1")
    return V.image_fingerprint_fill(images, d.image.select("id", F.slice(bits, 1, 64).alias("bits"))).select("id", "fingerprint")


@query("vector_upsert", """
SELECT vec_id AS logo_id, CASE WHEN vec_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3) THEN 'not_found' WHEN vec_id % 2 = 0 THEN 'update' ELSE 'insert' END AS action FROM embeddings
""")
def _(d):
    stored = vectors(d).where("logo_id % 2 = 0")
    return V.vector_upsert(vectors(d), d.orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("id")), stored).select("logo_id", "action")
