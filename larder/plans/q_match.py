"""Queries: alignment of corrections and other matching over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import alignment, fingerprints
from larder.plans.registry import Data, query

# Every eleventh word of an original is spoilt.  Of four documents one has its odd spoilt words
# mended, the others keep them and have further words replaced, dropped or inserted.
SPOILT, FURTHER = "i % 11 = 3", "i % 13 = 7 AND i % 11 <> 3"


@query("alignment_metrics", f"""
WITH t AS (SELECT doc_id % 4 AS kind, lang, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]+')), 0) AS n FROM documents),
w AS (SELECT kind, lang, {SPOILT} AS spoilt, {FURTHER} AS further, i % 2 = 1 AS odd FROM (SELECT kind, lang, unnest(range(n)) AS i FROM t)),
c AS (
  SELECT lang, count_if(kind = 0 AND spoilt AND odd) AS tp, count_if(kind <> 0 AND further) AS fp, count_if(spoilt AND NOT (kind = 0 AND odd)) AS fn,
    count(*) - count_if(spoilt) - count_if(kind IN (1, 2) AND further) AS tn FROM w GROUP BY lang
), r AS (SELECT lang, count(*) AS n_rows FROM t GROUP BY lang)
SELECT r.lang, n_rows, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, coalesce(tp, 0) AS exact,
  CASE WHEN tp + fp > 0 THEN cast(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN cast(tp AS DOUBLE) / (tp + fn) END AS recall,
  CASE WHEN tp + fp + fn > 0 THEN cast(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1
FROM r LEFT JOIN c ON r.lang IS NOT DISTINCT FROM c.lang
""")
def _(d: Data):
    """Corrections of spoilt copies of all documents, per language."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    spoilt, further = lambda i: i % 11 == 3, lambda i: (i % 13 == 7) & (i % 11 != 3)
    junk = lambda i, mark: F.concat(F.lit(mark), i.cast("string"))
    original = F.transform("words", lambda w, i: F.when(spoilt(i), junk(i, "zq")).otherwise(w))
    kind = F.col("doc_id") % 4
    mended = F.transform("original", lambda w, i: F.when(spoilt(i) & (i % 2 == 1), F.col("words")[i]).otherwise(w))
    changed = F.transform("original", lambda w, i: F.when(further(i), junk(i, "qz")).otherwise(w))
    dropped = F.filter("original", lambda w, i: ~further(i))
    grown = F.flatten(F.transform("original", lambda w, i: F.when(further(i), F.array(junk(i, "qz"), w)).otherwise(F.array(w))))
    made = F.when(kind == 0, mended).when(kind == 1, changed).when(kind == 2, dropped).otherwise(grown)
    rows = d.documents.select("doc_id", "lang", words.alias("words")).withColumn("original", original).withColumn("made", made)
    joined = lambda c: F.array_join(c, " ")
    triples = rows.select("lang", joined("original").alias("original"), joined("words").alias("reference"), joined("made").alias("prediction"))
    return alignment.alignment_metrics(triples, ["lang"])


@query("image_fingerprint_duplicates", """
WITH RECURSIVE f AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN 77 ELSE xor((id % 40) * 2654435761 * 1000003, CASE WHEN id % 3 = 1 THEN CAST(1 AS BIGINT) << CAST(id % 61 AS INTEGER) ELSE 0 END) END AS h FROM image WHERE id % 13 <> 12
), d AS (SELECT h, count(*) AS n, min(id) AS least FROM f GROUP BY h), l AS (SELECT a.h AS a, b.h AS b, b.n FROM d AS a JOIN d AS b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 4),
r AS (SELECT h AS a, h AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT r.a AS h, min(d.least) AS class_id FROM r JOIN d ON d.h = r.b GROUP BY r.a),
k AS (SELECT a AS h, sum(n) AS n FROM l GROUP BY a)
SELECT id, class_id, CAST(d.n - 1 + coalesce(k.n, 0) AS BIGINT) AS n_links FROM f JOIN d USING (h) JOIN c USING (h) LEFT JOIN k USING (h)
""")
def _(d: Data):
    """Classes of images whose stored fingerprints differ in four bits at most; a fifth of them are equal."""
    k = F.col("id")
    flip = F.when(k % 3 == 1, F.expr("shiftleft(1L, cast(id % 61 as int))")).otherwise(F.lit(0).cast("long"))
    stored = F.when(k % 5 == 0, F.lit(77).cast("long")).otherwise(((k % 40) * 2654435761 * 1000003).bitwiseXOR(flip))
    images = d.image.select("id", F.when(k % 13 != 12, stored).alias("fingerprint"))
    return fingerprints.fingerprint_duplicates(images, distance=4)
