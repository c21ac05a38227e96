"""Language of texts by a character n-gram model, trained and applied in joins.

A text's score in a language is the log-likelihood of its n-grams there, with one added to
every count.  Scores are whole millionths, so sums do not depend on their order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from larder.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_ROWS = 20_000  # rows that a task builds at once, and those of one more text


def grams(text: Column, n: int = 3) -> Column:
    """All n-grams of code points, A-Z in lower case; of a shorter text the text itself.

    The text is cut into pieces of n from each of its first n code points on.
    """
    low = F.translate(text, UPPER, LOWER)
    pieces = [F.regexp_extract_all(F.substring(low, F.lit(k + 1), F.length(low)), F.lit(f"(?s).{{{n}}}"), F.lit(0)) for k in range(n)]
    return F.when(F.length(low) >= n, F.concat(*pieces)).when(F.length(low) > 0, F.array(low)).otherwise(F.array().cast("array<string>"))


def counted_grams(low: str, n: int) -> tuple[list[str], list[int]]:
    """The different n-grams of a lower-cased text and their numbers; up to three code points are sorted as one number."""
    if len(low) < n or n > 3:
        own = Counter(low[k : k + n] for k in range(max(1, len(low) - n + 1)))
        return list(own), list(own.values())
    codes = np.frombuffer(low.encode("utf-32-le"), "<u4").astype(np.int64)
    keys = np.zeros(len(codes) - n + 1, np.int64)
    for k in range(n):
        keys = keys << 21 | codes[k : k + len(keys)]
    keys, counts = np.unique(keys, return_counts=True)
    parts = np.stack([keys >> 21 * (n - 1 - k) & 0x1FFFFF for k in range(n)], 1)
    together = parts.astype("<u4").tobytes().decode("utf-32-le")
    return [together[k : k + n] for k in range(0, len(together), n)], counts.tolist()


def gram_counts(df: DataFrame, keep: Sequence[str], text_col: str = "text", n: int = 3) -> DataFrame:
    """(keep, gram, n): the different ``grams`` of each text with their numbers.

    They are counted before rows are made of them, text by text in the tasks.
    """
    base = df.select(*keep, F.translate(text_col, UPPER, LOWER).alias("__low")).where("__low <> ''")
    schema = StructType([*base.drop("__low").schema.fields, StructField("gram", StringType()), StructField("n", LongType())])
    n_keep = len(keep)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:

            def piece(at: list[int], found: list[str], counts: list[int], b: pa.RecordBatch = b) -> pa.RecordBatch:
                rows = pa.array(at, pa.int32())
                return pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(n_keep)], pa.array(found, pa.string()), pa.array(counts, pa.int64())], schema.fieldNames())

            at, found, counts = [], [], []
            for i, text in enumerate(b.column(n_keep)):
                own, times = counted_grams(text.as_py(), n)
                at += [i] * len(own)
                found += own
                counts += times
                if len(at) >= PIECE_ROWS:
                    yield piece(at, found, counts)
                    at, found, counts = [], [], []
            if at:
                yield piece(at, found, counts)

    return base.mapInArrow(build, schema)


def language_model(texts: DataFrame, lang_col: str = "lang", text_col: str = "text", n: int = 3) -> DataFrame:
    """(gram, weights): for each n-gram its ``array<struct<lang,weight>>``, in millionths of log-likelihood.

    The null gram stands for those never seen.  Counts cover every text whose language is
    known; a language without text is no language.  What comes to the driver is a total per
    language.
    """
    known = texts.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted, _ = cut_lineage(gram_counts(known, ["lang"], n=n).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total")).orderBy("lang").collect()
    by_gram, seen = cut_lineage(counted.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))  # one entry a language
    none = texts.sparkSession.range(1).select(F.lit(None).cast("string").alias("gram"), F.create_map().cast("map<string,bigint>").alias("by"))  # of known size, so the model's is
    weight = lambda lang, total: F.round(1_000_000 * F.log((F.coalesce(F.try_element_at("by", F.lit(lang)), F.lit(0)) + 1) / F.lit(total + seen + 1))).cast("long")
    weights = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), weight(r["lang"], r["total"]).alias("weight")) for r in totals]).cast("array<struct<lang:string,weight:bigint>>")
    return by_gram.union(none).select("gram", weights.alias("weights"))


def language_scores(texts: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, lang, score, n_grams): every text's log-likelihood in each language of the model.

    Texts are n-gram counts before they meet the model; null and empty texts have no rows.
    """
    counts = gram_counts(texts, [id_col], text_col, n)
    never = model.where("gram is null").first()  # a weight per language
    unseen = F.array(*[F.struct(F.lit(w["lang"]).alias("lang"), F.lit(w["weight"]).cast("long").alias("weight")) for w in (never["weights"] if never else [])])
    known = counts.join(model.where("gram is not null"), "gram", "left")
    weighed = known.select(id_col, "n", F.explode(F.coalesce("weights", unseen.cast("array<struct<lang:string,weight:bigint>>"))).alias("w"))
    return weighed.groupBy(id_col, F.col("w.lang").alias("lang")).agg(F.sum(F.col("n") * F.col("w.weight")).alias("score"), F.sum("n").alias("n_grams"))


def detect_languages(texts: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, languages): ``array<struct<lang,confidence>>``, the likeliest first.

    Confidences are the languages' shares of the likelihood, all equally likely before the
    text is read; ties go by name.  Texts without n-grams have no languages.
    """
    scores = language_scores(texts, model, id_col, text_col, n)
    best = F.max("score").over(Window.partitionBy(id_col))  # a row a language
    shares = scores.withColumn("share", F.exp((F.col("score") - best) / 1_000_000))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("worse"), "lang", "share")))
    lists = shares.groupBy(id_col).agg(ranked.alias("r"), F.sum("share").alias("whole"))
    return lists.select(id_col, F.transform("r", lambda x: F.struct(x["lang"].alias("lang"), (x["share"] / F.col("whole")).alias("confidence"))).alias("languages"))
