"""The character n-gram model against plain counting."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.operators import language as L

TEXTS = [("en", "The cat"), ("en", "the"), ("fr", "Le chat été"), ("fr", None), (None, "nobody knows"), ("de", ""), ("fr", "a"), ("en", "😀the 😀")]


def plain_grams(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [low[i : i + 3] for i in range(len(low) - 2)] if len(low) >= 3 else [low] * bool(low)


def test_scores_are_plain_log_likelihoods(spark):
    rows = [(k, lang, t) for k, (lang, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counts = {}
    for _, lang, t in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    counts = {lang: c for lang, c in counts.items() if c}
    kinds = len(set().union(*counts.values())) + 1
    model = L.language_model(df)
    asked = spark.createDataFrame([(1, "the chat"), (2, "zzzz"), (3, None), (4, ""), (5, "a"), (6, "x" * 20_000)], "doc_id long, text string")
    got = {(r.doc_id, r.lang): (r.score, r.n_grams) for r in L.language_scores(asked, model).collect()}
    want = {}
    for i, t in [(1, "the chat"), (2, "zzzz"), (5, "a"), (6, "x" * 20_000)]:
        for lang, c in counts.items():
            found = plain_grams(t)
            want[i, lang] = (sum(round(1e6 * math.log((c[g] + 1) / (c.total() + kinds))) for g in found), len(found))
    assert got == want
    told = {r.doc_id: r.languages for r in L.detect_languages(asked, model).collect()}
    assert set(told) == {1, 2, 5, 6} and all(abs(sum(x.confidence for x in v) - 1) < 1e-9 for v in told.values())
    assert told[5][0].lang == "fr" and [x.lang for x in told[1]] == sorted(counts, key=lambda lang: (-want[1, lang][0], lang))


def test_an_empty_model_tells_nothing(spark):
    df = spark.createDataFrame([(1, None, "text")], "doc_id long, lang string, text string")
    assert L.detect_languages(df, L.language_model(df)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_counted_grams_are_the_grams(spark, n):
    texts = ["", None, "a", "ab", "Abc abc\nÉé", "日本😀 x😀y" * 3, "x" * 50, "a\0\0b\0", "\U0010ffff" * 4]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = df.select("doc_id", F.explode(L.grams(F.col("text"), n)).alias("gram")).groupBy("doc_id", "gram").count()
    counted = L.gram_counts(df, ["doc_id"], n=n)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, wanted.collect()))


def test_scores_make_no_row_per_place_of_a_text(spark):
    texts = spark.createDataFrame([(1, "en", "the cat sat"), (2, "fr", "le chat est assis")], "doc_id long, lang string, text string")
    scores = L.language_scores(texts, L.language_model(texts))
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" in plan
