"""What Python tasks hold at once: it does not grow with the texts or vectors of a batch."""

import threading
import time

import psutil
import pytest
from pyspark.sql import functions as F

from larder.functions.text import strip_accents
from larder.operators import text_match as M
from larder.operators import vectors as V


def python_growth(action):
    """MB by which the largest Python worker of this session grows while ``action`` runs."""
    workers = lambda: {p.pid: p.memory_info().rss / 1e6 for p in psutil.Process().children(recursive=True) if "python" in p.name()}
    before, grown, over = workers(), [0.0], threading.Event()
    usual = max(before.values(), default=100.0)

    def watch():
        while not over.is_set():
            try:
                grown.append(max((mb - before.get(pid, usual) for pid, mb in workers().items()), default=0.0))
            except psutil.Error:
                pass
            time.sleep(0.05)

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        action()
    finally:
        over.set()
        thread.join()
    return max(grown)


@pytest.fixture
def long_texts(spark):
    """2 000 texts of 1 500 words in one batch."""
    word = F.transform(F.sequence(F.lit(0), F.lit(1499)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i * 13) % 997).cast("string")))
    return spark.range(2000).select(F.col("id").alias("doc_id"), F.array_join(word, " ").alias("text")).coalesce(1)


def test_fuzzy_matching_holds_few_words_at_once(spark, long_texts):
    terms = spark.createDataFrame([("k", "x", "w12345 w54321")], "key string, name string, pattern string")
    assert python_growth(lambda: M.dict_match_fuzzy(long_texts, terms, 1).collect()) < 250


@pytest.mark.parametrize("most_first_words", [500_000, 0])
def test_joined_matching_holds_few_words_at_once(spark, long_texts, most_first_words):
    terms = spark.createDataFrame([(f"k{k}", "x", f"w{k} nothing") for k in range(997)], "key string, name string, pattern string")
    assert python_growth(lambda: M.dict_match_join(long_texts, terms, most_first_words=most_first_words).collect()) < 250


def test_exact_neighbours_hold_few_products_at_once(spark):
    rows = spark.range(12_000).select(F.col("id").alias("logo_id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * (i + 1))).alias("embedding")).coalesce(1)
    assert python_growth(lambda: V.knn_join(rows, rows, 5, cells=1).collect()) < 450


def test_accents_are_stripped_of_few_texts_at_once(spark, long_texts):
    large = long_texts.select(F.repeat("text", 8).alias("text")).coalesce(1)
    grown = python_growth(lambda: large.select(F.sum(F.length(strip_accents("text")))).collect())
    assert grown < 400, grown
