"""Queries against their check SQL on tables that differ from the small ones."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check import compare, connect  # noqa: E402

from larder.plans.registry import TABLES, load_all  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = load_all()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables missing")


def checked(spark, folder, name, **changed):
    """Differences from the check SQL where the ``changed`` tables replace those of the small folder."""
    for t in TABLES:
        if t in changed:
            changed[t].coalesce(1).write.parquet(f"{folder}/whole/{t}")
            (folder / f"{t}.parquet").symlink_to(next((folder / "whole" / t).glob("part-*.parquet")))
        else:
            (folder / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
    df = QUERIES[name](spark, str(folder))
    cursor = connect(str(folder)).execute(CHECKS[name])
    return compare(df.columns, [tuple(r) for r in df.collect()], [c[0] for c in cursor.description], cursor.fetchall())


def test_packaging_with_more_than_300_000_nodes(spark, tmp_path):
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    more = part.withColumn("p_partkey", F.col("p_partkey") + 299_990).where("p_partkey < 300020")
    assert checked(spark, tmp_path, "cand_packaging", part=part.union(more)) == ""


def test_refreshed_lists_of_copied_vectors(spark, tmp_path):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").limit(30)
    copies = vectors.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("vec_id", F.col("vec_id") * 20 + (F.col("copy") * 7) % 20).drop("copy")
    assert checked(spark, tmp_path, "knn_index_refresh", embeddings=copies) == ""
