"""Registered queries against their check SQL on the small tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check import compare, connect  # noqa: E402

from larder.plans.registry import load_all  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = load_all()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables missing")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in CHECKS:
        cursor = db.execute(CHECKS[name])
        columns = [c[0] for c in cursor.description]
        assert compare(df.columns, rows, columns, cursor.fetchall()) == ""
