"""Queries that SQL can express, against their check SQL."""

import sys
from pathlib import Path

import pytest
from llm_fixtures import rows_of

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

from check import compare, connect  # noqa: E402

from larder.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables missing")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = connect(FOLDER).execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert compare(df.columns, rows_of(df), columns, cursor.fetchall()) == ""


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
