"""Query registry and the role views over the test tables.

A role view gives a test table the shape of a catalogue table (product, insight, image,
...).  Its SQL is written once in a dialect Spark and the checking database share; the
operators under test run on DataFrames, the checks are independent SQL over the views.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ROLES: dict[str, str] = {}


def role(name: str, sql: str) -> None:
    ROLES[name] = sql.strip()


def _names(sql: str) -> set[str]:
    return set(re.findall(r"[a-z_][a-z_0-9]*", sql.lower()))


def _needed(sql: str) -> list[str]:
    """Roles a statement uses, dependencies first."""
    used = _names(sql)
    out: list[str] = []
    for name in [r for r in ROLES if r in used]:
        for dep in [*_needed(ROLES[name]), name]:
            if dep not in out:
                out.append(dep)
    return out


def to_check_dialect(sql: str) -> str:
    sql = re.sub(r"\barray\(", "list_value(", sql)
    sql = sql.replace("array<string>", "VARCHAR[]")
    return sql


def with_roles(sql: str) -> str:
    """Check SQL with the role views it uses as leading common table expressions."""
    body = sql.strip()
    recursive = re.match(r"with\s+recursive\b", body, re.I) is not None
    own = re.sub(r"^with\s+(recursive\s+)?", "", body, flags=re.I) if body.lower().startswith("with") else None
    parts = [f"{n} AS ({to_check_dialect(ROLES[n])})" for n in _needed(body)]
    if not parts:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + (",\n" + own if own else "\n" + body)


def spread(texts: DataFrame) -> DataFrame:
    """Texts for heavy matching: dealt to all cores where their files have fewer splits, else as they are read."""
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return texts.repartition(cores) if texts.rdd.getNumPartitions() < cores else texts


class Data:
    """Lazily resolved tables and role views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name == "ocr_text":
                self._seen[name] = spread(self.sql(ROLES[name]))
            else:
                self._seen[name] = self.sql(ROLES[name])
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        """SQL over tables and roles, bound as frames (no global views)."""
        names = [n for n in [*TABLES, *ROLES] if n in _names(text)]
        frames = {n: self.get(n) for n in names if re.search(rf"\b(from|join)\s+{n}\b", text, re.I)}
        bound = text.replace("{", "{{").replace("}", "}}")
        for n in sorted(frames, key=len, reverse=True):
            bound = re.sub(rf"\b(from|join)(\s+){n}\b", rf"\1\2{{{n}}}", bound, flags=re.I)
        return self.spark.sql(bound, **frames)


def query(name: str, check: str | None = None) -> Callable:
    """Register ``f(data) -> DataFrame`` under ``name`` with its check SQL."""

    def add(function: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: function(Data(spark, folder))
        if check is not None:
            ORACLES[name] = check
        return function

    return add


@lru_cache(maxsize=1)
def load_all() -> tuple[dict, dict]:
    """Import the catalogue modules; returns (queries, check SQL)."""
    from larder.plans import q_core, q_import, q_match, q_review, q_scalar, q_text, q_vector  # noqa: F401

    return QUERIES, {n: with_roles(s) for n, s in ORACLES.items()}
