"""Evaluation cases."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def read_routing(spark: SparkSession, path: str) -> DataFrame:
    """query_id, question, expect, note of a JSON array."""
    rows = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    return spark.createDataFrame([(str(i), r["question"], r.get("expect"), r.get("note")) for i, r in enumerate(rows)], "query_id string, question string, expect string, note string")


def alternatives(fact) -> list[str]:
    """A fact is a string or a list of strings that stand for each other."""
    if isinstance(fact, str):
        return [fact]
    if isinstance(fact, list) and all(isinstance(x, str) for x in fact):
        return fact
    raise ValueError(f"a fact must be a string or a list of strings, not {fact!r}")


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """query_id, question, must_include (array of arrays of alternatives), expect_sources, note."""
    rows = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    flat = [(str(i), r["question"], [alternatives(f) for f in r.get("must_include") or []], r.get("expect_sources") or [], r.get("note")) for i, r in enumerate(rows)]
    return spark.createDataFrame(flat, "query_id string, question string, must_include array<array<string>>, expect_sources array<string>, note string")


def write_cases(rows: DataFrame, path: str) -> None:
    """Generated cases as a JSON file per partition."""
    rows.write.mode("overwrite").json(path)
