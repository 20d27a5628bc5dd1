"""Checks of results: each rule is a query that returns its violations."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textwerk.sources.writers import content_hash

VIOLATION = "rule string, subject string, detail string"


def stale(path: str, tables: dict[str, DataFrame]) -> str | None:
    """Why a result is out of date with the tables that it was made from; nothing if it is not."""
    if not Path(path).exists():
        return "no provenance"
    state = json.loads(Path(path).read_text(encoding="utf-8"))
    for name, df in tables.items():
        if state.get(f"{name}_sha256") != content_hash(df, name):
            return f"{name} has changed"
    return None


def drift(scores: DataFrame, value: str, tolerance: float = 0.001, by: str = "measure") -> DataFrame:
    """Violations: measures whose value differs between steps by more than the tolerance. Null values are left out."""
    span = scores.where(F.col(value).isNotNull()).groupBy(by).agg((F.max(value) - F.min(value)).alias("span"))
    return span.where(F.col("span") > tolerance).select(F.lit("drift").alias("rule"), F.col(by).cast("string").alias("subject"), F.concat(F.lit("differs by "), F.round("span", 6).cast("string")).alias("detail"))


def incomplete(predictions: DataFrame, expected: DataFrame, by: str = "features") -> DataFrame:
    """Violations: feature sets whose out-of-fold predictions are not one for each expected row; ``expected`` is (by, n)."""
    seen = predictions.groupBy(by).agg(F.count("*").alias("seen"), F.count_distinct("row_id").alias("rows"))
    both = expected.join(seen, by, "left")
    wrong = (F.coalesce("seen", F.lit(0)) != F.col("n")) | (F.coalesce("rows", F.lit(0)) != F.col("n"))
    return both.where(wrong).select(F.lit("incomplete").alias("rule"), F.col(by).cast("string").alias("subject"), F.format_string("%d of %d", F.coalesce("rows", F.lit(0)), F.col("n")).alias("detail"))


def unequal(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Violations: keys that only one side has, or whose values differ by more than the tolerance."""
    x, y = a.select(F.col(key).alias("k"), F.col(value).alias("x"), F.lit(1).alias("_a")), b.select(F.col(key).alias("k"), F.col(value).alias("y"), F.lit(1).alias("_b"))
    both = x.join(y, "k", "full")
    bad = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("x").isNull() != F.col("y").isNull()) | (F.abs(F.col("x") - F.col("y")) > tolerance)
    return both.where(bad).select(F.lit("unequal").alias("rule"), F.col("k").cast("string").alias("subject"), F.concat_ws(" | ", F.coalesce(F.col("x").cast("string"), F.lit("-")), F.coalesce(F.col("y").cast("string"), F.lit("-"))).alias("detail"))


def missing_columns(df: DataFrame, required: list[str], name: str) -> list[str]:
    """Required columns that a table lacks, as ``name.column``."""
    return [f"{name}.{c}" for c in required if c not in df.columns]


def ungrouped(rows: DataFrame, group: str = "cv_group") -> DataFrame:
    """Violations: corpora with rows that have no group."""
    return rows.where(F.col(group).isNull()).groupBy("dataset").agg(F.count("*").alias("n")).select(F.lit("ungrouped").alias("rule"), F.col("dataset").alias("subject"), F.format_string("%d rows", "n").alias("detail"))


def finite(weights: Column) -> Column:
    """Whether an array has only finite, not negative numbers."""
    return F.coalesce(F.forall(weights, lambda w: w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf")) & (w >= 0)), F.lit(False))


def manifest(spark: SparkSession, sections: dict[str, DataFrame], violations: DataFrame) -> dict:
    """A result document of small tables; raises if any rule is violated."""
    found = [r.asDict() for r in violations.limit(100).collect()]
    if found:
        raise ValueError(f"violated: {found}")
    return {name: [r.asDict() for r in df.collect()] for name, df in sections.items()}
