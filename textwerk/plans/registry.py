"""Every core query by name, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textwerk.plans import checks, corpus, inference, learning, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = corpus.QUERIES | stats.QUERIES | inference.QUERIES | learning.QUERIES | checks.QUERIES
SQL: dict[str, str] = corpus.SQL | stats.SQL | inference.SQL | learning.SQL | checks.SQL
