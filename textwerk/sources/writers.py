"""Writers of results: tables, records, reports and provenance."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, functions as F


def csv_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_lines(df: DataFrame, path: str) -> None:
    """A record a line, in UTF-8."""
    df.write.mode("overwrite").json(path)


def plain(value: Any) -> Any:
    """The value for strict JSON: NaN and infinities become null, rows and arrays plain ones."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.item() if hasattr(value, "item") else value


def json_report(report: dict[str, Any], path: str) -> None:
    """A nested result document."""
    Path(path).write_text(json.dumps(plain(report), ensure_ascii=False, indent=2, allow_nan=False), encoding="utf-8")


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more than ``limit`` rows are an error, as none are left out."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a Markdown table")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def vector_table(df: DataFrame, path: str) -> None:
    """(id, vector) as Parquet, for :func:`textwerk.sources.readers.vectors`."""
    df.select("id", F.col("vector").cast("array<double>").alias("vector")).write.mode("overwrite").parquet(path)


def text_report(lines: list[str], path: str) -> str:
    """A report for people: its lines are written and returned as one text."""
    text = "\n".join(lines) + "\n"
    Path(path).write_text(text, encoding="utf-8")
    return text


def content_hash(df: DataFrame, key: str) -> str:
    """A digest of a table's rows that does not depend on their order or partitioning; repeated rows count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    found = df.agg(F.count("*").alias("n"), *parts).first()
    return hashlib.sha256(json.dumps([key, *map(str, found)]).encode()).hexdigest()


def provenance(path: str, tables: dict[str, DataFrame], **more: Any) -> dict[str, Any]:
    """Write the digests of tables beside a result, for :func:`textwerk.operators.integrity.stale`."""
    state = {f"{name}_sha256": content_hash(df, name) for name, df in tables.items()} | more
    json_report(state, path)
    return state
