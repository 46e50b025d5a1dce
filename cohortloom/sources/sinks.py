"""Sinks: Parquet for tables, CSV / JSON / Markdown for result tables."""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_result_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for results, not data."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def json_safe(value: object) -> object:
    """NaN and infinities to null, numpy scalars to plain ones, recursively."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(json_safe(value), indent=1, ensure_ascii=False))


def markdown_table(df: DataFrame, digits: int = 4, limit: int = 1000) -> str:
    """A result table as Markdown; over ``limit`` rows raise ValueError."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("the table is too long for a report")
    show = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(show, r)) + " |" for r in rows]])
