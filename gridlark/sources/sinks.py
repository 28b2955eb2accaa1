"""Writers: partitioned Parquet, CSV, result documents and LaTeX tables."""

from __future__ import annotations

import json
import logging
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame

log = logging.getLogger("gridlark")


def write_table(df: DataFrame, path: str, by: list[str] | None = None, files: int | None = None) -> None:
    """Parquet, partitioned by columns; rows of a partition come from as many tasks as they did, or from `files` of them."""
    rows = df.repartition(files, *by) if files and by else df
    writer = rows.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    log.info("wrote %s", path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_document(path: str, task: str, **parts) -> dict:
    """A small JSON document, atomically: it is there whole or not at all."""
    doc = {**parts, "_task": task, "_timestamp": datetime.now(UTC).isoformat()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(doc, f, ensure_ascii=False, indent=2, allow_nan=True)
    os.replace(f"{path}.tmp", path)
    return doc


def latex(df: DataFrame, caption: str, digits: int = 4, limit: int = 500) -> str:
    """A small result as a LaTeX table; more rows than `limit` are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda v: "--" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    lines = [r"\begin{table}", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline"]
    lines += [" & ".join(map(cell, r)) + r" \\" for r in [df.columns, *rows]]
    return "\n".join([*lines, r"\hline", r"\end{tabular}", r"\end{table}"])
