"""Results as files on the driver: one CSV for each query, and timings."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame


def write_csv(result: DataFrame, path: str | Path) -> int:
    """Header and rows in the result's order, fetched partition by partition; returns the number of rows."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(result.columns)
        for n, row in enumerate(result.toLocalIterator(), 1):
            out.writerow("" if v is None else v for v in row)
    return n


def write_timings(timings: list[dict], path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(timings, indent=1))
