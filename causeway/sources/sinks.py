"""Where results go: JSON lines in input order, resumable results, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(reports: DataFrame, path: str, order: list[str]) -> None:
    """IO-23: a JSON object a line, sorted by ``order``, which is not part of it."""
    body = F.to_json(F.struct(*[F.col(c) for c in reports.columns if c not in order]), {"ignoreNullFields": "false"})
    reports.sort(*order).select(body.alias("value")).write.mode("overwrite").text(path)


def todo(wanted: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """IO-24: what a resumed run has still to do."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def csv(rows: DataFrame, path: str) -> None:
    """IO-25."""
    rows.write.mode("overwrite").option("header", True).csv(path)
