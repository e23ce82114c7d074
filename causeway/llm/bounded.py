"""Choices of the most frequent rows whose number is bounded before anything is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of the highest counts, about ``most`` of them: whole classes of like counts (an eighth of a doubling each), and of the
    class that would exceed the bound a share by the hash of the row.

    Only the sizes of the classes, a few hundred numbers, reach the driver. The hash divides a class evenly, so the bound
    holds up to the scatter of a hash (a percent for thousands of rows); the share is taken a tenth smaller.
    """
    kind = F.floor(F.log2(F.col(count)) * 8)
    sizes = sorted(rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["kind"])
    total = 0
    for r in sizes:
        if total + r["n"] > most:
            share = int(0.9 * (most - total) / r["n"] * (1 << 30))
            return rows.where((kind > r["kind"]) | (kind == r["kind"]) & (F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < share))
        total += r["n"]
    return rows
