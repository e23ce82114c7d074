"""A result cache as two tables: entries that are only ever added, and days of last use."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["sha256", "ruleset", "schema"]


def encode_key(sha256: Column, ruleset: Column, schema: Column) -> Column:
    """C-01: 40 bytes: digest, then both versions, highest byte first."""
    word = lambda v: F.unhex(F.lpad(F.hex(v), 8, "0"))
    return F.concat(F.unhex(sha256), word(ruleset), word(schema))


def decode_key(raw: Column) -> Column:
    """C-01: the parts; an error for any other length."""
    hexed = F.hex(raw)
    number = lambda at: F.conv(F.substring(hexed, at, 8), 16, 10).cast("int")
    parts = F.struct(F.lower(F.substring(hexed, 1, 64)).alias("sha256"), number(65).alias("ruleset"), number(73).alias("schema"))
    return F.when(F.octet_length(raw) == 40, parts).otherwise(F.raise_error(F.lit("a cache key has 40 bytes")))


def get(wanted: DataFrame, entries: DataFrame, report_schema: str) -> DataFrame:
    """C-02: wanted keys with their report; one that cannot be read is an error, not a miss."""
    found = wanted.join(entries, KEY)
    report = F.from_json("report_json", report_schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    broken = F.raise_error(F.concat(F.lit("unreadable cache entry "), F.col("sha256")))
    return found.withColumn("report", F.when(F.try_parse_json("report_json").isNull(), broken).otherwise(report))


def put(new: DataFrame, entries: DataFrame) -> DataFrame:
    """C-03: the rows to append: one for each key that is not there, the first by content."""
    first = new.groupBy(*KEY).agg(F.min("report_json").alias("report_json"))
    return first.join(entries, KEY, "left_anti")


def cacheable(mode: str, min_confidence: str | None, default_limits: bool, is_directory: bool) -> bool:
    """C-04: only results of the full method with nothing left out, and never of directories."""
    return mode == "reachability" and min_confidence in (None, "dynamic") and default_limits and not is_directory


def sweep(entries: DataFrame, shape: tuple[int, int], today: int, max_age: int | None, max_bytes: int | None, order: list[str] | None = None) -> DataFrame:
    """C-05: entries to keep: of the present versions, used recently enough, and the newest within the byte limit.

    ``entries``: KEY, last_used (null counts as today), bytes. A row goes if it and all newer rows exceed the limit.
    Running sums are taken a day at a time first, then within the days: no window spans all rows.
    """
    order = order or KEY
    last = F.coalesce("last_used", F.lit(today))
    kept = entries.withColumn("_day", last).where((F.col("ruleset") == shape[0]) & (F.col("schema") == shape[1]))
    if max_age is not None:
        kept = kept.where(F.lit(today) - F.col("_day") <= max_age)
    if max_bytes is not None:
        days = kept.groupBy("_day").agg(F.sum("bytes").alias("_sum"))
        newer = days.select("_day", F.coalesce(F.sum("_sum").over(W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_newer"))
        inner = W.partitionBy("_day").orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
        kept = kept.join(newer, "_day").withColumn("_run", F.col("_newer") + F.sum("bytes").over(inner)).where(F.col("_run") <= max_bytes).drop("_newer", "_run")
    return kept.drop("_day")


def stats(entries: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """C-06."""
    stale = ~((F.col("ruleset") == shape[0]) & (F.col("schema") == shape[1]))
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(stale.cast("long")), F.lit(0)).alias("stale"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def default_location(env: dict[str, str] | None = None) -> str | None:
    """IO-29: where the cache lies if nothing is said; none if no variable names a home."""
    env = os.environ if env is None else env
    for name, below in (("XDG_CACHE_HOME", ""), ("LOCALAPPDATA", ""), ("HOME", ".cache")):
        if env.get(name):
            return os.path.join(env[name], below, "causeway", "results") if below else os.path.join(env[name], "causeway", "results")
    return None


ENTRY = "sha256 string, ruleset int, schema int, report_json string, day int"


class Store:
    """C-07, C-08: the cache in a folder; each run appends, a sweep rewrites. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._to = jvm.org.apache.hadoop.fs.Path
        self._fs = self._to(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _rows(self, name: str) -> DataFrame:
        there = self._fs.exists(self._to(f"{self.path}/{name}"))
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], ENTRY)

    def entries(self) -> DataFrame:
        """Keys with report, last day of use and size."""
        used = self._rows("used").groupBy(*KEY).agg(F.max("day").alias("last_used"))
        return self._rows("scans").drop("day").join(used, KEY, "left").withColumn("bytes", F.octet_length("report_json").cast("long"))

    def add(self, new: DataFrame, day: int) -> None:
        """C-03, and O-12: one append of reports, one of days of use."""
        fresh = put(new, self._rows("scans")).withColumn("day", F.lit(None).cast("int"))
        fresh.write.mode("append").parquet(f"{self.path}/scans")
        self.touch(new, day)

    def touch(self, keys: DataFrame, day: int) -> None:
        keys.select(*KEY).distinct().select(*KEY, F.lit(None).cast("string").alias("report_json"), F.lit(day).alias("day")).write.mode("append").parquet(f"{self.path}/used")

    def sweep(self, shape: tuple[int, int], today: int, max_age: int | None, max_bytes: int | None) -> int:
        """C-05 in place; the number of entries that went. Nothing is rewritten if none did."""
        every = self.entries()
        keep = sweep(every, shape, today, max_age, max_bytes)
        gone = every.count() - keep.count()
        if gone:
            keep.select(*KEY, "report_json", F.col("last_used").alias("day")).write.mode("overwrite").parquet(f"{self.path}/next")
            self._fs.delete(self._to(f"{self.path}/scans"), True)
            self._fs.rename(self._to(f"{self.path}/next"), self._to(f"{self.path}/scans"))
        return gone

    def stats(self, shape: tuple[int, int]) -> dict:
        """C-06; makes no file."""
        return stats(self.entries(), shape).first().asDict()

    def clear(self) -> None:
        """C-08: a missing cache is no error."""
        self._fs.delete(self._to(self.path), True)
