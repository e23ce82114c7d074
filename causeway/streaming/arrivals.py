"""New source archives as a stream: each is scanned once, results are appended once.

Files are the stream's source, so a batch is what has arrived; a batch that is repeated after a failure finds its digests in the
results and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.api import _graphs
from causeway.operators import catalogue
from causeway.plans.scan import SCHEMA_VERSION, evaluate, reports
from causeway.runtime import stored
from causeway.sources import archives

RESULT = "sha256 string, ruleset int, schema int, report_json string"


def scan_batch(paths: DataFrame, results: str) -> None:
    """Scans the archives at ``paths`` whose digest is not among the results, and appends their reports."""
    spark = paths.sparkSession
    names = [r["path"] for r in paths.select("path").distinct().collect()]  # a batch's files, as the trigger bounds them
    if not names:
        return
    dists = stored(archives.sdists(spark, names), "arrivals")
    try:
        known = spark.read.schema(RESULT).parquet(results)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], RESULT)
    here = known.where((F.col("ruleset") == catalogue.RULESET_VERSION) & (F.col("schema") == SCHEMA_VERSION))
    fresh = stored(dists.join(here.select("sha256"), "sha256", "left_anti"), "fresh")
    graphs = _graphs(fresh)
    out = reports(graphs, stored(evaluate(graphs), "findings"), skipped=archives.skipped_of(fresh))
    first = fresh.groupBy("sha256").agg(F.min("dist_id").alias("dist_id"))
    body = F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"})
    rows = out.select("dist_id", body.alias("report_json")).join(first, "dist_id")
    rows.select("sha256", F.lit(catalogue.RULESET_VERSION).alias("ruleset"), F.lit(SCHEMA_VERSION).alias("schema"), "report_json").write.mode("append").parquet(results)


def watch(spark: SparkSession, directory: str, results: str, checkpoint: str, per_batch: int = 200):
    """The running query; ``processAllAvailable`` works through what is there."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.tar.gz").load(directory).select("path")
    return files.writeStream.foreachBatch(lambda df, _: scan_batch(df, results)).option("checkpointLocation", checkpoint).start()
