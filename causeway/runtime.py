"""Session plumbing that every operator shares: the shared folder, code shipping, schema guards."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in tests on one machine, a local folder is made and set.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="causeway-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = "file://" + local
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path that is new for each call, in the shared folder."""
    return f"{shared_dir(spark)}/causeway/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove what queries have left in the shared folder; for when none of their results is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/causeway")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again.

    Cuts lineage in a way that survives lost executors, and gives the planner true sizes.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of a batch that goes to a Python worker, where the session sets none: long texts make the usual
#: 10,000 rows large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def ship(spark: SparkSession) -> None:
    """Make this package importable on Python workers, once for each context."""
    sc = spark.sparkContext
    for key, value in BATCH.items():
        if not sc.getConf().contains(key):
            spark.conf.set(key, value)
    if getattr(sc, "_causeway_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="causeway-code-"), "causeway_code.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    sc.addPyFile(out)
    sc._causeway_shipped = True


_held: dict = {"name": None, "clear": None}


def serve(name: str, clear=None) -> None:
    """On a Python worker: what follows belongs to ``name``; tables that another operator left in the worker go.

    Workers outlive stages, and so would the tables of every operator that a job uses.
    """
    if _held["name"] != name:
        if _held["clear"] is not None:
            _held["clear"]()
        _held.update(name=name, clear=clear)


def unused_name(df: DataFrame, stem: str) -> str:
    """``stem``, or what follows it, so that no column of ``df`` has the name in any spelling of case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (stem, *(f"{stem}_{k}" for k in range(len(taken) + 1))) if n not in taken)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
