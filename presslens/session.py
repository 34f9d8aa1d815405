"""Sessions, and getting the package to the executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; sizes are left to the cluster unless given."""
    b = SparkSession.builder.appName("presslens").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers. On one machine PYTHONPATH may do so already; executors elsewhere don't have the driver's. Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or "site-packages" in str(ROOT)
    if here and spark.sparkContext.master.startswith("local"):
        return
    at = tempfile.mkdtemp(prefix="presslens-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{at}/presslens", "zip", ROOT, "presslens"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session names it in spark.checkpoint.dir. Only on one machine, as in tests, it may be unset; a folder of our own is used then."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="presslens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder: later reads survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
