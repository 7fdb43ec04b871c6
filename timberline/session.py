"""Session helpers: shipping this package, the shared work folder, lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset and all runs on one machine, as in tests.
DEFAULT_SHARED_DIR = "/tmp/checkpoints"

_shipped: set[str] = set()
_written: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so the
    workers must be able to import the package even where only the driver has it.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="timberline-")) / "timberline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = re.match(r"local(\[|$)", spark.conf.get("spark.master", "local"))
        base = DEFAULT_SHARED_DIR if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_written)
    _written.append(path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the Hadoop file system that owns it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in _written:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            remove_path(spark, path)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage without depending on any one executor: a lost
    executor costs a re-read of the written files, nothing more.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
