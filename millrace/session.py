"""Sending this package to the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once for each context, however the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_millrace", False):
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace-package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(top.rglob("*.py")):
            z.write(source, source.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._millrace = True


_scratch: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, removed when the driver ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def _forget_scratch() -> None:
    while _scratch:
        spark, path = _scratch.pop()
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


atexit.register(_forget_scratch)
