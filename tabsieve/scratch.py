"""A folder that driver and executors share: spark.checkpoint.dir, or a local one where Spark itself is local."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir is unset: the executors of {master} share no folder with the driver")
    if "at" not in _own:
        _own["at"] = tempfile.mkdtemp(prefix="tabsieve-")
        atexit.register(shutil.rmtree, _own["at"], ignore_errors=True)
    return "file://" + _own["at"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


def put_bytes(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file to the shared folder: its path."""
    path = new_path(spark, name)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path
