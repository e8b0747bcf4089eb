"""Makes the package importable by Python workers whatever their working folder is."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        target = Path(tempfile.mkdtemp()) / "quarry.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def shared(spark: SparkSession, label: str) -> str:
    """A path that driver and executors share: under ``spark.checkpoint.dir``, else beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{label}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh shared path."""
    return f"{shared(spark, label)}-{uuid.uuid4().hex}"


def staged(table: DataFrame, label: str) -> DataFrame:
    """``table`` written to a fresh scratch folder and read back: computed once however often it is read, and safe from lost executors."""
    spark = table.sparkSession
    path = scratch(spark, label)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name under the shared path, built where it is not there; the name must tell the content that it is made from."""
    path = shared(spark, name)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
