"""Session helpers: staging of intermediate tables and settings for local runs."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(app: str, cpus: int | str = 8, **extra: str) -> SparkSession:
    """A session for tests and benches. On a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VARIFORM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
    )
    if CHECKPOINT_DIR not in extra:
        builder = builder.config(CHECKPOINT_DIR, _local_root())
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_root() -> str:
    """A folder of this process, removed when it ends."""
    root = tempfile.mkdtemp(prefix="variform-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's shared checkpoint folder.

    Only a local master may fall back to a temporary folder, where the driver and the
    executors are one machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    return _local_root()


def new_folder(spark: SparkSession, kind: str = "files") -> str:
    """A path in the shared folder that nothing has used."""
    return f"{staging_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage once and read it back.

    Cuts the lineage, survives the loss of executors, and lets every later reader prune columns.
    """
    path = new_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, schema: T.StructType, columns: dict[str, list]) -> DataFrame:
    """A table of a few driver-side rows. As a local relation its size is known to the optimizer."""
    arrow = to_arrow_schema(schema)
    return spark.createDataFrame(pa.table({f.name: pa.array(columns[f.name], f.type) for f in arrow}), schema)
