"""Tables between the steps of a query, so that a step with large expressions is planned and run once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir; in local mode one is made where none is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-staged-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_KEPT: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What a table's files were last written: paths, sizes and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in store.listStatus(place)))


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """`build` staged once in a session for its source tables as they are; a changed source makes a new table."""
    key = (spark.sparkContext.applicationId, name, *(_state(spark, s) for s in sources))
    if key not in _KEPT:
        _KEPT[key] = staged(build(), name)
    return _KEPT[key]
