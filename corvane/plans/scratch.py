"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a new temporary folder and any other one
    a folder in the warehouse, which is shared too.
    """
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if spark.sparkContext.master.startswith("local"):
            _own[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/corvane/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of it, so that its lineage ends there.

    The table outlives lost executors. Column order and types are kept; an empty input gives an
    empty table of the same schema.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
