"""Where tables are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_clean(df: DataFrame, path: str) -> None:
    """The clean archive, a folder for each language and kind of source."""
    df.write.partitionBy("language", "source_kind").mode("append").parquet(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """Chunks by index; writing an index again replaces it and leaves the others."""
    df.write.partitionBy("index_name").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """The manifest as JSON and as CSV."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def write_training(df: DataFrame, extra: DataFrame, path: str) -> None:
    """Instruction records as JSON lines: failed answers go, calibration rows come last."""
    good = df.where(F.coalesce("answer", F.lit("")) != "").where(~F.coalesce("failed", F.lit(False)))
    good.select("instruction", "input", F.col("answer").alias("output")).unionByName(extra.select("instruction", "input", "output")).write.mode("overwrite").json(path)


def write_grouped(df: DataFrame, path: str, n: int = 50) -> None:
    """At most n rows a file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", n).json(path)
