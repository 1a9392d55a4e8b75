"""The registered queries: by name, a function of (spark, sf_dir), and SQL with the same result where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Tables of fewer bytes aren't dealt out.
SMALL = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One that is scanned in fewer parts than there are cores, as a single file of one row group is, has its rows dealt to all cores; columns and filters still reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, plan = spark.sparkContext.defaultParallelism, df._jdf.queryExecution()
    few = plan.toRdd().getNumPartitions() < cores and int(str(plan.optimizedPlan().stats().sizeInBytes())) >= SMALL
    return df.repartition(cores) if few else df


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its SQL if given."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is taken")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add
