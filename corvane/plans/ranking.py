"""Row numbers and running values over a whole table, or over huge groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.scratch import cut


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", group: list[str] | None = None) -> DataFrame:
    """Adds ``out``: the 0-based place of each row in ``order``, within ``group`` if given.

    The table is range-partitioned by group and order, so a group of any size spreads over many
    tasks; what meets in one place is one count for each partition and group. Give only the
    columns that are needed: all of them are sorted. ``order`` should be total, else rows that
    tie are numbered in any order. Nulls come first. An empty table stays empty.
    """
    keys = group or []
    placed = df.orderBy(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_at", 33)), "ranked")
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_first"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    # A row for each partition and each group that begins in it: at most partitions + groups.
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = placed.join(F.broadcast(offsets), match).withColumn(out, F.col("_before") + F.col("_at") - F.col("_first"))
    return ranked.select(*df.columns, out)


def running(df: DataFrame, order: list[Column], group: list[str], values: dict[str, tuple[str, str]], before: bool = False) -> DataFrame:
    """Adds running values over each group's rows in ``order``, up to each row or, with ``before``, up to the one before it.

    ``values`` gives, by name, (max, sum or count, column). The table is range-partitioned by group
    and order; each partition's own values of a group are one row, what comes before it is carried
    over from these rows, and the rest happens inside the partition. So no task holds more of a group
    than a range partition. Sums of decimals are exact; nulls don't count. Nulls of a group's columns
    are a group.
    """
    kinds = {"max": F.max, "sum": F.sum, "count": F.count}
    placed = df.orderBy(*[F.col(k).asc_nulls_first() for k in group], *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_at", 33)), "running")
    own = placed.groupBy("_part", *group).agg(*[kinds[kind](c).alias(f"_v{i}") for i, (kind, c) in enumerate(values.values())])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda kind: F.max if kind == "max" else F.sum
    carried = own.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(group)], *[over(kind)(f"_v{i}").over(earlier).alias(f"_c{i}") for i, (kind, _) in enumerate(values.values())])
    match = F.col("_part") == F.col("_p")
    for i, k in enumerate(group):
        match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = {}
    for i, (name, (kind, c)) in enumerate(values.items()):
        here, there = kinds[kind](c).over(inside), F.col(f"_c{i}")
        out[name] = F.greatest(here, there) if kind == "max" else F.coalesce(here + there, here, there)
    # A row for each partition and each group that begins in it: at most partitions + groups.
    return placed.join(F.broadcast(carried), match).withColumns(out).select(*df.columns, *values)
