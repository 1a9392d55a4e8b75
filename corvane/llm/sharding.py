"""Reproducible sharding: a Feistel permutation of global row numbers, walked until it lands in range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.plans.ranking import global_rank

ROUNDS = 4


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest near-square grid with a * b >= n."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def feistel(x: Column, a: int, b: int, seed: str) -> Column:
    """One pass of a Feistel network over the grid a x b: a permutation of 0 .. a * b - 1."""
    start = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

    def turn(acc: Column, i: Column) -> Column:
        salt = F.concat(F.lit(seed + "/"), i.cast("string"), F.lit(":"))
        mix = lambda v: F.conv(F.substring(F.md5(F.concat(salt, v.cast("string"))), 1, 8), 16, 10).cast("long")
        left = F.when(i % 2 == 0, F.pmod(acc["l"] + mix(acc["r"]), F.lit(a))).otherwise(acc["l"])
        right = F.when(i % 2 == 1, F.pmod(acc["r"] + mix(acc["l"]), F.lit(b))).otherwise(acc["r"])
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, start, turn, lambda acc: acc["l"] * F.lit(b) + acc["r"])


def permuted(x: Column, n: int, seed: str) -> Column:
    """A permutation of 0 .. n - 1: the network is applied again while its value is n or more.

    The grid has fewer than sqrt(n) + 1 places beyond n - 1 and a walk meets each at most once.
    From each of them the next step leaves the range with chance under 1 / sqrt(n); a walk that
    outlasts the steps allowed raises an error rather than give a wrong place.
    """
    a, b = domain(n)
    steps = min(a * b - n, 64)
    walked = feistel(x, a, b, seed)
    if steps:
        again = F.sequence(F.lit(1), F.lit(steps))
        walked = F.aggregate(again, walked, lambda v, _: F.when(v < n, v).otherwise(feistel(v, a, b, seed)))
        walked = F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk too long; take another seed")).cast("long"))
    return walked


def place_rows(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", carry: list[str] | None = None) -> DataFrame:
    """Places every row in a shard and a slot; columns id_col, size, text_crc32, law, shard, slot, grown_shard.

    Rows are numbered in the order of id, checksum and size; row i goes to shard p(i) mod
    ``n_shards`` and slot p(i) div ``n_shards`` with p the permutation above, so shard counts
    differ by one at most and slots have no gaps. Only DataFrame functions run.

    Null and empty texts: size 8, checksum 0. Null ids: numbered first. Rows that are alike in id,
    size and checksum get the places among them in any order. An empty table stays empty. Other
    columns are not read, save those in ``carry``, which come first in the result; one of them
    that has the name of a result column gives way to it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in carry or [] if c not in (id_col, *made)]
    narrow = df.select(
        F.col(id_col), F.crc32(text).cast("long").alias("text_crc32"), (F.octet_length(text) + 8).cast("long").alias("size"), *kept
    )
    ranked = global_rank(narrow, [F.col(id_col).asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()], "_row")
    n = df.count()
    place = permuted(F.col("_row"), n, seed) if n else F.lit(0).cast("long")
    return ranked.withColumn("_place", place).select(
        *kept, id_col, "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_place", F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(n_shards)).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, n_shards: int, id_col: str = "doc_id", text_col: str = "text", seed: str = "7", per_file: int = 1_000_000) -> None:
    """Writes whole rows in slot order, a folder for each shard.

    Tasks get ranges of (shard, slot), so several tasks may write one shard; its files in the
    order of their names hold the slots in order.
    """
    placed = place_rows(df, n_shards, id_col, text_col, seed, carry=df.columns).drop("law", "grown_shard")
    ranged = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.write.option("maxRecordsPerFile", per_file).partitionBy("shard").parquet(path)

