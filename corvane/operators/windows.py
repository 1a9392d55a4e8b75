"""Ordered windows, retention, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.ranking import global_rank, running


def latest(df: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """The row of each key with the largest (ts, tie)."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r")).select(*key, "_r.*")


def retain(df: DataFrame, by: list[str], ts: str, tie: str, n: int) -> DataFrame:
    """The n newest rows of each key; without keys, of the whole table by a top-k that no single task sorts."""
    if not by:
        return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
    order = Window.partitionBy(*by).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def evict(df: DataFrame, n: int) -> DataFrame:
    """The n rows that stay when the lowest (priority, confidence, ts) go first."""
    return df.orderBy(F.col("priority").desc(), F.col("confidence").desc(), F.col("ts").desc(), F.col("id").desc()).limit(n)


def ratchet(scores: DataFrame, by: str, margin: float) -> DataFrame:
    """Running best before each run, the threshold that the best sets, and whether a score falls below it."""
    seen = running(scores, [F.col("ts"), F.col("id")], [by], {"baseline": ("max", "score")}, before=True)
    return seen.withColumn("threshold", F.greatest(F.lit(0.0), F.col("baseline") - margin)).withColumn("regressed", F.coalesce(F.col("score") < F.col("threshold"), F.lit(False)))


def accelerating(rounds: DataFrame, by: str) -> DataFrame:
    """Escalations in the last three rounds of a key against the three before."""
    order = Window.partitionBy(by).orderBy(F.col("ts").desc(), F.col("id").desc())
    r = rounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 6)
    agg = r.groupBy(by).agg(F.count_if((F.col("r") <= 3) & F.col("escalated")).alias("recent"), F.count_if((F.col("r") > 3) & F.col("escalated")).alias("earlier"))
    return agg.withColumn("accelerating", F.col("recent") > F.col("earlier"))


#: Rows of a key that are walked through at once.
STRETCH = 65_536


def ladder(rounds: DataFrame, by: str, start: int = 1, stretch: int = STRETCH) -> DataFrame:
    """Level of each key after its rounds: up from a score over 0.8, down under 0.5, within 1 and 10, with its peak.

    Rounds are ranked over the whole table. Each stretch of a key's rounds is walked from all ten
    levels, which gives where it leads from each and how high it gets; then stretches are joined in
    their order. So a list holds ``stretch`` rounds, or one entry for each stretch of a key.
    """
    ranked = global_rank(rounds.select(by, "ts", "id", "score"), [F.col("ts"), F.col("id")], "_r", [by])
    move = F.when(F.col("score") > 0.8, 1).when(F.col("score") < 0.5, -1).otherwise(0)
    steps = ranked.groupBy(by, F.floor(F.col("_r") / stretch).alias("_s")).agg(F.array_sort(F.collect_list(F.struct("_r", move.alias("m")))).alias("h"))

    def walked(level):
        def step(a, x):
            new = F.least(F.lit(10), F.greatest(F.lit(1), a["level"] + x["m"]))
            return F.struct(new.alias("level"), F.greatest(a["peak"], new).alias("peak"))

        return F.aggregate("h", F.struct(level.cast("int").alias("level"), level.cast("int").alias("peak")), step)

    led = steps.select(by, "_s", F.transform(F.sequence(F.lit(1), F.lit(10)), walked).alias("to"))
    chain = led.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_s", "to"))).alias("c"))

    def follow(a, x):
        to = F.element_at(x["to"], a["level"])
        return F.struct(to["level"].alias("level"), F.greatest(a["peak"], to["peak"]).alias("peak"))

    end = F.aggregate("c", F.struct(F.lit(start).alias("level"), F.lit(start).alias("peak")), follow)
    return chain.select(by, end.alias("w")).select(by, "w.level", "w.peak")


def running_mean(df: DataFrame, by: str, value: str, digits: int = 6) -> DataFrame:
    """The mean of each key's values so far, rounded half up once; sums are whole units of 10^-9, so they are exact."""
    units = df.withColumn("_u", F.round(F.col(value) * 1e9).cast("decimal(28,0)"))
    seen = running(units, [F.col("ts"), F.col("id")], [by], {"_s": ("sum", "_u"), "_n": ("count", "_u")})
    n = F.col("_n").cast("decimal(12,0)")
    mean = F.call_function("div", 2 * 10**digits * F.col("_s") + 10**9 * n, 2 * 10**9 * n) / F.lit(float(10**digits))
    return seen.withColumn("running_mean", F.when(n > 0, mean)).drop("_u", "_s", "_n")


def ema(df: DataFrame, by: str, value: str, rate: float = 0.2, start: float = 0.5) -> DataFrame:
    """q <- q + rate (value - q) over each key's rows in order.

    Written out, a row that k others follow counts with rate (1 - rate)^k, so rows are ranked over
    the whole table and added up; no history is gathered. Null values count as rows that change nothing.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, "ts", "id", F.col(value).cast("double").alias("_v"))
    ranked = global_rank(rows, [F.col("ts"), F.col("id")], "_r", [by])
    sizes = ranked.groupBy(F.col(by).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    part = rate * F.pow(F.lit(1 - rate), F.col("_n") - F.col("_r") - 1) * F.col("_v")
    summed = ranked.join(sizes, F.col(by).eqNullSafe(F.col("_k"))).groupBy(by).agg((F.sum(part) + start * F.pow(F.lit(1 - rate), F.max("_n"))).alias("_q"))
    every = df.select(F.col(by).alias("_b")).distinct()
    return every.join(summed, F.col("_b").eqNullSafe(F.col(by)), "left").select(F.col("_b").alias(by), F.coalesce("_q", F.lit(start)).alias("q"))


def champions(results: DataFrame, baseline: str) -> DataFrame:
    """Rank of each entrant of a run (run, entrant, score) and its lead over the baseline's score."""
    order = Window.partitionBy("run").orderBy(F.col("score").desc())
    base = F.max(F.when(F.col("entrant") == baseline, F.col("score"))).over(Window.partitionBy("run"))
    return results.withColumn("rank", F.rank().over(order)).withColumn("lead", F.col("score") - base)


def acceleration(cycles: DataFrame, by: str) -> DataFrame:
    """Change of the score from cycle to cycle, and the change of that."""
    w = Window.partitionBy(by).orderBy("cycle")
    delta = F.col("score") - F.lag("score").over(w)
    return cycles.withColumn("delta", delta).withColumn("acceleration", F.col("delta") - F.lag("delta").over(w))


def sample_n(df: DataFrame, by: str, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group at most, by a hash of their ids: the same ones every time and in SQL engines too."""
    pick = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    order = Window.partitionBy(by).orderBy(pick, id_col)
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def best_first(df: DataFrame, order: list[Column], n: int, where: Column | None = None) -> DataFrame:
    """The first n rows that meet a condition."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(n)


def next_item(df: DataFrame, queue: str) -> DataFrame:
    """The open item of each queue with the highest priority, the oldest of equals."""
    open_ = df.where(F.col("status") == "open")
    return open_.groupBy(queue).agg(F.min_by("id", F.struct(-F.col("priority"), "id")).alias("id"), F.max("priority").alias("priority"))


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key; a new one takes the place of an old one."""
    return current.join(new.select(*key), key, "left_anti").unionByName(new)


def insert_ignore(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return current.unionByName(new.join(current.select(*key), key, "left_anti"))


def append_rotating(current: DataFrame, new: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """Current rows and those new ones whose key is unknown, the n newest of all."""
    return retain(insert_ignore(current, new, [key]), [], ts, key, n)


def union_manifests(tables: dict[str, DataFrame]) -> DataFrame:
    """Tables one under another, each row with the name of its table; columns that one lacks are null."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn("origin", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
