"""Aggregations over event, result and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.ranking import global_rank, running

# Fixed values of the canary score.
REFUSALS = ("cannot", "doesn't exist", "no such", "not a real", "won't", "not released")


def exact_mean(value: str | Column, digits: int = 6) -> Column:
    """The mean of numbers with up to nine decimal places, rounded half up once; sums are whole numbers, so it doesn't depend on the order of rows."""
    x = F.col(value) if isinstance(value, str) else value
    total, n = F.sum(F.round(x * 1e9).cast("decimal(28,0)")), F.count(x).cast("decimal(12,0)")
    units = F.call_function("div", 2 * 10**digits * total + 10**9 * n, 2 * 10**9 * n)
    return units / F.lit(float(10**digits))


def telemetry_stats(ev: DataFrame) -> DataFrame:
    """Events, mean confidence and latencies, good and bad feedback of a log (confidence, retrieval_ms, generation_ms, feedback)."""
    return ev.agg(
        F.count(F.lit(1)).alias("n"), exact_mean("confidence").alias("confidence"), F.avg("retrieval_ms").alias("retrieval_ms"), F.avg("generation_ms").alias("generation_ms"),
        F.count_if(F.col("feedback") == "good").alias("good"), F.count_if(F.col("feedback") == "bad").alias("bad"),
    )


def inventory(files: DataFrame, by: str) -> DataFrame:
    """Files, bytes, bad headers and extensions with their counts, of each group of (path, bytes, header_ok)."""
    each = files.groupBy(by, T.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count_if(~F.col("header_ok")).alias("bad"))
    counts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ext", "n"))), lambda x: F.concat(x["ext"], F.lit("="), x["n"].cast("string"))), ",")
    return each.groupBy(by).agg(F.sum("n").alias("files"), F.sum("bytes").alias("bytes"), F.sum("bad").alias("bad"), counts.alias("extensions"))


def readiness(stats: DataFrame) -> DataFrame:
    """(source, documents, pii_share) with a status; an unsafe share is over 5 percent."""
    status = F.when(F.col("documents") == 0, "empty").when(F.col("pii_share") > 0.05, "pii_review_needed").otherwise("ready")
    return stats.withColumn("status", status)


def eval_summary(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per category and in all (category null): results, pass rate, mean, least and best score, mean latency over positive ones."""
    return results.rollup("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("score") >= threshold).cast("double")).alias("pass_rate"), exact_mean("score").alias("mean"),
        F.min("score").alias("low"), F.max("score").alias("high"), F.avg(F.when(F.col("latency") > 0, F.col("latency"))).alias("latency"),
    )


def token_share(text: Column, tokens: Column) -> Column:
    low = F.lower(text)
    return F.when(F.size(tokens) == 0, 1.0).otherwise(F.size(F.filter(tokens, lambda t: low.contains(F.lower(t)))) / F.size(tokens))


def score_answer(answer: Column, keywords: Column, imports: Column, weights: dict[str, float]) -> Column:
    """Five sub-scores of an answer and their weighted mean. Code counts as runnable if its brackets balance."""
    block = answer.contains("```")
    code = F.regexp_extract(answer, r"(?s)```(?:python|py)?\s*\n(.*?)```", 1)
    count = lambda signs: F.regexp_count(code, F.lit(signs))
    balanced = (count(r"\(") == count(r"\)")) & (count(r"\[") == count(r"\]")) & (count(r"\{") == count(r"\}"))
    parts = {
        "has_code": block.cast("double"), "has_correct_api": token_share(answer, keywords), "has_imports": token_share(answer, imports),
        "is_runnable": F.when(code.rlike(r"\S"), balanced).otherwise(block).cast("double"), "cites_source": answer.rlike(r"https?://|[a-zA-Z0-9_/\\]+\.\w{1,5}").cast("double"),
    }
    total = sum((v * weights.get(k, 0.0) for k, v in parts.items()), F.lit(0.0)) / max(sum(weights.get(k, 0.0) for k in parts), 1e-12)
    return F.struct(*[v.alias(k) for k, v in parts.items()], F.round(total, 4).alias("weighted_total"))


def score_canary(answer: Column, expected: Column, category: Column, behavior: Column) -> Column:
    low = F.lower(answer)
    keyword = F.when(F.size(expected) == 0, 0.0).otherwise(token_share(answer, expected))
    refused = T.has_any(low, REFUSALS)
    acts = F.when(behavior == "refuse", refused.cast("double")).otherwise(F.when(refused, 0.5).otherwise(1.0))
    total = (
        F.when(category == "coding", keyword * 0.4 + answer.contains("```").cast("double") * 0.4 + acts * 0.2)
        .when(category.isin("trick", "injection"), acts * 0.6 + keyword * 0.4).otherwise(keyword * 0.7 + acts * 0.3)
    )
    return F.struct(F.round(keyword, 3).alias("keyword_score"), refused.alias("refused"), F.round(total, 3).alias("total"), (total >= 0.5).alias("passed"))


def retrieval_metrics(hits: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """Over golden pairs (query_id, chunk_id): hit rate, recall at 5 and mean reciprocal rank at k, by the best hit of each query."""
    best = hits.join(golden, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    each = golden.select("query_id").distinct().join(best, "query_id", "left")
    return each.agg(
        F.count(F.lit(1)).alias("queries"), F.avg(F.col("rank").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(F.col("rank") <= 5, F.lit(False)).cast("double")).alias("recall_at_5"),
        F.avg(F.when(F.col("rank") <= k, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    )


def failure_modes(hits: DataFrame, golden: DataFrame) -> DataFrame:
    """Queries by how their hits fail golden rows (query_id, file, symbol); hits have (query_id, path, content)."""
    seen = golden.join(hits, "query_id", "left").groupBy("query_id").agg(
        F.coalesce(F.bool_or(F.col("path").contains(F.col("file"))), F.lit(False)).alias("file_ok"), F.coalesce(F.bool_or(F.col("content").contains(F.col("symbol"))), F.lit(False)).alias("symbol_ok")
    )
    mode = F.when(F.col("file_ok") & F.col("symbol_ok"), "pass").when(F.col("symbol_ok"), "wrong_file").when(F.col("file_ok"), "missing_symbol").otherwise("both")
    return seen.groupBy(mode.alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def ab_report(base: DataFrame, cand: DataFrame, eps: float = 0.01) -> DataFrame:
    """Per category: means of both runs over common ids, their difference, and how many improved, got worse or stayed."""
    both = base.select("id", "category", F.col("score").alias("a")).join(cand.select("id", F.col("score").alias("b")), "id")
    delta = F.round(F.col("b") - F.col("a"), 9)
    return both.withColumn("d", delta).groupBy("category").agg(
        F.avg("a").alias("base"), F.avg("b").alias("candidate"), F.avg("d").alias("delta"),
        F.count_if(F.col("d") > eps).alias("improved"), F.count_if(F.col("d") < -eps).alias("regressed"), F.count_if(F.abs("d") <= eps).alias("unchanged"),
    )


def category_deltas(base: DataFrame, cand: DataFrame) -> DataFrame:
    """Mean score of each category in either run, 0 where it has none, and the difference."""
    mean = lambda df, n: df.groupBy("category").agg(F.avg("score").alias(n))
    a, b = F.coalesce("base", F.lit(0.0)), F.coalesce("candidate", F.lit(0.0))
    return mean(base, "base").join(mean(cand, "candidate"), "category", "full_outer").select("category", a.alias("base"), b.alias("candidate"), (b - a).alias("delta"))


def study_list(results: DataFrame, threshold: float, n: int, fallback: int = 3) -> DataFrame:
    """The n lowest results of each category whose mean is below ``threshold``, or of the ``fallback`` weakest if none is; each question once."""
    means = results.groupBy("category").agg(F.avg("score").alias("mean"))
    place = F.row_number().over(Window.orderBy("mean", "category"))  # a row for each category
    weak = F.count_if(F.col("mean") < threshold).over(Window.partitionBy(F.lit(1)))
    picked = means.withColumn("place", place).withColumn("weak", weak).where((F.col("mean") < threshold) | ((F.col("weak") == 0) & (F.col("place") <= fallback)))
    once = results.groupBy("category", "question").agg(F.min("score").alias("score"))
    order = Window.partitionBy("category").orderBy("score", "question")
    return once.join(picked.select("category"), "category").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def recurring(mem: DataFrame, n: int) -> DataFrame:
    """Queries (first 100 signs, lower case) asked in n sessions at least, with first and last time and up to five entries.

    Entries are numbered by a partial top-five in each task, so no list of all of them is made.
    """
    rows = mem.withColumn("pattern", F.lower(F.substring("query", 1, 100)))
    order = Window.partitionBy("pattern").orderBy("entry_id")
    first = rows.select("pattern", "entry_id", F.row_number().over(order).alias("r")).where("r <= 5")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "entry_id"))), lambda x: x["entry_id"]), ",")
    stats = rows.groupBy("pattern").agg(F.count_distinct("session_id").alias("sessions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).where(F.col("sessions") >= n)
    evidence = first.groupBy("pattern").agg(ids.alias("evidence")).withColumnRenamed("pattern", "_p")
    return stats.join(evidence, F.col("pattern").eqNullSafe(F.col("_p"))).drop("_p")


def quality_patterns(mem: DataFrame, n: int) -> DataFrame:
    """Tag groups of n entries at least: mean quality, success from 0.7."""
    return mem.groupBy("tags").agg(F.count(F.lit(1)).alias("entries"), exact_mean("quality").alias("quality")).where(F.col("entries") >= n).withColumn("kind", F.when(F.col("quality") >= 0.7, "success").otherwise("failure"))


def session_summary(mem: DataFrame, top: int = 10) -> DataFrame:
    """Entries, mean quality, first and last time and the most frequent tags of each session."""
    base = mem.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), exact_mean("quality").alias("quality"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    tags = mem.groupBy("session_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("session_id").orderBy(F.col("n").desc(), "tag")
    best = tags.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), ",").alias("tags"))
    return base.join(best, "session_id", "left")


def daily_stats(ev: DataFrame) -> DataFrame:
    """Sessions, tokens, tool calls, completions and their success rate of each day."""
    return ev.groupBy(F.to_date("ts").alias("day")).agg(
        F.count_distinct("session_id").alias("sessions"), F.sum("tokens").alias("tokens"), F.count_if(F.col("kind") == "tool").alias("tool_calls"), F.count_if(F.col("kind") == "done").alias("completions"),
        F.try_divide(F.count_if((F.col("kind") == "done") & F.col("success")), F.count_if(F.col("kind") == "done")).alias("success_rate"),
    )


def memory_stats(mem: DataFrame) -> DataFrame:
    """Entries, sessions and mean quality by type, and of all (type null)."""
    return mem.rollup("kind").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("session_id").alias("sessions"), exact_mean("quality").alias("quality"))


def weakness(outcomes: DataFrame, challenges: DataFrame) -> DataFrame:
    """Failures by game and mode with their mean confidence."""
    return outcomes.where(~F.col("success")).join(challenges, "challenge_id").groupBy("game", "mode").agg(F.count(F.lit(1)).alias("failures"), exact_mean("confidence").alias("confidence"))


def arms(outcomes: DataFrame) -> DataFrame:
    """Beta posteriors of strategies by query type, and whether each is the best of its type."""
    a = outcomes.groupBy("query_type", "strategy").agg((1 + F.sum("reward")).alias("alpha"), (1 + F.sum(1 - F.col("reward"))).alias("beta"), F.count(F.lit(1)).alias("uses"), F.avg("latency").alias("latency"))
    a = a.withColumn("confidence", F.col("alpha") / (F.col("alpha") + F.col("beta")))
    order = Window.partitionBy("query_type").orderBy(F.round("confidence", 9).desc(), "strategy")
    return a.withColumn("best", F.row_number().over(order) == 1)


def ucb(outcomes: DataFrame, c: float = 1.41) -> DataFrame:
    """UCB1 of each arm: mean + c sqrt(ln N / n); a null reward registers an arm, and untried ones come first (score null)."""
    a = outcomes.groupBy("arm").agg(F.count("reward").alias("pulls"), F.avg("reward").alias("mean"), F.max("reward").alias("best"))
    total = a.agg(F.sum("pulls").alias("total"))
    return a.crossJoin(F.broadcast(total)).select("arm", "pulls", "mean", "best", F.when(F.col("pulls") > 0, F.col("mean") + c * F.sqrt(F.log(F.greatest("total", F.lit(1))) / F.col("pulls"))).alias("ucb"))  # total: one row


def acceptance(outcomes: DataFrame, uses: int = 3, low: float = 0.2) -> DataFrame:
    """Acceptance rate and mean gain of sources used often enough, and whether they are of low value."""
    return outcomes.groupBy("source").agg(F.count(F.lit(1)).alias("uses"), F.avg(F.col("accepted").cast("double")).alias("rate"), F.avg(F.when(F.col("accepted"), F.col("gain"))).alias("gain")).where(F.col("uses") >= uses).withColumn("low_value", F.col("rate") <= low)


def term_yield(log: DataFrame) -> DataFrame:
    """Per query term: uses, novel finds, mean yield, and yield x min(uses, 5)."""
    t = log.select(F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"), "novel", "fetched")
    each = t.groupBy("term").agg(F.count(F.lit(1)).alias("uses"), F.sum("novel").alias("novel"), F.avg(F.col("novel") / F.greatest(F.lit(1), F.col("fetched"))).alias("yield"))
    return each.withColumn("value", F.col("yield") * F.least("uses", F.lit(5)))


def yield_trend(log: DataFrame, by: str, size: int = 20) -> DataFrame:
    """Whether the second half of the last ``size`` yields of a key beats the first by 0.05, and the mean of the last five."""
    order = Window.partitionBy(by).orderBy(F.col("ts").desc(), F.col("id").desc())
    last = log.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    half = last.withColumn("n", n).withColumn("late", F.col("r") <= F.col("n") - F.floor(F.col("n") / 2))
    agg = half.groupBy(by).agg(F.max("n").alias("n"), F.avg(F.when(F.col("late"), F.col("yield"))).alias("late"), F.avg(F.when(~F.col("late"), F.col("yield"))).alias("early"), F.avg(F.when(F.col("r") <= 5, F.col("yield"))).alias("current"))
    gap = F.round(F.col("late") - F.col("early"), 9)
    trend = F.when(F.col("n") < 4, "insufficient_data").when(gap > 0.05, "improving").when(gap < -0.05, "declining").otherwise("stable")
    return agg.select(by, "n", trend.alias("trend"), "current")


def decay(signals: DataFrame, threshold: float = 0.5, default_rate: float = 0.001) -> DataFrame:
    """Per agent: weighted quality of the last five signals, decay rate of ln(score) over time, time to the threshold, and whether to rotate."""
    last = Window.partitionBy("agent").orderBy(F.col("ts").desc(), F.col("id").desc())
    s = signals.withColumn("r", F.row_number().over(last)).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    weight = F.element_at(F.array(*[F.lit(x) for x in (0.3, 0.25, 0.2, 0.15, 0.1)]), F.col("r"))
    some = F.col("score") > 0
    log = F.when(some, F.log(F.greatest("score", F.lit(0.01))))
    agg = s.groupBy("agent").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("r") <= 5, F.col("score") * weight)).alias("weighted"), F.avg(F.when(F.col("r") <= 5, F.col("score"))).alias("plain"),
        F.regr_slope(log, F.when(some, F.col("t"))).alias("slope"), F.count_if(some).alias("positive"), (F.max(F.when(some, F.col("t"))) - F.min(F.when(some, F.col("t")))).alias("span"),
    )
    rate = F.when((F.col("n") >= 3) & (F.col("positive") >= 3) & (F.col("span") >= 1) & (F.col("slope") < 0), -F.col("slope")).otherwise(default_rate)
    quality = F.when(F.col("n") >= 5, F.col("weighted")).otherwise(F.col("plain"))
    wait = F.when(F.col("quality") <= threshold, 0.0).otherwise(-F.log(F.lit(threshold) / F.greatest("quality", F.lit(0.01))) / F.col("rate"))
    out = agg.where("n >= 2").select("agent", "n", quality.alias("quality"), rate.alias("rate")).withColumn("wait", wait)
    return out.withColumn("rotate", (F.col("quality") <= threshold) | (F.col("wait") < 60)).withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 20))


def surrogate(df: DataFrame, features: list[str], label: str, penalty: float = 0.01) -> tuple[list[float], float, float]:
    """(weights, intercept, R2) of a ridge regression on standardised features."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    v = VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip").transform(df)
    x = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(v).transform(v)
    model = LinearRegression(featuresCol="_x", labelCol=label, regParam=penalty, elasticNetParam=0.0, standardization=False).fit(x)
    return list(model.coefficients), model.intercept, model.summary.r2


def qd_archive(solutions: DataFrame) -> DataFrame:
    """Per niche: the fittest configuration, visits, and how often the best got better in the order of (ts, id)."""
    s = running(solutions, [F.col("ts"), F.col("id")], ["niche"], {"_before": ("max", "fitness")}, before=True)
    return s.groupBy("niche").agg(
        F.max_by("config", F.struct("fitness", -F.col("id"))).alias("config"), F.max("fitness").alias("fitness"), F.count(F.lit(1)).alias("visits"),
        F.count_if(F.col("_before").isNull() | (F.col("fitness") > F.col("_before"))).alias("improvements"),
    )


def qd_coverage(archive: DataFrame, niches: int) -> DataFrame:
    """One row: niches filled and their share of all, mean and best fitness, visits and improvements."""
    return archive.agg(
        F.count(F.lit(1)).alias("filled"), F.lit(niches).alias("niches"), F.round(100 * F.count(F.lit(1)) / F.lit(niches), 1).alias("coverage_pct"),
        exact_mean("fitness", 3).alias("mean_fitness"), F.max("fitness").alias("best_fitness"), F.sum("visits").alias("visits"), F.sum("improvements").alias("improvements"),
    )


def qd_top(archive: DataFrame, n: int = 10) -> DataFrame:
    """The n fittest niches of an archive."""
    return archive.orderBy(F.col("fitness").desc(), "niche").limit(n)


def qd_underexplored(archive: DataFrame, visits: int = 3) -> DataFrame:
    """Niches with fewer visits than that."""
    return archive.where(F.col("visits") < visits).select("niche", "visits")


def learning_value(answers: DataFrame) -> DataFrame:
    """Per query: disagreement (entropy of answers over log2 of how many differ), frontier of confidence, and the blend with uncertainty."""
    n = answers.groupBy("query_id", "answer").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"))
    total = F.sum("n").over(Window.partitionBy("query_id"))
    p = F.col("n") / F.col("total")
    agg = n.withColumn("total", total).groupBy("query_id").agg(F.count(F.lit(1)).alias("answers"), F.sum(-p * F.log2(p)).alias("entropy"), (F.sum("c") / F.max("total")).alias("confidence"))
    spread = F.when(F.col("answers") > 1, F.col("entropy") / F.log2("answers")).otherwise(0.0)
    unsure = 1 - F.abs(2 * F.col("confidence") - 1)
    edge = T.frontier(F.col("confidence"))
    return agg.select("query_id", spread.alias("disagreement"), edge.alias("frontier"), (0.35 * unsure + 0.35 * spread + 0.30 * edge).alias("value"))


def funnel(log: DataFrame, stages: list[str]) -> DataFrame:
    """Rows of each stage in order, stages without any included."""
    order = log.sparkSession.createDataFrame([(i, s) for i, s in enumerate(stages)], "nth int, stage string")
    return order.join(log.groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage", "left").select("nth", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def exclusions(log: DataFrame, stage: str) -> DataFrame:
    return log.where(F.col("stage").startswith(f"excluded_{stage}")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def themes(docs: DataFrame, n: int, min_len: int = 3) -> DataFrame:
    """The n most frequent words and pairs of neighbouring words, stop words left out first; ties by the alphabet."""
    words = F.filter(T.topic_terms(F.col("text")), lambda w: ~w.isin(*T.CLAIM_STOP_WORDS) & (F.length(w) >= min_len))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = docs.select(words.alias("w")).select(F.explode(F.concat("w", pairs)).alias("theme"))
    return grams.groupBy("theme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "theme").limit(n)


def theme_cells(docs: DataFrame, theme_rows: DataFrame) -> DataFrame:
    """(theme, source, negative, stance) of themes in sources (source, text, negative): the share of a source's texts with the theme that are negative."""
    have = docs.select("source", "negative", F.explode(F.array_distinct(T.topic_terms(F.col("text")))).alias("theme"))
    cells = have.join(theme_rows.select("theme"), "theme").groupBy("theme", "source").agg(F.avg(F.col("negative").cast("double")).alias("negative"))
    return cells.withColumn("stance", F.when(F.col("negative") < 0.1, "supports").when(F.col("negative") > 0.4, "contradicts").otherwise("neutral"))


def theme_matrix(docs: DataFrame, theme_rows: DataFrame, share: float = 0.5) -> DataFrame:
    """Per theme: sources (source, text, negative) that support, contradict, are neutral or silent, with consensus and gap. Whether a text is negative is given."""
    sources = docs.agg(F.count_distinct("source").alias("sources"))
    agg = theme_cells(docs, theme_rows).groupBy("theme").agg(F.count_if(F.col("stance") == "supports").alias("supports"), F.count_if(F.col("stance") == "contradicts").alias("contradicts"), F.count(F.lit(1)).alias("seen"))
    consensus = F.when((F.col("supports") > 0) & (F.col("contradicts") > 0), "contradicted").when(F.col("supports") >= share * F.col("seen"), "strong_agreement").otherwise("mixed")
    return agg.crossJoin(F.broadcast(sources)).select("theme", "supports", "contradicts", (F.col("sources") - F.col("seen")).alias("silent"), consensus.alias("consensus"), (F.col("sources") - F.col("seen") > share * F.col("sources")).alias("gap"))  # sources: one row


def theme_wide(docs: DataFrame, theme_rows: DataFrame, sources: list[str]) -> DataFrame:
    """Per theme a column for each of ``sources`` with its stance, ``silent`` where it has no text with the theme."""
    wide = theme_cells(docs, theme_rows).groupBy("theme").pivot("source", sources).agg(F.first("stance"))
    return theme_rows.select("theme").join(wide, "theme", "left").select("theme", *[F.coalesce(F.col(f"`{s}`"), F.lit("silent")).alias(s) for s in sources])


def rollup_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("best"))


def doc_keywords(docs: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """The n most frequent words of each document, stop words left out."""
    words = F.filter(T.topic_terms(F.col("text")), lambda w: ~w.isin(*T.CLAIM_STOP_WORDS))
    counts = docs.select(id_col, F.explode(words).alias("word")).groupBy(id_col, "word").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(id_col).orderBy(F.col("n").desc(), "word")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def articles(files: DataFrame, few: int = 3) -> DataFrame:
    """Articles of files (file, category, sub, size, modified): one a file in small groups, else one a group."""
    n = F.count(F.lit(1)).over(Window.partitionBy("category", "sub"))
    name = F.when(n <= few, F.concat("category", F.lit("/"), "sub", F.lit("/"), "file")).otherwise(F.concat("category", F.lit("/"), "sub"))
    return files.withColumn("article", name).groupBy("article").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"), F.max("modified").alias("latest"))


def common_folders(paths: DataFrame, n: int, depth: int) -> DataFrame:
    """Folder names within ``depth`` levels that occur in n paths at least."""
    folders = F.filter(F.slice(F.split("path", "/"), 1, depth), lambda x: x != "")
    return paths.select(F.explode(F.array_distinct(folders)).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)


def seal(df: DataFrame, key: str, content: str) -> DataFrame:
    return df.select(key, F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256).alias("digest"))


def validate_items(items: DataFrame) -> DataFrame:
    """(id, issues) of items (id, question, keywords, weights): missing question, duplicate id, weights off 1, no keywords."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("id")) > 1
    issues = F.array_compact(F.array(
        F.when(F.coalesce("question", F.lit("")) == "", "missing_question"), F.when(twice, "duplicate_id"), F.when(F.abs(F.col("weights") - 1) > 0.001, "weights"), F.when(F.size("keywords") == 0, "no_keywords")
    ))
    return items.select("id", F.array_join(issues, ",").alias("issues"))


def staleness(files: DataFrame, roles: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Latest change under each role's prefix (role, prefix), its age in minutes, and whether that is too old; roles without files are stale."""
    age = F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("latest").cast("timestamp"))) / 6e7, 3)
    latest = files.join(roles, F.col("path").startswith(F.col("prefix"))).groupBy("role").agg(F.max("modified").alias("latest"))
    return roles.select("role").distinct().join(latest, "role", "left").select("role", age.alias("age"), (F.col("latest").isNull() | (age > minutes)).alias("stale"))


def latency(log: DataFrame, by: str, column: str) -> DataFrame:
    """Exact percentiles by interpolation between neighbours. Rows are ranked over the whole table, and of each group four at most are picked."""
    rows = log.select(by, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    ranked = global_rank(rows, [F.col("_v")], "_r", [by])
    n = ranked.groupBy(F.col(by).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    at = {name: share * (F.col("n") - 1) for name, share in (("p50", 0.5), ("p95", 0.95))}
    ends = lambda x: (F.floor(x), F.ceil(x))
    picked = ranked.join(n, F.col(by).eqNullSafe(F.col("_k")))
    value = lambda r: F.max(F.when(F.col("_r") == r, F.col("_v")))
    agg = picked.groupBy(by, "n").agg(*[value(e).alias(f"{name}_{i}") for name, x in at.items() for i, e in enumerate(ends(x))])
    between = lambda name: F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * (at[name] - F.floor(at[name]))
    every = log.groupBy(F.col(by).alias("_b")).agg(F.count(F.lit(1)).alias("rows"))
    return every.join(agg, F.col("_b").eqNullSafe(F.col(by)), "left").select(F.col("_b").alias(by), F.col("rows").alias("n"), *[between(name).alias(name) for name in at])


def lanes(files: DataFrame, names: list[str]) -> DataFrame:
    """Files by the first part of their path that is a lane."""
    found = F.try_element_at(F.filter(F.split("path", "/"), lambda x: x.isin(*names)), F.lit(1))
    return files.groupBy(F.coalesce(found, F.lit("other")).alias("lane")).agg(F.count(F.lit(1)).alias("n"))


def diagnose(results: DataFrame) -> DataFrame:
    """Per category: failures, their rate, those without context, scorer disagreements over 0.4, and whether it is weak."""
    failed = F.col("score") < 0.5
    return results.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"), F.count_if(failed & (F.col("context") == 0)).alias("no_context"),
        F.count_if(F.abs(F.col("keyword_score") - F.col("judge_score")) > 0.4).alias("disagreements"), (F.avg(failed.cast("double")) > 0.5).alias("weak"),
    )


def audit_chunks(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without text, without vector, vectors off unit length by 0.01, and the mean text length."""
    norm = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    v = vectors.select("chunk_id", norm.alias("norm"))
    j = chunks.join(v, "chunk_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"), F.count_if(F.col("norm").isNull()).alias("no_vector"),
        F.count_if(F.abs(F.col("norm") - 1) > 0.01).alias("off_norm"), F.avg(F.length("text")).alias("mean_length"),
    )


def issues(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails; a check that is null fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
