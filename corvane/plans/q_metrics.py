"""Aggregation queries over events, documents, orders and other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import joins as J
from corvane.operators import metrics as M
from corvane.plans.catalog import query, table
from corvane.plans.q_retrieve import SCORES, _chunks, _index, _queries, top
from corvane.plans.q_text import strings, terms
from corvane.operators import retrieve as R


def r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _ev(spark, d):
    """Events with the names that logs have; scores and flags follow from the event's number."""
    return table(spark, d, "events").selectExpr(
        "event_id AS id", "ts", "user_id", "event_type AS category", "value", "(event_id % 101) / 100.0D AS score", "value * 2 AS latency",
        "event_id % 3 = 0 AS success", "cast(user_id as string) AS session_id", "event_id % 7 AS tokens",
    )


def mean_sql(value: str, scale: int = 100, digits: int = 6, over: str = "") -> str:
    """The mean of numbers that are whole multiples of 1/scale, rounded half up by whole numbers only."""
    n = f"count({value}) {over}"
    return f"(2 * {10**digits} * CAST(sum(CAST(round({value} * {scale}) AS BIGINT)) {over} AS BIGINT) + {scale} * {n}) // (2 * {scale} * {n}) / {10**digits}.0"


EV = """ev AS (SELECT event_id AS id, ts, user_id, event_type AS category, value, (event_id % 101) / 100.0 AS score, value * 2 AS latency,
 event_id % 3 = 0 AS success, CAST(user_id AS VARCHAR) AS session_id, event_id % 7 AS tokens FROM events)"""


@query("a01_telemetry_stats", f"WITH {EV} SELECT count(*) AS n, {mean_sql('score')} AS confidence, round(avg(value), 6) AS retrieval_ms, round(avg(latency), 6) AS generation_ms, count(*) FILTER (id % 5 = 0) AS good, count(*) FILTER (id % 5 = 1) AS bad FROM ev")
def _(spark, d):
    ev = _ev(spark, d).selectExpr("score AS confidence", "value AS retrieval_ms", "latency AS generation_ms", "CASE id % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'bad' END AS feedback")
    return r6(M.telemetry_stats(ev), "confidence", "retrieval_ms", "generation_ms")


_EXT = "['.py', '.md', '.txt'][CAST(p_partkey % 3 AS INTEGER) + 1]"


@query(
    "a02_inventory",
    f"""WITH e AS (SELECT p_brand, substr({_EXT}, 2) AS ext, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes, count(*) FILTER (p_partkey % 10 = 0) AS bad FROM part GROUP BY 1, 2)
    SELECT p_brand AS source, CAST(sum(n) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(bad) AS BIGINT) AS bad, string_agg(ext || '=' || n, ',' ORDER BY ext) AS extensions FROM e GROUP BY 1""",
)
def _(spark, d):
    files = table(spark, d, "part").selectExpr("p_brand AS source", "concat('/x/', p_partkey, element_at(array('.py', '.md', '.txt'), cast(p_partkey % 3 as int) + 1)) AS path", "p_size AS bytes", "p_partkey % 10 <> 0 AS header_ok")
    return M.inventory(files, "source")


@query("a04_readiness", "SELECT source, documents, round(share, 6) AS pii_share, CASE WHEN documents = 0 THEN 'empty' WHEN share > 0.05 THEN 'pii_review_needed' ELSE 'ready' END AS status FROM (SELECT source, count(*) AS documents, avg(CAST(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS INTEGER)) AS share FROM documents GROUP BY 1)")
def _(spark, d):
    stats = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.avg(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").cast("int")).alias("pii_share"))
    return r6(M.readiness(stats), "pii_share")


@query("a05_ingest_stats", "SELECT CASE WHEN length(text) < 100 THEN 'skipped' ELSE 'processed' END AS status, count(*) AS n, CAST(sum(CAST(ceil(length(text) / 1000.0) AS BIGINT)) AS BIGINT) AS chunks FROM documents GROUP BY 1")
def _(spark, d):
    status = F.when(F.length("text") < 100, "skipped").otherwise("processed")
    return table(spark, d, "documents").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.length("text") / F.lit(1000.0))).alias("chunks"))


@query("a06_eval_summary", f"WITH {EV} SELECT category, count(*) AS n, round(avg(CAST(score >= 0.5 AS INTEGER)), 6) AS pass_rate, {mean_sql('score')} AS mean, min(score) AS low, max(score) AS high, round(avg(CASE WHEN latency > 0 THEN latency END), 6) AS latency FROM ev GROUP BY ROLLUP (category)")
def _(spark, d):
    return r6(M.eval_summary(_ev(spark, d)), "pass_rate", "mean", "latency")


_W = {"has_code": 0.2, "has_correct_api": 0.4, "has_imports": 0.1, "is_runnable": 0.1, "cites_source": 0.2}


@query("a07_score_answers")
def _(spark, d):
    answer = F.expr("concat(text, CASE WHEN turn % 2 = 0 THEN '\n```python\nf(x[1])\n```' ELSE ' https://a.b' END)")
    s = M.score_answer(answer, F.split(F.substring("text", 1, 30), " "), F.array(F.lit("os")), _W)
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.*")


_REF = " OR ".join(f"contains(lower(a), '{p.replace(chr(39), chr(39) * 2)}')" for p in M.REFUSALS)


@query(
    "a08_score_canary",
    f"""WITH x AS (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' I cannot say' WHEN 1 THEN ' ```x```' ELSE '' END AS a, ['coding', 'trick', 'canary'][CAST(conv_id % 3 AS INTEGER) + 1] AS cat,
    CASE WHEN conv_id % 2 = 0 THEN 'refuse' ELSE 'answer' END AS beh, string_split(substr(text, 5, 20), ' ') AS kw FROM conversations),
    y AS (SELECT *, len(list_filter(kw, lambda k: contains(lower(a), lower(k)))) / len(kw) AS k, {_REF} AS r FROM x),
    z AS (SELECT *, CASE WHEN beh = 'refuse' THEN CAST(r AS INTEGER) WHEN r THEN 0.5 ELSE 1.0 END AS b FROM y),
    t AS (SELECT *, CASE cat WHEN 'coding' THEN k * 0.4 + CAST(contains(a, '```') AS INTEGER) * 0.4 + b * 0.2 WHEN 'trick' THEN b * 0.6 + k * 0.4 ELSE k * 0.7 + b * 0.3 END AS total FROM z)
    SELECT conv_id, turn, round(k, 3) AS keyword_score, r AS refused, round(total, 3) AS total, total >= 0.5 AS passed FROM t""",
)
def _(spark, d):
    answer = F.expr("concat(text, CASE turn % 3 WHEN 0 THEN ' I cannot say' WHEN 1 THEN ' ```x```' ELSE '' END)")
    cat = F.expr("element_at(array('coding', 'trick', 'canary'), cast(conv_id % 3 as int) + 1)")
    s = M.score_canary(answer, F.split(F.substring("text", 5, 20), " "), cat, F.expr("CASE WHEN conv_id % 2 = 0 THEN 'refuse' ELSE 'answer' END"))
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.*")


GOLD = "g AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


def _golden(spark, d):
    return J.containing(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id").select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))


@query(
    "a09_retrieval_metrics",
    f"""WITH {SCORES}, {GOLD}, h AS (SELECT query_id, min(rank) AS rank FROM {top("s", 10)} JOIN g USING (query_id, chunk_id) GROUP BY 1), e AS (SELECT DISTINCT query_id FROM g)
    SELECT count(*) AS queries, round(avg(CAST(rank IS NOT NULL AS INTEGER)), 6) AS hit_rate, round(avg(CAST(coalesce(rank <= 5, false) AS INTEGER)), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS mrr FROM e LEFT JOIN h USING (query_id)""",
)
def _(spark, d):
    return r6(M.retrieval_metrics(R.bm25(_queries(spark, d), _index(spark, d), 10), _golden(spark, d)), "hit_rate", "recall_at_5", "mrr")


@query(
    "a10_failure_modes",
    f"""WITH {SCORES}, h AS (SELECT query_id, d.source AS path, d.text AS content FROM {top("s", 5)} JOIN documents d ON chunk_id = doc_id),
    gold AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS file, substr(text, 1, 40) AS symbol FROM benchmark),
    x AS (SELECT query_id, coalesce(bool_or(contains(path, file)), false) AS f, coalesce(bool_or(contains(content, symbol)), false) AS s FROM gold LEFT JOIN h USING (query_id) GROUP BY 1)
    SELECT CASE WHEN f AND s THEN 'pass' WHEN s THEN 'wrong_file' WHEN f THEN 'missing_symbol' ELSE 'both' END AS mode, count(*) AS n FROM x GROUP BY 1""",
)
def _(spark, d):
    hits = R.bm25(_queries(spark, d), _index(spark, d), 5).join(_chunks(spark, d), "chunk_id").select("query_id", F.col("source").alias("path"), F.col("text").alias("content"))
    golden = table(spark, d, "benchmark").selectExpr("item_id AS query_id", "concat('src', item_id % 20) AS file", "substr(text, 1, 40) AS symbol")
    return M.failure_modes(hits, golden)


AB = f"{EV}, ba AS (SELECT id, category, score FROM ev WHERE id % 10 <> 0), ca AS (SELECT id, category, CASE WHEN id % 4 = 0 THEN score ELSE (id % 89) / 88.0 END AS score FROM ev WHERE id % 10 <> 1)"


def _ab(spark, d):
    ev = _ev(spark, d)
    return ev.where("id % 10 <> 0").select("id", "category", "score"), ev.where("id % 10 <> 1").selectExpr("id", "category", "CASE WHEN id % 4 = 0 THEN score ELSE (id % 89) / 88.0D END AS score")


@query(
    "a11_ab_report",
    f"""WITH {AB}, j AS (SELECT ba.category, ba.score AS a, ca.score AS b, round(ca.score - ba.score, 9) AS x FROM ba JOIN ca USING (id))
    SELECT category, round(avg(a), 6) AS base, round(avg(b), 6) AS candidate, round(avg(x), 6) AS delta, count(*) FILTER (x > 0.01) AS improved, count(*) FILTER (x < -0.01) AS regressed, count(*) FILTER (abs(x) <= 0.01) AS unchanged FROM j GROUP BY 1""",
)
def _(spark, d):
    return r6(M.ab_report(*_ab(spark, d)), "base", "candidate", "delta")


@query("j05_category_deltas", f"WITH {AB}, a AS (SELECT category, avg(score) AS m FROM ba WHERE category <> 'click' GROUP BY 1), b AS (SELECT category, avg(score) AS m FROM ca WHERE category <> 'view' GROUP BY 1) SELECT category, round(coalesce(a.m, 0), 6) AS base, round(coalesce(b.m, 0), 6) AS candidate, round(coalesce(b.m, 0) - coalesce(a.m, 0), 6) AS delta FROM a FULL JOIN b USING (category)")
def _(spark, d):
    a, b = _ab(spark, d)
    return r6(M.category_deltas(a.where("category <> 'click'"), b.where("category <> 'view'")), "base", "candidate", "delta")


@query(
    "a12_study_list",
    f"""WITH {EV}, m AS (SELECT category, avg(score) AS mean FROM ev GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mean, category) AS place, count(*) FILTER (mean < 0.5) OVER () AS weak FROM m),
    o AS (SELECT category, 'q' || id % 50 AS question, min(score) AS score FROM ev GROUP BY 1, 2)
    SELECT category, question, score, CAST(nth AS INTEGER) AS nth FROM (SELECT o.*, row_number() OVER (PARTITION BY category ORDER BY score, question) AS nth FROM o JOIN k USING (category) WHERE mean < 0.5 OR (weak = 0 AND place <= 3)) WHERE nth <= 5""",
)
def _(spark, d):
    return M.study_list(_ev(spark, d).withColumn("question", F.expr("concat('q', id % 50)")), 0.5, 5)


@query("a13_recurring", f"WITH {EV} SELECT pattern, sessions, first_seen, last_seen, array_to_string(ids[1:5], ',') AS evidence FROM (SELECT category || id % 20 AS pattern, count(DISTINCT session_id) AS sessions, min(ts) AS first_seen, max(ts) AS last_seen, list_sort(list(CAST(id AS VARCHAR))) AS ids FROM ev GROUP BY 1) WHERE sessions >= 3")
def _(spark, d):
    mem = _ev(spark, d).selectExpr("concat(category, id % 20) AS query", "session_id", "ts", "cast(id as string) AS entry_id")
    return M.recurring(mem, 3)


@query("a14_quality_patterns", f"WITH {EV} SELECT tags, entries, q AS quality, CASE WHEN q >= 0.7 THEN 'success' ELSE 'failure' END AS kind FROM (SELECT category || ',' || id % 4 AS tags, count(*) AS entries, {mean_sql('(CASE WHEN id % 4 = 0 THEN 0.5 + score / 2 ELSE score END)', 1000)} AS q FROM ev GROUP BY 1) WHERE entries >= 3")
def _(spark, d):
    mem = _ev(spark, d).selectExpr("concat(category, ',', id % 4) AS tags", "CASE WHEN id % 4 = 0 THEN 0.5 + score / 2 ELSE score END AS quality")
    return r6(M.quality_patterns(mem, 3), "quality")


@query(
    "a15_session_summary",
    f"""WITH {EV}, t AS (SELECT session_id, category || id % 5 AS tag, count(*) AS n FROM ev GROUP BY 1, 2), b AS (SELECT session_id, string_agg(tag, ',' ORDER BY r) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, tag) AS r FROM t) WHERE r <= 10 GROUP BY 1)
    SELECT session_id, count(*) AS entries, {mean_sql('score')} AS quality, min(ts) AS first_ts, max(ts) AS last_ts, any_value(tags) AS tags FROM ev JOIN b USING (session_id) GROUP BY 1""",
)
def _(spark, d):
    return r6(M.session_summary(_ev(spark, d).withColumn("quality", F.col("score")).withColumn("tag", F.expr("concat(category, id % 5)"))), "quality")


DAILY = "CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (category = 'click') AS tool_calls, count(*) FILTER (category = 'purchase') AS completions, round(count(*) FILTER (category = 'purchase' AND success) / nullif(count(*) FILTER (category = 'purchase'), 0), 6) AS success_rate"


@query("a16_daily_stats", f"WITH {EV} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT session_id) AS sessions, {DAILY} FROM ev GROUP BY 1")
def _(spark, d):
    ev = _ev(spark, d).withColumn("kind", F.expr("CASE category WHEN 'click' THEN 'tool' WHEN 'purchase' THEN 'done' ELSE category END"))
    return r6(M.daily_stats(ev), "success_rate").withColumn("day", F.col("day").cast("string"))


@query("a17_memory_stats", f"WITH {EV} SELECT category AS kind, count(*) AS entries, count(DISTINCT session_id) AS sessions, {mean_sql('score')} AS quality FROM ev GROUP BY ROLLUP (category)")
def _(spark, d):
    return r6(M.memory_stats(_ev(spark, d).withColumn("kind", F.col("category")).withColumn("quality", F.col("score"))), "quality")


@query("a18_weakness", f"WITH {EV} SELECT c_mktsegment AS game, CAST(c_nationkey % 3 AS INTEGER) AS mode, count(*) AS failures, {mean_sql('score')} AS confidence FROM ev JOIN customer ON c_custkey = user_id WHERE NOT success GROUP BY 1, 2")
def _(spark, d):
    ch = table(spark, d, "customer").selectExpr("c_custkey AS challenge_id", "c_mktsegment AS game", "cast(c_nationkey % 3 as int) AS mode")
    return r6(M.weakness(_ev(spark, d).withColumnsRenamed({"user_id": "challenge_id", "score": "confidence"}), ch), "confidence")


@query(
    "a19_arms",
    f"""WITH {EV}, a AS (SELECT category AS query_type, CAST(id % 4 AS INTEGER) AS strategy, 1 + sum(score) AS alpha, 1 + sum(1 - score) AS beta, count(*) AS uses, avg(latency) AS latency FROM ev GROUP BY 1, 2)
    SELECT query_type, strategy, round(alpha, 4) AS alpha, round(beta, 4) AS beta, uses, round(latency, 4) AS latency, round(alpha / (alpha + beta), 6) AS confidence,
    row_number() OVER (PARTITION BY query_type ORDER BY round(alpha / (alpha + beta), 9) DESC, strategy) = 1 AS best FROM a""",
)
def _(spark, d):
    a = M.arms(_ev(spark, d).selectExpr("category AS query_type", "cast(id % 4 as int) AS strategy", "score AS reward", "latency"))
    return a.withColumns({"alpha": F.round("alpha", 4), "beta": F.round("beta", 4), "latency": F.round("latency", 4), "confidence": F.round("confidence", 6)})


@query("a20_ucb", f"WITH {EV}, a AS (SELECT category AS arm, count(*) AS pulls, avg(score) AS mean, max(score) AS best FROM ev GROUP BY 1) SELECT arm, pulls, round(mean, 6) AS mean, best, round(mean + 1.41 * sqrt(ln((SELECT sum(pulls) FROM a)) / pulls), 6) AS ucb FROM a")
def _(spark, d):
    return r6(M.ucb(_ev(spark, d).selectExpr("category AS arm", "score AS reward")), "mean", "ucb")


@query("a21_acceptance", f"WITH {EV} SELECT source, uses, round(rate, 6) AS rate, round(gain, 6) AS gain, rate <= 0.2 AS low_value FROM (SELECT CAST(user_id % 50 AS INTEGER) AS source, count(*) AS uses, avg(CAST(id % 5 = 0 AS INTEGER)) AS rate, avg(CASE WHEN id % 5 = 0 THEN value END) AS gain FROM ev GROUP BY 1) WHERE uses >= 3")
def _(spark, d):
    return r6(M.acceptance(_ev(spark, d).selectExpr("cast(user_id % 50 as int) AS source", "id % 5 = 0 AS accepted", "value AS gain")), "rate", "gain")


@query(
    "a22_term_yield",
    f"""WITH t AS (SELECT unnest(list_distinct({terms("text")})) AS term, turn % 4 AS novel, turn % 6 AS fetched FROM conversations),
    e AS (SELECT term, count(*) AS uses, CAST(sum(novel) AS BIGINT) AS novel, avg(novel / greatest(1, fetched)) AS y FROM t GROUP BY 1) SELECT term, uses, novel, round(y, 6) AS "yield", round(y * least(uses, 5), 6) AS value FROM e""",
)
def _(spark, d):
    log = table(spark, d, "conversations").selectExpr("text AS query", "turn % 4 AS novel", "turn % 6 AS fetched")
    return r6(M.term_yield(log), "yield", "value")


@query(
    "a23_yield_trend",
    f"""WITH {EV}, l AS (SELECT user_id, score, r, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM ev) WHERE r <= 20),
    h AS (SELECT user_id, max(n) AS n, avg(score) FILTER (r <= n - n // 2) AS late, avg(score) FILTER (r > n - n // 2) AS early, avg(score) FILTER (r <= 5) AS cur FROM l GROUP BY 1)
    SELECT user_id, n, CASE WHEN n < 4 THEN 'insufficient_data' WHEN round(late - early, 9) > 0.05 THEN 'improving' WHEN round(late - early, 9) < -0.05 THEN 'declining' ELSE 'stable' END AS trend, round(cur, 6) AS current FROM h""",
)
def _(spark, d):
    return r6(M.yield_trend(_ev(spark, d).withColumn("yield", F.col("score")), "user_id"), "current")


@query(
    "a24_decay",
    f"""WITH {EV}, s AS (SELECT user_id AS agent, score, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM ev),
    g AS (SELECT agent, count(*) AS n, sum(score * [0.3, 0.25, 0.2, 0.15, 0.1][r]) FILTER (r <= 5) AS w, avg(score) FILTER (r <= 5) AS p, regr_slope(ln(greatest(score, 0.01)), t) FILTER (score > 0) AS slope,
    count(*) FILTER (score > 0) AS pos, max(t) FILTER (score > 0) - min(t) FILTER (score > 0) AS span FROM s GROUP BY 1),
    q AS (SELECT agent, n, CASE WHEN n >= 5 THEN w ELSE p END AS q, CASE WHEN n >= 3 AND pos >= 3 AND span >= 1 AND slope < 0 THEN -slope ELSE 0.001 END AS rate FROM g WHERE n >= 2)
    SELECT agent, n, round(q, 6) AS quality, q <= 0.5 OR -ln(0.5 / greatest(q, 0.01)) / rate < 60 AS rotate, round(least(1.0, n / 20), 6) AS confidence FROM q""",
)
def _(spark, d):
    return r6(M.decay(_ev(spark, d).withColumn("agent", F.col("user_id"))).select("agent", "n", "quality", "rotate", "confidence"), "quality", "confidence")


@query("a25_surrogate")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    weights, intercept, r2 = M.surrogate(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    names = ["l_quantity", "l_discount", "l_tax", "intercept", "r2"]
    return spark.createDataFrame(list(zip(names, [round(float(x), 4) for x in [*weights, intercept, r2]], strict=True)), "name string, value double")


@query(
    "a26_qd_archive",
    f"""WITH {EV}, s AS (SELECT 'n' || user_id % 30 AS niche, id, ts, score AS fitness, 'c' || id AS config FROM ev), b AS (SELECT *, max(fitness) OVER (PARTITION BY niche ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
    SELECT niche, first(config ORDER BY fitness DESC, id) AS config, max(fitness) AS fitness, count(*) AS visits, count(*) FILTER (before IS NULL OR fitness > before) AS improvements FROM b GROUP BY 1""",
)
def _(spark, d):
    return M.qd_archive(_ev(spark, d).selectExpr("concat('n', user_id % 30) AS niche", "id", "ts", "score AS fitness", "concat('c', id) AS config"))


QD = f"""{EV}, s AS (SELECT 'n' || user_id AS niche, id, ts, score AS fitness, 'c' || id AS config FROM ev), b AS (SELECT *, max(fitness) OVER (PARTITION BY niche ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
 ar AS (SELECT niche, first(config ORDER BY fitness DESC, id) AS config, max(fitness) AS fitness, count(*) AS visits, count(*) FILTER (before IS NULL OR fitness > before) AS improvements FROM b GROUP BY 1)"""


def _archive(spark, d):
    return M.qd_archive(_ev(spark, d).selectExpr("concat('n', user_id) AS niche", "id", "ts", "score AS fitness", "concat('c', id) AS config"))


@query("a26_qd_coverage", f"WITH {QD} SELECT count(*) AS filled, 1000 AS niches, round(100.0 * count(*) / 1000, 1) AS coverage_pct, {mean_sql('fitness', 100, 3)} AS mean_fitness, max(fitness) AS best_fitness, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(improvements) AS BIGINT) AS improvements FROM ar")
def _(spark, d):
    return M.qd_coverage(_archive(spark, d), 1000)


@query("a26_qd_top", f"WITH {QD} SELECT * FROM ar ORDER BY fitness DESC, niche LIMIT 10")
def _(spark, d):
    return M.qd_top(_archive(spark, d))


@query("a26_qd_underexplored", f"WITH {QD} SELECT niche, visits FROM ar WHERE visits < 60")
def _(spark, d):
    return M.qd_underexplored(_archive(spark, d), 60)


@query(
    "a27_learning_value",
    f"""WITH {EV}, n AS (SELECT user_id AS query_id, id % 4 AS answer, count(*) AS n, sum(score) AS c FROM ev GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total FROM n),
    g AS (SELECT query_id, count(*) AS k, sum(-n / total * log2(n / total)) AS e, sum(c) / max(total) AS p FROM t GROUP BY 1), v AS (SELECT query_id, CASE WHEN k > 1 THEN e / log2(k) ELSE 0 END AS s, p FROM g)
    SELECT query_id, round(s, 6) AS disagreement, round(4 * p * (1 - p), 6) AS frontier, round(0.35 * (1 - abs(2 * p - 1)) + 0.35 * s + 0.3 * 4 * p * (1 - p), 6) AS value FROM v""",
)
def _(spark, d):
    return r6(M.learning_value(_ev(spark, d).selectExpr("user_id AS query_id", "id % 4 AS answer", "score AS confidence")), "disagreement", "frontier", "value")


_STAGES = ["view", "click", "purchase", "never"]


@query("a28_funnel", f"SELECT CAST(nth - 1 AS INTEGER) AS nth, stage, coalesce(n, 0) AS n FROM (SELECT unnest({strings(_STAGES)}) AS stage, unnest(range(1, 5)) AS nth) LEFT JOIN (SELECT event_type AS stage, count(*) AS n FROM events GROUP BY 1) USING (stage)")
def _(spark, d):
    return M.funnel(table(spark, d, "events").select(F.col("event_type").alias("stage")), _STAGES)


@query("a28_exclusions", "SELECT 'r' || user_id % 4 AS reason, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def _(spark, d):
    log = table(spark, d, "events").selectExpr("concat('excluded_', event_type) AS stage", "concat('r', user_id % 4) AS reason")
    return M.exclusions(log, "click")


@query("a33_themes", f"""WITH w AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'), lambda x: NOT list_contains({strings(T.CLAIM_STOP_WORDS)}, x)) AS w FROM documents),
 g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS theme FROM w) SELECT theme, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, theme LIMIT 50""")
def _(spark, d):
    return M.themes(table(spark, d, "documents"), 50)


# What counts as negative here is the query's: five words.
_NEG = "not|no|worthless|pathetic|disgusting"
THEMES = f"""w AS (SELECT source, regexp_matches(text, '(?i)\\b({_NEG})\\b') AS neg, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}')) AS w FROM documents),
 th AS (SELECT x AS theme FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}')) AS x FROM documents) WHERE NOT list_contains({strings(T.CLAIM_STOP_WORDS)}, x) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
 c AS (SELECT theme, source, avg(CAST(neg AS INTEGER)) AS neg FROM (SELECT source, neg, unnest(w) AS theme FROM w) SEMI JOIN th USING (theme) GROUP BY 1, 2), z AS (SELECT count(DISTINCT source) AS sources FROM documents)"""


def _themes(spark, d, most: int = 20):
    docs = table(spark, d, "documents").withColumn("negative", F.col("text").rlike(f"(?i)\\b({_NEG})\\b"))
    words = docs.select(F.explode(T.topic_terms(F.col("text"))).alias("theme")).where(~F.col("theme").isin(*T.CLAIM_STOP_WORDS))
    return docs, words.groupBy("theme").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "theme").limit(most)


@query(
    "a34_theme_matrix",
    f"""WITH {THEMES}, a AS (SELECT theme, count(*) FILTER (neg < 0.1) AS supports, count(*) FILTER (neg > 0.4) AS contradicts, count(*) AS seen FROM c GROUP BY 1)
    SELECT theme, supports, contradicts, sources - seen AS silent, CASE WHEN supports > 0 AND contradicts > 0 THEN 'contradicted' WHEN supports >= 0.5 * seen THEN 'strong_agreement' ELSE 'mixed' END AS consensus, sources - seen > 0.5 * sources AS gap FROM a, z""",
)
def _(spark, d):
    return M.theme_matrix(*_themes(spark, d))


_SIDES = ("src0", "src3", "src7", "none")


@query("a34_theme_wide", f"WITH {THEMES} SELECT theme, {', '.join(f"coalesce(max(CASE WHEN neg < 0.1 THEN 'supports' WHEN neg > 0.4 THEN 'contradicts' ELSE 'neutral' END) FILTER (source = '{s}'), 'silent') AS {s}" for s in _SIDES)} FROM th LEFT JOIN c USING (theme) GROUP BY 1")
def _(spark, d):
    return M.theme_wide(*_themes(spark, d), list(_SIDES))


@query("a35_rollup_stats", f"WITH {EV} SELECT category, CAST(user_id % 5 AS INTEGER) AS source, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS best FROM ev GROUP BY 1, 2")
def _(spark, d):
    return r6(M.rollup_stats(_ev(spark, d).withColumn("source", F.expr("cast(user_id % 5 as int)")), ["category", "source"], "value"), "mean")


@query("a37_doc_keywords", f"""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'), lambda x: NOT list_contains({strings(T.CLAIM_STOP_WORDS)}, x))) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2)
 SELECT doc_id, word, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS place FROM c) WHERE place <= 5""")
def _(spark, d):
    return M.doc_keywords(table(spark, d, "documents"), 5)


@query("a36_articles", """WITH f AS (SELECT 'f' || p_partkey AS file, p_type AS category, p_brand AS sub, p_size AS size, p_retailprice AS modified, count(*) OVER (PARTITION BY p_type, p_brand) AS n FROM part)
 SELECT CASE WHEN n <= 3 THEN category || '/' || sub || '/' || file ELSE category || '/' || sub END AS article, count(*) AS files, CAST(sum(size) AS BIGINT) AS size, max(modified) AS latest FROM f GROUP BY 1""")
def _(spark, d):
    return M.articles(table(spark, d, "part").selectExpr("concat('f', p_partkey) AS file", "p_type AS category", "p_brand AS sub", "p_size AS size", "p_retailprice AS modified"))


_PATH = "replace(p_name, ' ', '/') || '/' || p_brand || '/' || p_partkey"
_PATH_SPARK = "concat(replace(p_name, ' ', '/'), '/', p_brand, '/', p_partkey) AS path"


@query("a38_common_folders", f"SELECT folder, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split({_PATH}, '/')[1:3], lambda x: x <> ''))) AS folder FROM part) GROUP BY 1 HAVING count(*) >= 5")
def _(spark, d):
    return M.common_folders(table(spark, d, "part").selectExpr(_PATH_SPARK), 5, 3)


@query("a39_seal", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def _(spark, d):
    return M.seal(table(spark, d, "benchmark"), "item_id", "text")


@query("a40_validate_items", "WITH i AS (SELECT conv_id AS id, CASE WHEN turn % 5 = 0 THEN '' ELSE text END AS q, CASE WHEN turn % 4 = 0 THEN 0.9 ELSE 1.0 END AS w, turn % 6 = 0 AS e, count(*) OVER (PARTITION BY conv_id) > 1 AS dup FROM conversations) SELECT id, array_to_string(list_filter([CASE WHEN q = '' THEN 'missing_question' END, CASE WHEN dup THEN 'duplicate_id' END, CASE WHEN abs(w - 1) > 0.001 THEN 'weights' END, CASE WHEN e THEN 'no_keywords' END], lambda x: x IS NOT NULL), ',') AS issues FROM i")
def _(spark, d):
    return M.validate_items(table(spark, d, "conversations").selectExpr("conv_id AS id", "CASE WHEN turn % 5 = 0 THEN '' ELSE text END AS question", "CASE WHEN turn % 4 = 0 THEN 0.9D ELSE 1.0D END AS weights", "CASE WHEN turn % 6 = 0 THEN array() ELSE array('k') END AS keywords"))


@query("a41_staleness", "WITH r AS (SELECT DISTINCT c_mktsegment AS role, CAST(c_nationkey AS VARCHAR) || '/' AS prefix FROM customer), f AS (SELECT o_custkey % 25 || '/' || o_orderkey AS path, o_orderdate AS modified FROM orders), l AS (SELECT role, max(modified) AS latest FROM f JOIN r ON starts_with(path, prefix) GROUP BY 1) SELECT role, round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(latest)) / 6e7, 3) AS age, latest IS NULL OR round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(latest)) / 6e7, 3) > 1000 AS stale FROM (SELECT DISTINCT role FROM r) LEFT JOIN l USING (role)")
def _(spark, d):
    roles = table(spark, d, "customer").selectExpr("c_mktsegment AS role", "concat(c_nationkey, '/') AS prefix").distinct()
    files = table(spark, d, "orders").selectExpr("concat(o_custkey % 25, '/', o_orderkey) AS path", "o_orderdate AS modified")
    return M.staleness(files, roles, F.expr("timestamp'2002-01-01'"), 1000)


@query("a42_latency", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def _(spark, d):
    return r6(M.latency(table(spark, d, "events"), "event_type", "value"), "p50", "p95")


@query("a43_lanes", f"SELECT coalesce(list_filter(string_split({_PATH}, '/'), lambda x: x IN ('Brand#11', 'Brand#12', 'Brand#13'))[1], 'other') AS lane, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return M.lanes(table(spark, d, "part").selectExpr(_PATH_SPARK), ["Brand#11", "Brand#12", "Brand#13"])


@query("a44_diagnose", f"WITH {EV} SELECT category, count(*) AS n, count(*) FILTER (score < 0.5) AS failures, count(*) FILTER (score < 0.5 AND tokens = 0) AS no_context, count(*) FILTER (abs(score - (id % 11) / 10.0) > 0.4) AS disagreements, avg(CAST(score < 0.5 AS INTEGER)) > 0.5 AS weak FROM ev GROUP BY 1")
def _(spark, d):
    return M.diagnose(_ev(spark, d).selectExpr("category", "score", "tokens AS context", "score AS keyword_score", "(id % 11) / 10.0D AS judge_score"))


@query("a45_audit_chunks", "WITH v AS (SELECT vec_id, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings) SELECT count(*) AS chunks, count(*) FILTER (coalesce(text, '') = '') AS empty, count(*) FILTER (norm IS NULL) AS no_vector, count(*) FILTER (abs(norm - 1) > 0.01) AS off_norm, round(avg(length(text)), 6) AS mean_length FROM documents LEFT JOIN v ON doc_id = vec_id")
def _(spark, d):
    return r6(M.audit_chunks(_chunks(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")), "mean_length")


@query("f04_issues", "SELECT doc_id, concat_ws(',', CASE WHEN NOT length(text) >= 200 THEN 'short' END, CASE WHEN NOT contains(text, chr(10)) THEN 'one_line' END) AS issues FROM documents")
def _(spark, d):
    found = M.issues({"short": F.length("text") >= 200, "one_line": F.col("text").contains("\n")})
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("issues"))
