"""Joins, windows, limits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.records import fields_to_text
from corvane.operators import joins as J
from corvane.operators import windows as W
from corvane.plans.catalog import query, table
from corvane.plans.q_metrics import EV, _ev, mean_sql, r6


@query("j01_join", "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j02_qa_pairs", "WITH a AS (SELECT l_orderkey, (l_partkey * 10 + l_linenumber) * 10000 + l_suppkey AS aid, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_partkey * 10 + l_linenumber) * 10000 + l_suppkey) AS place FROM lineitem WHERE l_quantity >= 20) SELECT o_orderkey AS qid, aid, l_quantity AS a_score, CAST(place AS INTEGER) AS place FROM orders LEFT JOIN (SELECT * FROM a WHERE place <= 3) x ON o_orderkey = l_orderkey WHERE o_totalprice >= 200000")
def _(spark, d):
    q = table(spark, d, "orders").selectExpr("o_orderkey AS qid", "o_totalprice / 10000 AS q_score")
    a = table(spark, d, "lineitem").selectExpr("l_orderkey AS qid", "(l_partkey * 10 + l_linenumber) * 10000 + l_suppkey AS aid", "l_quantity AS a_score")
    return J.qa_pairs(q, a, 20, 3).select("qid", "aid", "a_score", "place")


@query("j03_best_answers", "WITH a AS (SELECT l_orderkey AS qid, l_linenumber AS aid, l_linenumber = o_orderkey % 5 AS acc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber = o_orderkey % 5 DESC, l_quantity DESC, l_shipdate, l_linenumber) AS place FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT qid, aid, acc AS is_accepted, CAST(place AS INTEGER) AS place FROM a WHERE place <= 3")
def _(spark, d):
    q = table(spark, d, "orders").selectExpr("o_orderkey AS qid", "cast(o_orderkey % 5 as int) AS accepted")
    a = table(spark, d, "lineitem").selectExpr("l_orderkey AS qid", "l_linenumber AS aid", "l_quantity AS a_score", "l_shipdate AS created")
    return J.best_answers(q, a, 3).select("qid", "aid", "is_accepted", "place")


@query("j04_compare_tables", "WITH a AS (SELECT p_partkey, sha256(p_name) AS h FROM part WHERE p_partkey % 7 <> 0), b AS (SELECT p_partkey, sha256(CASE WHEN p_partkey % 5 = 0 THEN p_name || 'x' ELSE p_name END) AS h FROM part WHERE p_partkey % 11 <> 0) SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'extra' WHEN a.h = b.h THEN 'same' ELSE 'drifted' END AS status FROM a FULL JOIN b ON a.p_partkey = b.p_partkey")
def _(spark, d):
    p = table(spark, d, "part")
    a = p.where("p_partkey % 7 <> 0").select("p_partkey", F.sha2("p_name", 256).alias("h"))
    b = p.where("p_partkey % 11 <> 0").select("p_partkey", F.sha2(F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, 'x') ELSE p_name END"), 256).alias("h"))
    return J.compare_tables(a, b, "p_partkey", "h")


@query("j06_semi", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("j07_anti", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return J.unprocessed(table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels"), "doc_id")


@query("j08_contains", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _(spark, d):
    return J.containing(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id")


@query("j09_pareto", "SELECT p_brand, p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_retailprice >= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice > a.p_retailprice OR b.p_size < a.p_size))")
def _(spark, d):
    return J.pareto(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size", ["p_brand"])


@query("j09_budget", "SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 3 DESC, CASE WHEN p_size <= 3 THEN p_retailprice END DESC NULLS LAST, p_size, p_partkey) AS r FROM part) WHERE r = 1")
def _(spark, d):
    return J.best_for_budget(table(spark, d, "part"), "p_retailprice", "p_size", 3, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "p_size")


@query("j10_nearest_niche", "WITH a AS (SELECT DISTINCT user_id % 5 AS x, user_id % 3 AS y, 'n' || user_id % 5 || user_id % 3 AS niche FROM events WHERE user_id % 15 < 9), q AS (SELECT event_id AS query_id, event_id % 6 AS x, event_id % 4 AS y FROM events) SELECT query_id, first(niche ORDER BY d, niche) AS niche, min(d) AS distance FROM (SELECT query_id, niche, CAST((q.x - a.x) ^ 2 + (q.y - a.y) ^ 2 AS DOUBLE) AS d FROM q, a) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    archive = e.where("user_id % 15 < 9").selectExpr("user_id % 5 AS x", "user_id % 3 AS y", "concat('n', user_id % 5, user_id % 3) AS niche").distinct()
    return J.nearest_niche(e.selectExpr("event_id AS query_id", "event_id % 6 AS x", "event_id % 4 AS y"), archive, ["x", "y"])


@query("s04_fields_to_text", "SELECT p_partkey, concat_ws(chr(10) || chr(10), nullif(p_name, ''), nullif(CASE WHEN p_size > 10 THEN p_type ELSE '' END, ''), CAST(p_size AS VARCHAR)) AS body FROM part")
def _(spark, d):
    p = table(spark, d, "part").withColumn("kind", F.expr("CASE WHEN p_size > 10 THEN p_type ELSE '' END"))
    return p.select("p_partkey", fields_to_text(p, ["p_name", "kind", "missing", "p_size"]).alias("body"))


@query("s07_scan_events", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7 AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-05'")
def _(spark, d):
    return table(spark, d, "events").where("user_id = 7 AND event_type = 'click' AND ts >= timestamp_ntz'2024-01-05'").select("event_id", "user_id", "event_type")


@query("s10_assign_source", "WITH f AS (SELECT source || '/d' || doc_id % 3 || '/f' || doc_id || CASE WHEN lang = 'es' AND source IN ('src3', 'src4') THEN '.md' ELSE '.py' END AS path, source FROM documents), m AS (SELECT source, bool_or(ends_with(path, '.md')) AS md FROM f GROUP BY 1) SELECT path, source, CASE WHEN source = 'src1' THEN 'posts' WHEN md THEN 'markdown' ELSE 'code' END AS method, CASE WHEN source = 'src1' THEN 'qa' ELSE source END AS index_name FROM f JOIN m USING (source)")
def _(spark, d):
    files = table(spark, d, "documents").selectExpr("concat(source, '/d', doc_id % 3, '/f', doc_id, CASE WHEN lang = 'es' AND source IN ('src3', 'src4') THEN '.md' ELSE '.py' END) AS path")
    rules = spark.createDataFrame([("src1", "posts", "qa")], "source string, method string, index_name string")
    return J.assign_source(files, rules)


@query("k06_append_rotating", "WITH c AS (SELECT event_id, ts FROM events WHERE event_id % 3 = 0), n AS (SELECT event_id, ts FROM events WHERE event_id % 2 = 0) SELECT event_id FROM (SELECT * FROM c UNION ALL SELECT * FROM n WHERE event_id NOT IN (SELECT event_id FROM c)) ORDER BY ts DESC, event_id DESC LIMIT 500")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return W.append_rotating(e.where("event_id % 3 = 0"), e.where("event_id % 2 = 0"), "event_id", "ts", 500).select("event_id")


@query("w01_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 3")
def _(spark, d):
    return J.top_k(table(spark, d, "lineitem"), ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("w02_latest", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(spark, d):
    return W.latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("w03_retain", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20")
def _(spark, d):
    return W.retain(table(spark, d, "events"), ["user_id"], "ts", "event_id", 20).select("user_id", "event_id")


@query("w04_evict", f"WITH {EV} SELECT id, score FROM ev ORDER BY score DESC, value DESC, ts DESC, id DESC LIMIT 1000")
def _(spark, d):
    return W.evict(_ev(spark, d).withColumn("priority", F.col("score")).withColumn("confidence", F.col("value")), 1000).select("id", "score")


@query("w05_ratchet", f"WITH {EV}, b AS (SELECT id, category, score, max(score) OVER (PARTITION BY category ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM ev) SELECT id, baseline, round(greatest(0, baseline - 0.05), 6) AS threshold, coalesce(score < greatest(0, baseline - 0.05), false) AS regressed FROM b")
def _(spark, d):
    return r6(W.ratchet(_ev(spark, d), "category", 0.05).select("id", "baseline", "threshold", "regressed"), "threshold")


@query("w06_accelerating", f"WITH {EV}, r AS (SELECT user_id, success, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS r FROM ev) SELECT user_id, count(*) FILTER (r <= 3 AND success) AS recent, count(*) FILTER (r > 3 AND success) AS earlier, count(*) FILTER (r <= 3 AND success) > count(*) FILTER (r > 3 AND success) AS accelerating FROM r WHERE r <= 6 GROUP BY 1")
def _(spark, d):
    return W.accelerating(_ev(spark, d).withColumn("escalated", F.col("success")), "user_id")


@query("w07_ladder", f"WITH RECURSIVE {EV}, o AS (SELECT user_id, score, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS r FROM ev), l AS (SELECT user_id, 0 AS r, 1 AS level, 1 AS peak FROM (SELECT DISTINCT user_id FROM o) UNION ALL SELECT user_id, n, v, greatest(peak, v) FROM (SELECT l.user_id, o.r AS n, peak, least(10, greatest(1, level + CASE WHEN score > 0.8 THEN 1 WHEN score < 0.5 THEN -1 ELSE 0 END)) AS v FROM l JOIN o ON o.user_id = l.user_id AND o.r = l.r + 1)) SELECT user_id, arg_max(level, r) AS level, max(peak) AS peak FROM l GROUP BY 1")
def _(spark, d):
    return W.ladder(_ev(spark, d), "user_id")


@query("w08_running_mean", f"WITH {EV} SELECT id, {mean_sql('value', over='OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)')} AS running_mean FROM ev")
def _(spark, d):
    return r6(W.running_mean(_ev(spark, d), "user_id", "value").select("id", "running_mean"), "running_mean")


@query("w09_ema", f"WITH {EV} SELECT user_id, round(list_reduce(list_prepend(0.5, list(score ORDER BY ts, id)), lambda q, x: q + 0.2 * (x - q)), 6) AS q FROM ev GROUP BY 1")
def _(spark, d):
    return r6(W.ema(_ev(spark, d), "user_id", "score"), "q")


@query("w10_champions", f"WITH {EV}, s AS (SELECT user_id AS run, category AS entrant, max(score) AS score FROM ev GROUP BY 1, 2) SELECT run, entrant, score, CAST(rank() OVER (PARTITION BY run ORDER BY score DESC) AS INTEGER) AS rank, round(score - max(score) FILTER (entrant = 'view') OVER (PARTITION BY run), 6) AS lead FROM s")
def _(spark, d):
    s = _ev(spark, d).groupBy(F.col("user_id").alias("run"), F.col("category").alias("entrant")).agg(F.max("score").alias("score"))
    return r6(W.champions(s, "view"), "lead")


@query("w11_acceleration", f"WITH {EV}, c AS (SELECT category, CAST(CAST(ts AS DATE) AS VARCHAR) AS cycle, avg(score) AS score FROM ev GROUP BY 1, 2), x AS (SELECT *, score - lag(score) OVER w AS delta FROM c WINDOW w AS (PARTITION BY category ORDER BY cycle)) SELECT category, cycle, round(delta, 6) AS delta, round(delta - lag(delta) OVER (PARTITION BY category ORDER BY cycle), 6) AS acceleration FROM x")
def _(spark, d):
    c = _ev(spark, d).groupBy("category", F.to_date("ts").cast("string").alias("cycle")).agg(F.avg("score").alias("score"))
    return r6(W.acceleration(c, "category").select("category", "cycle", "delta", "acceleration"), "delta", "acceleration")


@query("l01_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return W.best_first(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 100)


@query("l02_low_confidence", f"WITH {EV} SELECT id, score FROM ev WHERE score < 0.3 ORDER BY ts DESC, id DESC LIMIT 100")
def _(spark, d):
    return W.best_first(_ev(spark, d), [F.col("ts").desc(), F.col("id").desc()], 100, F.col("score") < 0.3).select("id", "score")


@query("l03_sample_n", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':0'), doc_id) AS r FROM documents) WHERE r <= 10")
def _(spark, d):
    return W.sample_n(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 10)


@query("l04_best_examples", f"WITH {EV} SELECT id FROM ev WHERE success ORDER BY score, ts, id LIMIT 50")
def _(spark, d):
    return W.best_first(_ev(spark, d), [F.col("score"), F.col("ts"), F.col("id")], 50, F.col("success")).select("id")


@query("l05_next_item", "SELECT CAST(user_id % 10 AS INTEGER) AS queue, first(event_id ORDER BY value DESC, event_id) AS id, max(value) AS priority FROM events WHERE event_type = 'click' GROUP BY 1")
def _(spark, d):
    items = table(spark, d, "events").selectExpr("cast(user_id % 10 as int) AS queue", "event_id AS id", "value AS priority", "CASE WHEN event_type = 'click' THEN 'open' ELSE 'done' END AS status")
    return W.next_item(items, "queue")


@query("u01_union_distinct", "SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT o_custkey FROM orders")
def _(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").select("user_id").union(table(spark, d, "orders").select("o_custkey")).distinct()


@query("u02_difference", "SELECT c_custkey, 'no_order' AS kind FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT user_id, 'both' FROM (SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders)")
def _(spark, d):
    c, o, e = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_custkey"), table(spark, d, "events").select("user_id")
    return c.subtract(o).withColumn("kind", F.lit("no_order")).union(e.intersect(o).withColumn("kind", F.lit("both")))


@query("u03_upsert", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS p_size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    return W.upsert(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 100), ["p_partkey"])


@query("u04_union_manifests", "SELECT 'a' AS origin, p_partkey AS id, p_name AS name, NULL AS size FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT 'b' AS origin, p_partkey AS id, NULL AS name, p_size AS size FROM part WHERE p_partkey % 5 = 0")
def _(spark, d):
    p = table(spark, d, "part")
    return W.union_manifests({"a": p.where("p_partkey % 4 = 0").selectExpr("p_partkey AS id", "p_name AS name"), "b": p.where("p_partkey % 5 = 0").selectExpr("p_partkey AS id", "p_size AS size")}).select("origin", "id", "name", "size")
