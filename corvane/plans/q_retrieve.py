"""Retrieval queries: what benchmark items ask of documents, and vectors of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import retrieve as R
from corvane.operators.cells import knn_cells
from corvane.plans.catalog import query, table
from corvane.plans.q_text import any_hit, clamp, strings, terms

TECHNICAL = ["with", "them", "thereion"]


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumnRenamed("doc_id", "chunk_id")


def _index(spark: SparkSession, d: str) -> R.Index:
    return R.build_index(_chunks(spark, d))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


_ASK = "text"
SCORES = f"""w AS (SELECT doc_id, {terms("text")} AS t FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) GROUP BY 1, 2),
l AS (SELECT doc_id, len(t) AS dl FROM w), st AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
asked AS (SELECT item_id AS query_id, {_ASK} AS query FROM benchmark),
q AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({terms("query")}) AS term FROM asked) GROUP BY 1, 2),
one AS (SELECT query_id, term, doc_id AS chunk_id, weight * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS part, weight * greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2) AS flat
        FROM q JOIN f USING (term) JOIN p USING (term) JOIN l USING (doc_id), st),
s AS (SELECT query_id, chunk_id, sum(part) AS score FROM one GROUP BY 1, 2)"""


def top(source: str, k: int, by: str = "query_id") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k})"


@query("r01_index_terms", f"WITH {SCORES.split('asked AS')[0].rstrip().rstrip(',')} SELECT term, df, CAST(sum(tf) AS BIGINT) AS tf FROM f JOIN p USING (term) GROUP BY 1, 2")
def _(spark, d):
    index = _index(spark, d)
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("bm25_top10", f"WITH {SCORES} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM {top('s', 10)}")
def bm25_top10(spark, d):
    return R.bm25(_queries(spark, d), _index(spark, d), 10).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


_GOOD = "(SELECT s.* FROM s JOIN documents ON chunk_id = doc_id WHERE length(text) > 3000)"


@query(
    "r03_bm25_quality",
    f"""WITH {SCORES}, g AS (SELECT * FROM {top(_GOOD, 10)}), e AS (SELECT query_id FROM g GROUP BY 1 HAVING count(*) >= 3)
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, true AS filtered FROM g SEMI JOIN e USING (query_id)
    UNION ALL SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, false AS filtered FROM {top("(SELECT * FROM s ANTI JOIN e USING (query_id))", 10)}""",
)
def _(spark, d):
    quality = _chunks(spark, d).select("chunk_id", (F.length("text") > 3000).cast("int").alias("quality"))
    return R.bm25_quality(_queries(spark, d), _index(spark, d), quality, 1, 10).select("query_id", "chunk_id", "rank", "filtered")


_BOOST = f"SELECT query_id, chunk_id, source, sum(part * CASE WHEN list_contains({strings(TECHNICAL)}, term) THEN 2 ELSE 1 END) AS score FROM one JOIN documents ON chunk_id = doc_id WHERE NOT list_contains({strings(T.QUERY_STOP_WORDS)}, term) GROUP BY 1, 2, 3"


@query("r04_bm25_boosted", f"WITH {SCORES}, b AS ({_BOOST}), i AS (SELECT * EXCLUDE (rank) FROM {top('b', 3, 'query_id, source')}) SELECT query_id, chunk_id, source AS index_name, CAST(rank AS INTEGER) AS rank FROM {top('i', 10)}")
def _(spark, d):
    index_of = _chunks(spark, d).select("chunk_id", F.col("source").alias("index_name"))
    return R.bm25_boosted(_queries(spark, d), _index(spark, d), index_of, TECHNICAL, 10).select("query_id", "chunk_id", "index_name", "rank")


KNN = "kn AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


@query("r05_knn", f"WITH {KNN} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 5) AS score FROM {top('kn', 10)}")
def _(spark, d):
    return R.knn(*_vectors(spark, d), 10).select("query_id", "rank", "chunk_id", F.round("score", 5).alias("score"))


@query("r06_knn_cells")
def _(spark, d):
    q, v = _vectors(spark, d)
    return R.recall(knn_cells(q, v, 10), R.knn(q, v, 10))


LISTS = f"""ls AS (SELECT query_id, chunk_id, score, 'keyword' AS list FROM {top("s", 30)}
 UNION ALL SELECT query_id, chunk_id, score, 'flat' AS list FROM {top("(SELECT query_id, chunk_id, sum(flat) AS score FROM one GROUP BY 1, 2)", 30)})"""


def _lists(spark, d):
    """Two lists of 30 hits: scores that regard the length of a document, and scores that don't."""
    asked, index = _queries(spark, d), _index(spark, d)
    lists = [R.bm25(asked, index, 30, b=b).select("query_id", "chunk_id", "score", F.lit(name).alias("list")) for name, b in (("keyword", 0.75), ("flat", 0.0))]
    return lists[0].unionByName(lists[1])


RRF = "rf AS (SELECT query_id, chunk_id, sum(CASE WHEN list = 'keyword' THEN 2.0 ELSE 1.0 END / (60 + r)) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY round(score, 6) DESC, chunk_id) AS r FROM ls) GROUP BY 1, 2)"


@query("r07_rrf", f"WITH {SCORES}, {LISTS}, {RRF} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM {top('rf', 10)}")
def _(spark, d):
    return R.top_hits(R.rrf(_lists(spark, d), weights={"keyword": 2.0}), 10).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


DBSF = f"""db AS (SELECT query_id, chunk_id, sum({clamp("(score - (m - 3 * g)) / CASE WHEN g > 1e-12 THEN 6 * g ELSE 1.0 END")}) AS score
 FROM (SELECT *, avg(score) OVER o AS m, stddev_pop(score) OVER o AS g FROM ls WINDOW o AS (PARTITION BY query_id, list)) GROUP BY 1, 2)"""


@query("r08_dbsf", f"WITH {SCORES}, {LISTS}, {DBSF} SELECT query_id, chunk_id, round(score, 6) AS score FROM db")
def _(spark, d):
    return R.dbsf(_lists(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


_HEAVY = r"regexp_matches(query, '[a-z]+_[a-z]+|[a-z][a-zA-Z]*[A-Z]|\w+\.\w+|\w+\(')"


@query(
    "r09_hybrid",
    f"""WITH {SCORES}, kn AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM asked JOIN embeddings a ON a.vec_id = query_id, embeddings b),
    kp AS (SELECT p.* FROM {top("s", 30)} p JOIN asked USING (query_id) WHERE {_HEAVY} OR rank <= 10),
    ls AS (SELECT query_id, chunk_id, score, 'keyword' AS list FROM kp UNION ALL SELECT query_id, chunk_id, score, 'vector' AS list FROM {top("kn", 10)}),
    {RRF.replace("CASE WHEN list = 'keyword' THEN 2.0 ELSE 1.0 END", "1.0")} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM {top("rf", 10)}""",
)
def _(spark, d):
    v = table(spark, d, "embeddings")
    queries = _queries(spark, d).join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")
    return R.hybrid(queries, _index(spark, d), v.select(F.col("vec_id").alias("chunk_id"), "embedding"), 10).select("query_id", "rank", "chunk_id")


@query(
    "r10_federated",
    f"""WITH {SCORES}, h AS (SELECT * FROM {top("(SELECT s.*, source FROM s JOIN documents ON chunk_id = doc_id)", 5, "query_id, source")}),
    c AS (SELECT query_id, chunk_id, h.source, sha256(text) AS hash, CASE h.source WHEN 'src1' THEN 2.0 WHEN 'src2' THEN 0.5 ELSE 1.0 END / (60 + rank) AS part FROM h JOIN documents ON chunk_id = doc_id),
    m AS (SELECT query_id, hash, sum(part) AS score, first(chunk_id ORDER BY round(part, 9) DESC, chunk_id) AS chunk_id, first(source ORDER BY round(part, 9) DESC, chunk_id) AS index_name FROM c GROUP BY 1, 2)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, index_name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM m) WHERE rank <= 5""",
)
def _(spark, d):
    index_of = _chunks(spark, d).select("chunk_id", F.col("source").alias("index_name"), F.col("text").alias("content"))
    return R.federated(_queries(spark, d), _index(spark, d), index_of, {"src1": 2.0, "src2": 0.5}, 5).withColumn("score", F.round("score", 6))


_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '\S+'))"
OVERLAP = f"coalesce(len(list_intersect({_WORDS.replace('{0}', 'query')}, {_WORDS.replace('{0}', 'text')})) / nullif(len({_WORDS.replace('{0}', 'query')}), 0), 0.0)"


@query("r11_rerank", f"WITH {SCORES}, r AS (SELECT query_id, chunk_id, {OVERLAP} AS score FROM {top('s', 20)} JOIN asked USING (query_id) JOIN documents ON chunk_id = doc_id) SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM {top('r', 5)}")
def _(spark, d):
    hits = R.bm25(_queries(spark, d), _index(spark, d), 20).join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(_queries(spark, d), "query_id")
    return R.rerank(hits, R.overlap_score(F.col("query"), F.col("text")), 5).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("r12_corrective")
def _(spark, d):
    asked = _queries(spark, d).withColumn("confidence", (F.col("query_id") % 10) / 10)
    return R.corrective(asked, _index(spark, d), 0.5, 5)


@query(
    "r13_round_trip",
    f"""WITH {SCORES}, o AS (SELECT item_id AS query_id, min(doc_id) AS source_chunk FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)
    SELECT query_id, source_chunk, CAST(rank AS INTEGER) AS rank, CASE WHEN rank IS NULL THEN 'missed' WHEN rank = 1 THEN 'easy' WHEN rank <= 3 THEN 'medium' ELSE 'hard' END AS difficulty, coalesce(rank <= 5, false) AS passed
    FROM o LEFT JOIN {top("s", 10)} h ON h.query_id = o.query_id AND h.chunk_id = o.source_chunk""".replace("SELECT query_id, source_chunk, CAST", "SELECT o.query_id, source_chunk, CAST"),
)
def _(spark, d):
    from corvane.operators.joins import containing

    source = containing(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "item_id").groupBy(F.col("item_id").alias("query_id")).agg(F.min("doc_id").alias("source_chunk"))
    return R.round_trip(source, R.bm25(_queries(spark, d), _index(spark, d), 10), 5)


@query(
    "r14_keyword_audit",
    f"""WITH a AS (SELECT item_id AS query_id, unnest(list_distinct({terms(_ASK)})) AS term FROM benchmark), z AS (SELECT query_id, count(*) AS z FROM a GROUP BY 1),
    h AS (SELECT doc_id AS chunk_id, unnest(list_distinct({terms("text")})) AS term FROM documents),
    s AS (SELECT query_id, chunk_id, count(*) / any_value(z) AS score FROM a JOIN h USING (term) JOIN z USING (query_id) GROUP BY 1, 2)
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, score >= 0.5 AS passed FROM {top("s", 3)}""",
)
def _(spark, d):
    return R.keyword_audit(_chunks(spark, d).select("chunk_id", "text"), _queries(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "passed")


_KW = f"list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains({strings(T.STOP_WORDS)}, w)))"


@query(
    "r15_experience_recall",
    f"""WITH q AS (SELECT item_id AS query_id, {_KW} AS k FROM benchmark), e AS (SELECT conv_id * 1000 + turn AS exp_id, {_KW} AS k, (conv_id % 11) / 10.0 AS quality, (turn % 7) / 5.0 AS v FROM conversations WHERE role = 'user'),
    b AS (SELECT query_id, exp_id, count(*) AS n FROM (SELECT query_id, unnest(k) AS w FROM q) JOIN (SELECT exp_id, unnest(k) AS w FROM e) USING (w) GROUP BY 1, 2),
    s AS (SELECT query_id, exp_id AS chunk_id, 0.7 * (0.6 * n / (len(q.k) + len(e.k) - n) + 0.4 * quality) + 0.3 * least(1.0, v) AS score FROM b JOIN q USING (query_id) JOIN e USING (exp_id))
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM {top("(SELECT * FROM s WHERE score > 0.1)", 5)}""",
)
def _(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    past = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("exp_id"), F.col("text").alias("query"), F.expr("(conv_id % 11) / 10.0D").alias("quality"), F.expr("(turn % 7) / 5.0D").alias("q_value"))
    return R.experience_recall(asked, past, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_NEWOLD = "nw AS (SELECT user_id AS query_id, event_id AS chunk_id, value AS score FROM events WHERE event_id % 3 <> 0), od AS (SELECT user_id AS query_id, event_id AS chunk_id, value AS score FROM events WHERE event_id % 3 = 0)"


@query(
    "r16_replay_blend",
    f"""WITH {_NEWOLD}, b AS (SELECT query_id, chunk_id, 'new' AS origin, rank FROM {top("nw", 10)} UNION ALL SELECT query_id, chunk_id, 'replayed' AS origin, rank FROM {top("od", 10)})
    SELECT query_id, chunk_id, origin, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank > CASE origin WHEN 'replayed' THEN 3 ELSE 7 END, origin, rank, chunk_id) AS place FROM b) WHERE place <= 10""",
)
def _(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.col("value").alias("score"))
    return R.replay_blend(e.where("chunk_id % 3 <> 0"), e.where("chunk_id % 3 = 0"), 0.3, 10).select("query_id", "chunk_id", "origin", "place")


@query("r17_trail_boost", f"WITH {SCORES}, b AS (SELECT query_id, chunk_id, score + coalesce(0.15 * (2 / (1 + exp(-n)) - 1), 0) AS score FROM {top('s', 20)} LEFT JOIN (SELECT user_id AS chunk_id, count(*) / 10.0 AS n FROM events GROUP BY 1) USING (chunk_id)) SELECT query_id, chunk_id, round(score, 6) AS score FROM b")
def _(spark, d):
    trails = table(spark, d, "events").groupBy(F.col("user_id").alias("chunk_id")).agg((F.count(F.lit(1)) / F.lit(10.0)).alias("strength"))
    return R.trail_boost(R.bm25(_queries(spark, d), _index(spark, d), 20), trails).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("r19_memory_search", f"WITH {SCORES}, nq AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1), full_ AS (SELECT query_id, chunk_id FROM one JOIN nq USING (query_id) GROUP BY 1, 2 HAVING count(*) = any_value(need)) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM {top('(SELECT * FROM s SEMI JOIN full_ USING (query_id, chunk_id))', 5)}")
def _(spark, d):
    return R.search_all_terms(_queries(spark, d), _index(spark, d), 5).select("query_id", "chunk_id", "rank")


@query(
    "r20_lesson_recall",
    f"""WITH {SCORES}, b AS (SELECT query_id, chunk_id, sum(part) AS score FROM one WHERE length(term) > 3 GROUP BY 1, 2),
    h AS (SELECT query_id, chunk_id, rank, quality = 1 AS passed, toxic FROM {top("b", 6)} JOIN labels ON chunk_id = doc_id WHERE quality = 1 OR toxic = 1)
    SELECT query_id, CAST(place AS INTEGER) AS place, chunk_id, passed FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY passed DESC, rank) AS place FROM h) WHERE place <= 3""",
)
def _(spark, d):
    lessons = table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), (F.col("quality") == 1).alias("passed"), F.when(F.col("toxic") == 1, "toxic").alias("lesson"))
    return R.lesson_recall(_queries(spark, d), _index(spark, d), lessons, 3)


_CW = f"list_distinct(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9_]+'), lambda w: length(w) > 2 AND NOT list_contains({strings(T.CLAIM_STOP_WORDS)}, w)))"


@query(
    "r21_verify_claims",
    f"""WITH {SCORES}, c AS (SELECT query_id AS claim_id, coalesce(len(list_intersect({_CW.replace("{0}", "query")}, {_CW.replace("{0}", "text")})) / nullif(len({_CW.replace("{0}", "query")}), 0), 0.0) AS share FROM {top("s", 5)} JOIN asked USING (query_id) JOIN documents ON chunk_id = doc_id),
    n AS (SELECT claim_id, count(*) FILTER (share >= 0.4) AS supports, count(*) FILTER (share < 0.15) AS low_overlap FROM c GROUP BY 1)
    SELECT claim_id, supports, low_overlap, CAST(round({clamp("CASE supports WHEN 0 THEN 0.0 WHEN 1 THEN 0.4 WHEN 2 THEN 0.7 ELSE 0.9 END - 0.15 * low_overlap")}, 6) AS DOUBLE) AS confidence, supports >= 2 AND supports > low_overlap AS verified FROM n""",
)
def _(spark, d):
    hits = R.bm25(_queries(spark, d), _index(spark, d), 5).join(_chunks(spark, d).select("chunk_id", "text"), "chunk_id").join(_queries(spark, d), "query_id")
    return R.verify_claims(hits.select(F.col("query_id").alias("claim_id"), F.col("query").alias("claim"), "text"))


@query("r22_balance", "SELECT claim_id, count(*) FILTER (side = 'opposing') AS opposing, count(*) AS sources, round(count(*) FILTER (side = 'opposing') / count(*), 6) AS balance FROM (SELECT DISTINCT user_id AS claim_id, CASE WHEN value < 50 THEN 'opposing' ELSE 'supporting' END AS side, lower(event_type) || event_id % 7 AS t FROM events) GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events")
    return R.balance(e.select(F.col("user_id").alias("claim_id"), F.when(F.col("value") < 50, "opposing").otherwise("supporting").alias("side"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("title")))


@query("r23_index_stats", "SELECT source AS index_name, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def _(spark, d):
    return R.index_stats(table(spark, d, "documents").select(F.col("source").alias("index_name"), F.col("text").alias("content")))


@query("r24_embedding")
def _(spark, d):
    v = R.with_embedding(table(spark, d, "documents"), "text", 64)
    return v.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 4).alias("norm"))


_ = any_hit
