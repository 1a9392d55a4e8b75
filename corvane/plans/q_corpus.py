"""Deduplication, chunking and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunk as C
from corvane.operators import dedup as D
from corvane.operators import evidence as E
from corvane.operators import graph as G
from corvane.operators.cells import block_pairs
from corvane.plans.catalog import query, table
from corvane.plans.q_evidence import PAPERS, _papers
from corvane.plans.q_text import strings

N = 128


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


@query("d01_dedup_exact", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(spark, d):
    return D.dedup_exact(_docs(spark, d), D.text_key(F.col("text")), "doc_id").select("doc_id")


SH = "sh AS (SELECT DISTINCT doc_id, substr(x, i, 5) AS shingle FROM (SELECT doc_id, x, unnest(range(1, greatest(1, length(x) - 4) + 1)) AS i FROM (SELECT doc_id, lower(trim(text)) AS x FROM documents)))"


@query("d02_shingles", f"WITH {SH} SELECT doc_id, count(*) AS shingles FROM sh GROUP BY 1")
def _(spark, d):
    return D.shingles(_docs(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("shingles"))


_P = D.PRIME
SIG = f"{SH}, hs AS (SELECT doc_id, CAST('0x' || substr(md5(shingle), 1, 8) AS BIGINT) % {_P} AS h FROM sh), sg AS (SELECT doc_id, [{', '.join(f'min((h * {a} + {b}) % {_P})' for a, b in D.coefficients(N))}] AS s FROM hs GROUP BY 1)"
# Pairs by brute force: all representatives of different sets that share a shingle and whose sizes allow the similarity.
PAIRS = f"""{SH}, st AS (SELECT doc_id, md5(string_agg(shingle, chr(1) ORDER BY shingle)) AS s, count(*) AS n FROM sh GROUP BY 1), rp AS (SELECT s, min(doc_id) AS rep, any_value(n) AS n FROM st GROUP BY 1), cl AS (SELECT doc_id, rep FROM st JOIN rp USING (s)),
 rs AS (SELECT rep, n, shingle FROM rp JOIN sh ON rep = doc_id),
 sm AS (SELECT x.rep AS a, y.rep AS b, count(*) AS shared, any_value(x.n) AS m, any_value(y.n) AS n FROM rs x JOIN rs y ON x.shingle = y.shingle AND x.rep < y.rep AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n GROUP BY 1, 2),
 np AS (SELECT a, b, shared / (m + n - shared) AS similarity FROM sm WHERE shared / (m + n - shared) >= 0.8)"""


@query("d03_minhash", f"WITH {SIG} SELECT doc_id, array_to_string(s, ',') AS signature FROM sg")
def _(spark, d):
    return D.minhash(_docs(spark, d)).select("doc_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


# Signatures of representatives that share a band of four values, and whose values' last two bits agree often enough.
BANDS = f"""{SIG}, st AS (SELECT doc_id, md5(string_agg(shingle, chr(1) ORDER BY shingle)) AS t, count(*) AS n FROM sh GROUP BY 1), rp AS (SELECT min(doc_id) AS rep, any_value(n) AS n FROM st GROUP BY t),
 bd AS (SELECT rep, n, s, band, s[4 * band + 1 : 4 * band + 4] AS k FROM rp JOIN sg ON rep = doc_id, (SELECT unnest(range(32)) AS band))"""


@query("d04_lsh_candidates", f"WITH {BANDS} SELECT DISTINCT x.rep AS a, y.rep AS b FROM bd x JOIN bd y ON x.band = y.band AND x.k = y.k AND x.rep < y.rep AND x.n >= 0.8 * y.n AND y.n >= 0.8 * x.n WHERE len(list_filter(range(1, 129), lambda i: x.s[i] % 4 = y.s[i] % 4)) >= 84")
def _(spark, d):
    return D.near_candidates(D.signed(_docs(spark, d), digests=True), 0.8)


@query("d05_near_pairs", f"WITH {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM np")
def _(spark, d):
    return D.near_pairs(D.signed(_docs(spark, d)), 0.8).withColumn("similarity", F.round("similarity", 6))


# Documents in order, each kept unless an earlier kept one is similar: un (doc_id, rep, rn) is walked one by one.
FIRST = """sm2 AS (SELECT a, b FROM np UNION ALL SELECT b, a FROM np UNION ALL SELECT rep, rep FROM rp),
 nb AS (SELECT x.rn, x.doc_id, list(y.doc_id) FILTER (y.doc_id IS NOT NULL) AS l FROM un x LEFT JOIN (SELECT a, doc_id FROM sm2 JOIN un ON rep = b) y ON y.a = x.rep AND y.doc_id < x.doc_id GROUP BY 1, 2),
 g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT g.rn + 1, CASE WHEN l IS NULL OR NOT list_has_any(l, kept) THEN list_append(kept, doc_id) ELSE kept END FROM g JOIN nb ON nb.rn = g.rn + 1),
 kp AS (SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM g ORDER BY rn DESC LIMIT 1))"""


@query("d06_dedup_first", f"WITH RECURSIVE {PAIRS}, un AS (SELECT doc_id, rep, row_number() OVER (ORDER BY doc_id) AS rn FROM cl), {FIRST} SELECT doc_id, doc_id IN (SELECT doc_id FROM kp) AS kept FROM cl")
def _(spark, d):
    return D.dedup_near(_docs(spark, d), 0.8)


COMP = "wk AS (SELECT rep AS x, rep AS y FROM rp UNION SELECT w.x, CASE WHEN n.a = w.y THEN n.b ELSE n.a END FROM wk w JOIN np n ON w.y = n.a OR w.y = n.b), cm AS (SELECT x, min(y) AS c FROM wk GROUP BY 1)"


@query("d06_dedup_component", f"WITH RECURSIVE {PAIRS}, {COMP} SELECT doc_id, doc_id = rep AND c = rep AS kept FROM cl JOIN cm ON rep = x")
def _(spark, d):
    return D.dedup_near(_docs(spark, d), 0.8, mode="component")


_KNOWN = "SELECT c.doc_id FROM cl c JOIN (SELECT a, b FROM np UNION ALL SELECT b, a FROM np UNION ALL SELECT rep, rep FROM rp) ON c.rep = a JOIN cl h ON h.rep = b AND h.doc_id % 2 = 0"


@query("d07_dedup_against", f"WITH RECURSIVE {PAIRS}, un AS (SELECT doc_id, rep, row_number() OVER (ORDER BY doc_id) AS rn FROM cl WHERE doc_id % 2 = 1 AND doc_id NOT IN ({_KNOWN})), {FIRST} SELECT doc_id FROM kp")
def _(spark, d):
    sets = D.signed(_docs(spark, d))
    return D.dedup_against(sets.where("doc_id % 2 = 1"), sets.where("doc_id % 2 = 0"), 0.8)


@query("d08_dedup_stats", f"WITH RECURSIVE {PAIRS}, {COMP}, kp AS (SELECT doc_id, doc_id = rep AND c = rep AS kept FROM cl JOIN cm ON rep = x), f AS (SELECT min(doc_id) AS doc_id, true AS first FROM documents GROUP BY text) SELECT source, count(*) AS documents, count(*) FILTER (first IS NULL) AS exact, count(*) FILTER (first AND NOT kept) AS near, round(count(*) FILTER (first IS NULL OR NOT kept) / count(*), 6) AS share FROM documents LEFT JOIN f USING (doc_id) JOIN kp USING (doc_id) GROUP BY 1")
def _(spark, d):
    docs = _docs(spark, d)
    return D.dedup_stats(docs, D.dedup_near(docs, 0.8, mode="component"), "source").withColumn("share", F.round("share", 6))


# The table has no copies, so the threshold is one that some of its pairs reach.
CLOSE = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.4"


@query("d09_cosine_pairs", CLOSE)
def _(spark, d):
    return block_pairs(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.4)


@query("d09_dedup_cosine", f"""WITH RECURSIVE np AS ({CLOSE}), rp AS (SELECT vec_id AS rep FROM embeddings), un AS (SELECT vec_id AS doc_id, vec_id AS rep, row_number() OVER (ORDER BY vec_id) AS rn FROM embeddings), {FIRST}
 SELECT vec_id AS id, vec_id IN (SELECT doc_id FROM kp) AS kept FROM embeddings""")
def _(spark, d):
    return D.dedup_cosine(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.4)


@query("d10_dedup_records", f"WITH {PAPERS} SELECT min(paper_id) AS paper_id FROM pp GROUP BY title, substr(abstract, 1, 200)")
def _(spark, d):
    papers = _papers(spark, d)
    return D.dedup_exact(papers, E.record_key(F.col("title"), F.col("abstract")), "paper_id").select("paper_id")


@query("d10_dedup_titles", f"WITH {PAPERS} SELECT min(paper_id) AS paper_id FROM pp GROUP BY lower(trim(title))")
def _(spark, d):
    return D.dedup_exact(_papers(spark, d), D.title_key(F.col("title")), "paper_id").select("paper_id")


@query("c01_chunk_chars")
def _(spark, d):
    return C.chunk_chars(_docs(spark, d), 1000).select("doc_id", "nth", "chunk_id", F.length("content").alias("length"))


@query("c02_place_ids", "SELECT doc_id, sha256(source || ':' || doc_id) AS place_id FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", C.place_id(F.col("source"), F.col("doc_id")).alias("place_id"))


@query("c03_chunk_document")
def _(spark, d):
    return C.chunk_document(_docs(spark, d)).select("doc_id", "nth", "start", "chunk_id")


_MD_SPARK = "concat('intro', '\n', '## One', '\n', substr(text, 1, 200), '\n', '## Two', '\n', '### Deep', '\n', substr(text, 201), '\n')"


@query("c04_chunk_headings")
def _(spark, d):
    return C.chunk_headings(_docs(spark, d).select("doc_id", F.expr(_MD_SPARK).alias("text"))).select("doc_id", "nth", "chunk_id")


_ENT = "'# Q ' || doc_id || chr(10) || '- lang: ' || lang || chr(10) || '- src: ' || source || chr(10) || 'body' || chr(10) || '---' || chr(10) || '# R' || chr(10) || '- lang: x' || chr(10)"
_ENT_SPARK = "concat('# Q ', doc_id, '\n', '- lang: ', lang, '\n', '- src: ', source, '\n', 'body', '\n', '---', '\n', '# R', '\n', '- lang: x', '\n')"


@query("c05_parse_entries", "SELECT doc_id, 0 AS nth, 'Q ' || doc_id AS title, lang, source AS src FROM documents UNION ALL SELECT doc_id, 1, 'R', 'x', NULL FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(_ENT_SPARK).alias("text"))
    return C.parse_entries(docs).select("doc_id", "nth", "title", F.try_element_at("props", F.lit("lang")).alias("lang"), F.try_element_at("props", F.lit("src")).alias("src"))


_CODE_SPARK = '''concat('import os', '\n', 'class A', user_id % 5, '(Base', user_id % 3, '):', '\n', '    def run_', user_id % 7, '(self):', '\n', '        """Runs step ', event_id % 4, ' of the file."""', '\n', '        step_', event_id % 4, '(1)', '\n', 'def step_', event_id % 4, '():', '\n', '    return helper(2)', '\n', 'from pkg import thing', user_id % 2, '\n')'''


def _code(spark, d):
    return table(spark, d, "events").selectExpr("concat('f', user_id, '.py') AS file", f"{_CODE_SPARK} AS content")


@query("c06_chunk_code")
def _(spark, d):
    code = _code(spark, d).withColumnsRenamed({"content": "text"})
    return C.chunk_code(code, keep=("file",)).groupBy("file", "nth").agg(F.count(F.lit(1)).alias("chunks"), F.min("chunk_id").alias("first"))


@query("c07_parse_sections", rf"SELECT doc_id, CAST(n AS INTEGER) AS nth, t AS title, w AS why, CASE WHEN n = 1 THEN 'https://a.b/' || doc_id ELSE '' END AS links FROM (SELECT doc_id, unnest([1, 2]) AS n, unnest(['One', 'Two']) AS t, unnest(['because ' || lang, '']) AS w FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", "concat('x\n## One\n**Why**: because ', lang, '\nsee https://a.b/', doc_id, '\n## Two\nend') AS text")
    return C.parse_sections(docs, ["Why"]).select("doc_id", "nth", "title", "why", "links")


# Where a batch ends by where it begins, then a walk from batch to batch.
PACK = """t AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, tk, sum(tk) OVER (ORDER BY doc_id) AS p FROM (SELECT doc_id, greatest(1, length(text) // 4) AS tk FROM documents)),
 en AS (SELECT x.r, least((SELECT count(*) FROM t), greatest(x.r + 8, least(x.r + 32, (SELECT count(*) FROM t y WHERE y.p <= 2000 + x.p - x.tk)))) AS e FROM t x),
 g AS (SELECT CAST(0 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS b UNION ALL SELECT g.batch + 1, CAST(e AS BIGINT) FROM g JOIN en ON en.r = g.b WHERE e < (SELECT count(*) FROM t))"""


@query("c08_pack_batches", f"WITH RECURSIVE {PACK} SELECT doc_id, batch FROM t ASOF JOIN g ON t.r >= g.b")
def _(spark, d):
    return C.pack_batches(_docs(spark, d), 2000, 32)


@query("g01_entities", "WITH f AS (SELECT DISTINCT 'f' || user_id || '.py' AS file, user_id AS u, event_id % 4 AS s FROM events) SELECT kind, name, count(*) AS n, max(doc) AS doc FROM (SELECT file, 'function' AS kind, 'run_' || u % 7 AS name, max('Runs step ' || s || ' of the file.') AS doc FROM f GROUP BY 1, 2, 3 UNION SELECT file, 'function', 'step_' || s, '' FROM f UNION SELECT file, 'class', 'A' || u % 5, '' FROM f UNION SELECT file, 'import', 'thing' || u % 2, '' FROM f) GROUP BY 1, 2")
def _(spark, d):
    return G.entities(_code(spark, d)).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("doc"))


@query("g02_relations", """WITH f AS (SELECT DISTINCT 'f' || user_id || '.py' AS file, user_id AS u, event_id % 4 AS s FROM events)
 SELECT file || '::run_' || u % 7 AS src, '*::step_' || s AS dst, 'calls' AS type FROM f UNION SELECT file || '::step_' || s, '*::helper', 'calls' FROM f
 UNION SELECT file || '::A' || u % 5, '*::Base' || u % 3, 'inherits' FROM f UNION SELECT file, '*::thing' || u % 2, 'imports' FROM f""")
def _(spark, d):
    return G.relations(_code(spark, d))


EDGES = "ed AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _edges(spark, d):
    """Edges, some of them repeated: what reads them takes equal ones together."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


@query("g03_resolve", "SELECT 'f' || event_id AS src, CASE WHEN event_id % 3 = 0 THEN 'x::y' ELSE 'c' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') END AS dst FROM events WHERE event_id % 3 = 0 OR user_id % 10 < 7")
def _(spark, d):
    e = table(spark, d, "events")
    edges = e.selectExpr("concat('f', event_id) AS src", "CASE WHEN event_id % 3 = 0 THEN 'x::y' ELSE concat('*::n', user_id % 10) END AS dst")
    nodes = e.where("user_id % 10 < 7").selectExpr("concat('c', lpad(cast(user_id % 10 + 10 * (event_id % 3) as string), 2, '0')) AS id", "concat('n', user_id % 10) AS name").distinct()
    return G.resolve(edges, nodes)


@query("g04_neighbors", f"WITH {EDGES} SELECT src AS node, dst AS neighbor FROM ed WHERE src IN ('c5', 'c10', 'c25') UNION SELECT dst, src FROM ed WHERE dst IN ('p1', 'p2')")
def _(spark, d):
    nodes = spark.createDataFrame([(x,) for x in ("c5", "c10", "c25", "p1", "p2")], "node string")
    return G.neighbors(_edges(spark, d), nodes)


_ROUND = "SELECT q, n, sum(s) AS s FROM (SELECT q, dst AS n, s * 0.85 / deg AS s FROM r{0} JOIN lk ON n = src UNION ALL SELECT q, n, t * 0.15 FROM tp) GROUP BY 1, 2"
PPR = f"""{EDGES}, bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), lk AS (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM bo),
 tp AS (SELECT * FROM (VALUES (1, 'c5', 0.5), (1, 'c10', 0.5), (2, 'c25', 1.0)) v(q, n, t)), r0 AS (SELECT q, n, t AS s FROM tp), {", ".join(f"r{i} AS ({_ROUND.format(i - 1)})" for i in range(1, 21))}"""


@query("g05_ppr", f"WITH {PPR} SELECT q AS query_id, n AS node, round(s, 6) AS score FROM r20")
def _(spark, d):
    seeds = spark.createDataFrame([(1, "c5"), (1, "c10"), (2, "c25")], "query_id int, node string")
    return G.ppr(_edges(spark, d), seeds).withColumn("score", F.round("score", 6))


_LABEL = "SELECT n, min(c) AS c FROM (SELECT n, c FROM l{0} UNION ALL SELECT src, c FROM l{0} JOIN bo ON n = dst) GROUP BY 1"


@query("g06_components", f"WITH bo AS (SELECT user_id AS src, 1000 + event_id % 997 AS dst FROM events UNION SELECT 1000 + event_id % 997, user_id FROM events), l0 AS (SELECT DISTINCT src AS n, src AS c FROM bo), {', '.join(f'l{i} AS MATERIALIZED ({_LABEL.format(i - 1)})' for i in range(1, 17))} SELECT n AS node, c AS component FROM l16")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS src", "1000 + event_id % 997 AS dst")
    return G.connected_components(e)


_NAMES = "SELECT p_partkey AS id, p_name AS name, p_brand AS file FROM part"


@query("g07_seeds", f"WITH n AS ({_NAMES}), w AS (SELECT p_partkey AS query_id, unnest(list_distinct(regexp_extract_all(lower(p_name), '\\w{{3,}}'))) AS w FROM part) SELECT DISTINCT query_id, id AS node FROM w JOIN n ON contains(lower(name), w)")
def _(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return G.seeds(q, table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name"))


@query("g08_callers", "SELECT DISTINCT 'f' || user_id AS src FROM events WHERE event_type = 'click' AND event_id % 5 = 2")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("concat('f', user_id) AS src", "concat('m::fn', event_id % 5) AS dst", "CASE WHEN event_type = 'click' THEN 'calls' ELSE 'imports' END AS type")
    return G.callers(e, "fn2")


@query("g09_blast_radius", "WITH RECURSIVE e AS (SELECT DISTINCT user_id AS src, event_id % 150 AS dst FROM events), r AS (SELECT 7 AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 3) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS src", "event_id % 150 AS dst").distinct()
    return G.blast_radius(e, spark.createDataFrame([(7,)], "node long"), 3)


@query("g09_file_blast_radius", """WITH RECURSIVE nd AS (SELECT DISTINCT user_id AS id, user_id % 40 AS file FROM events), e AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM events JOIN nd a ON a.id = user_id JOIN nd b ON b.id = event_id % 23 WHERE a.file <> b.file),
 r AS (SELECT CAST(5 AS BIGINT) AS node, 0 AS depth UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 2) SELECT node AS file, CAST(min(depth) AS INTEGER) AS depth, (SELECT count(*) FROM nd WHERE nd.file = node) AS nodes FROM r WHERE node <> 5 GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS src", "event_id % 23 AS dst")
    nodes = table(spark, d, "events").selectExpr("user_id AS id", "user_id % 40 AS file").distinct()
    return G.file_blast_radius(e, nodes, spark.createDataFrame([(5,)], "file long"), 2)


@query("g10_structural_context", f"WITH n AS ({_NAMES}), w AS (SELECT p_partkey AS query_id, unnest(list_distinct(regexp_extract_all(lower(p_name), '\\w{{3,}}'))) AS w FROM part), h AS (SELECT query_id, file, min(id) AS node FROM w JOIN n ON contains(lower(name), w) GROUP BY 1, 2) SELECT query_id, file, node, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file) AS place FROM h) WHERE place <= 3")
def _(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    return G.structural_context(q, table(spark, d, "part").selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS file"), 3)


# Brands stand for files, types for docs.
@query("g10_structural_docs", "WITH n AS (SELECT p_partkey AS id, lower(p_name || chr(10) || p_type) AS t, p_brand AS file FROM part), w AS (SELECT p_partkey AS query_id, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || split_part(p_type, ' ', 1)), '\\w{3,}'))) AS w FROM part), h AS (SELECT query_id, file, min(id) AS node FROM w JOIN n ON contains(t, w) GROUP BY 1, 2) SELECT query_id, file, node, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file) AS place FROM h) WHERE place <= 3")
def _(spark, d):
    part = table(spark, d, "part")
    q = part.selectExpr("p_partkey AS query_id", "concat(p_name, ' ', split_part(p_type, ' ', 1)) AS query")
    return G.structural_context(q, part.selectExpr("p_partkey AS id", "p_name AS name", "p_brand AS file", "p_type AS doc"), 3)


@query("g11_graph_stats", "SELECT 'node:' || p_brand AS what, count(*) AS n, count(DISTINCT p_type) AS files FROM part GROUP BY 1 UNION ALL SELECT 'edge:' || event_type, count(*), 0 FROM events GROUP BY 1")
def _(spark, d):
    return G.graph_stats(table(spark, d, "part").selectExpr("p_brand AS kind", "p_type AS file"), table(spark, d, "events").selectExpr("event_type AS type"))


_KW = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]{{2,}}'), lambda w: NOT list_contains({strings(T.CLAIM_STOP_WORDS)}, w) AND length(w) > 6)"


@query("g12_see_also", f"WITH k AS (SELECT DISTINCT doc_id AS article, unnest({_KW}) AS w FROM documents), p AS (SELECT x.article AS a, y.article AS b, count(*) AS common FROM k x JOIN k y ON x.w = y.w AND x.article <> y.article GROUP BY 1, 2 HAVING count(*) >= 2) SELECT a, b, common, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY common DESC, b) AS place FROM p) WHERE place <= 5")
def _(spark, d):
    words = F.filter(T.topic_terms(F.col("text")), lambda w: ~w.isin(*T.CLAIM_STOP_WORDS) & (F.length(w) > 6))
    return G.see_also(_docs(spark, d).select(F.col("doc_id").alias("article"), F.explode(words).alias("keyword")))


@query("g13_related", "SELECT x.n AS a, y.n AS b, count(*) AS common FROM (SELECT DISTINCT c_nationkey AS n, o_orderdate AS f FROM orders JOIN customer ON o_custkey = c_custkey) x JOIN (SELECT DISTINCT c_nationkey AS n, o_orderdate AS f FROM orders JOIN customer ON o_custkey = c_custkey) y ON x.f = y.f AND x.n < y.n GROUP BY 1, 2")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return G.related(o.select(F.col("c_nationkey").alias("site"), F.col("o_orderdate").alias("file")))
