"""Queries over comments, manuals, settings, languages and code graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import docs as X
from corvane.operators import graph as G
from corvane.plans.catalog import query, table
from corvane.plans.q_corpus import EDGES, _edges
from corvane.plans.q_text import strings
from corvane.sources import files as S


def _hits(lang: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains({strings(X.FREQUENT[lang])}, x)))"


@query(
    "p14_english",
    f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents), h AS (SELECT doc_id, text, greatest({_hits("de")}, {_hits("fr")}, {_hits("es")}) AS o, {" + ".join(_hits(g) for g in X.FREQUENT)} AS t FROM w)
    SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN false ELSE coalesce(o / nullif(t, 0) < 0.8, true) END AS english FROM h""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.english_or_unknown(F.col("text")).alias("english"))


_CODE = "concat('x = 1  # note ', p_partkey, '\n// see ', p_brand, '\ndef f', p_size, '():\n    \"\"\"About ', p_type, '.\"\"\"\n/* end */')"


@query("p18_comments", "SELECT p_partkey, 'see ' || replace(p_brand, '#', ' ') || '|note ' || p_partkey || '|end|About ' || p_type || '.' AS comments FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.comments(F.expr(_CODE)), "|").alias("comments"))


@query("p30_config_features", "SELECT event_id, 'k' AS feature, CAST(json_extract(props, '$.k') AS DOUBLE) AS value FROM events")
def _(spark, d):
    return X.config_features(table(spark, d, "events"), "event_id", "props")


@query("p31_match_sites", "SELECT p_partkey || '/' || p_brand AS path, s AS site FROM part, (VALUES ('north', 'brand#1'), ('south', 'brand#.2'), ('all', '/')) v(s, p) WHERE regexp_matches(lower(p_partkey || '/' || p_brand), p)")
def _(spark, d):
    files = table(spark, d, "part").select(F.concat("p_partkey", F.lit("/"), "p_brand").alias("path"))
    return S.match_sites(files, [("north", "brand#1"), ("south", "brand#.2"), ("all", "/")])


_MAN = "concat('Title ', doc_id, '\n=====\n1.2. Part\ntext\nAuthor  [Page 3]\nSub\n---\n', source)"


@query("p35_text_to_markdown", "SELECT doc_id, '# Title ' || doc_id || chr(10) || '### 1.2. Part' || chr(10) || 'text' || chr(10) || '## Sub' || chr(10) || source AS markdown FROM documents")
def _(spark, d):
    return X.text_to_markdown(table(spark, d, "documents").select("doc_id", F.expr(_MAN).alias("text")), "doc_id")


_WALK = "SELECT q, n, sum(s) AS s FROM (SELECT q, dst AS n, s * 0.85 / deg AS s FROM w{0} JOIN lk ON n = src UNION ALL SELECT q, n, t * 0.15 FROM tp) GROUP BY 1, 2"


# Each nation asks for its number in three digits, which some customers' names hold.
@query(
    "r18_graph_search",
    f"""WITH {EDGES}, bo AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), lk AS (SELECT *, count(*) OVER (PARTITION BY src) AS deg FROM bo),
    tp AS (SELECT n_nationkey AS q, 'c' || c_custkey AS n, 1.0 / count(*) OVER (PARTITION BY n_nationkey) AS t FROM nation JOIN customer ON contains(lower(c_name), lpad(CAST(n_nationkey AS VARCHAR), 3, '0'))),
    w0 AS (SELECT q, n, t AS s FROM tp), {", ".join(f"w{i} AS MATERIALIZED ({_WALK.format(i - 1)})" for i in range(1, 21))},
    best AS (SELECT q, n, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, n) AS rank FROM w20)
    SELECT q AS query_id, n AS node, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 10""",
)
def _(spark, d):
    from corvane.operators.joins import top_k

    nodes = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("query"))
    scores = G.ppr(_edges(spark, d), G.seeds(asked, nodes))
    return top_k(scores, ["query_id"], [F.round("score", 9).desc(), F.col("node")], 10, "rank").select("query_id", "node", F.round("score", 6).alias("score"), "rank")
