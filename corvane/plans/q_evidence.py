"""Personal data, and scores of publication records made of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import pii as P
from corvane.operators import evidence as E
from corvane.plans.catalog import query, table
from corvane.plans.q_metrics import r6
from corvane.plans.q_text import any_hit, collapse, strings, sum_hits

YEAR = 2026


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PLAIN = "string_split(coalesce(text, ''), chr(10))"


def _family_sql(name: str) -> str:
    pattern = next(p for t, n, p, g in P.FAMILIES if n == name)
    test = {
        "email": f"NOT list_contains({strings(P.SAFE_DOMAINS)}, lower(regexp_extract(v, '@([^@]*)$', 1)))",
        "ipv4": f"regexp_matches(v, {lit(P.OCTETS)}) AND NOT regexp_matches(v, {lit(P.PRIVATE_IP)})",
    }.get(name, "true")
    return f"""SELECT doc_id, '{next(t for t, n, p, g in P.FAMILIES if n == name)}' AS type, CAST(line AS INTEGER) AS line, '{name}' AS pattern_name FROM l WHERE len(list_filter(regexp_extract_all(s, {lit(pattern)}, 1), lambda v: {test})) > 0"""


_NAMES = ("jwt", "aws_access_key", "github_token", "slack_token", "bearer_token", "generic_key", "hex_secret", "password_assign", "basic_auth_url", "email", "ipv4", "windows_home_path", "unix_home_path")
FINDINGS = f"""l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS line, regexp_replace(unnest(x), {lit(P.HARMLESS)}, ' ', 'g') AS s FROM (SELECT doc_id, {_PLAIN} AS x FROM documents)),
fd AS ({" UNION ALL ".join(_family_sql(n) for n in _NAMES)})"""


@query("p09_pii_findings", f"WITH {FINDINGS} SELECT * FROM fd")
def _(spark, d):
    return P.findings(table(spark, d, "documents")).where(~F.col("pattern_name").isin("high_entropy", "private_key_block")).select("doc_id", "type", "line", "pattern_name")


@query("f02_custom_patterns", f"WITH {FINDINGS}, p AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS w FROM benchmark) SELECT doc_id, 'custom_' || item_id AS pattern_name, count(*) AS lines FROM l JOIN p ON contains(s, w) GROUP BY 1, 2")
def _(spark, d):
    patterns = table(spark, d, "benchmark").selectExpr("cast(item_id as string) AS name", r"concat('\\Q', substring_index(text, ' ', 4), '\\E') AS pattern", "'[ITEM]' AS tag")
    found = P.findings(table(spark, d, "documents"), custom=P.custom_patterns(patterns)).where(F.col("pattern_name").startswith("custom_"))
    return found.groupBy("doc_id", "pattern_name").agg(F.count(F.lit(1)).alias("lines"))


@query("p10_redact")
def _(spark, d):
    text = P.redact(F.col("text"))
    tags = {f"n_{k}": F.regexp_count(F.col("t"), F.lit(v.replace("[", r"\[").replace("]", r"\]"))) for k, v in P.TAGS.items()}
    return table(spark, d, "documents").select("doc_id", text.alias("t")).select("doc_id", *[v.alias(k) for k, v in tags.items()], F.length("t").alias("length"))


@query(
    "p11_entropy",
    "SELECT p_partkey, round(-list_sum(list_transform(list_distinct(c), lambda x: len(list_filter(c, lambda y: y = x)) / len(c) * log2(len(list_filter(c, lambda y: y = x)) / len(c)))), 6) AS bits FROM (SELECT p_partkey, string_split(p_name, '') AS c FROM part)",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(P.entropy(F.col("p_name")), 6).alias("bits"))


@query("p12_is_clean", f"WITH {FINDINGS} SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM fd) AS clean FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = P.findings(docs).where(~F.col("pattern_name").isin("high_entropy", "private_key_block"))
    return P.is_clean(docs.select("doc_id"), found)


@query("a03_pii_rate", f"WITH {FINDINGS} SELECT source, count(*) AS documents, count(*) FILTER (dirty) AS dirty, round(count(*) FILTER (dirty) / count(*), 6) AS share, count(*) FILTER (dirty) / count(*) > 0.05 AS full_scan FROM (SELECT source, doc_id IN (SELECT doc_id FROM fd) AS dirty FROM documents) GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents")
    found = P.findings(docs).where(~F.col("pattern_name").isin("high_entropy", "private_key_block"))
    return r6(P.pii_rate(found, docs, "source"), "share")


_LIGHT = "text"
for _p in ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "https?://\\S+", "www\\.\\S+"):
    _LIGHT = f"regexp_replace({_LIGHT}, '{_p}', ' ', 'g')"


@query("p08_strip_pii", f"SELECT doc_id, {collapse(_LIGHT)} AS plain FROM documents WHERE NOT regexp_matches(text, '(^|\\W)@\\w|\\bby\\s+[A-Z]|(?i)\\bsigned[, ]')")
def _(spark, d):
    docs = table(spark, d, "documents").where(~F.col("text").rlike(r"(^|\W)@\w|\bby\s+[A-Z]|(?i)\bsigned[, ]"))
    return docs.select("doc_id", P.strip_light(F.col("text")).alias("s")).select("doc_id", F.col("s.text").alias("plain"))


_SOURCES = ["arxiv", "github", "reddit", "unknown", "semantic_scholar", "hacker_news", "openreview"]
_URLS = ["https://arxiv.org/x", "https://github.com/x", "https://a.edu/blog", "", "https://medium.com/q"]
_TITLES = ["a novel survey of rag", "sota benchmark", "plain title", "self-improving framework"]


def pick(values, key):
    return f"{strings(values)}[CAST({key} AS INTEGER) + 1]"


PAPERS = f"""pp AS (SELECT doc_id AS paper_id, {pick(_TITLES, "doc_id % 4")} || ' ' || substr(text, 1, 20) AS title, text AS abstract, {pick(["2026", "2024", "x", "2021", "NaN", "2025"], "doc_id % 6")} AS year,
 CASE WHEN doc_id % 9 = 0 THEN 'Infinity' ELSE CAST(doc_id * 7 % 1500 AS VARCHAR) END AS citation_count, {pick(_SOURCES, "doc_id % 7")} AS source, {pick(_URLS, "doc_id % 5")} AS url, doc_id % 2 = 0 AS has_refs, doc_id % 3 = 0 AS has_code, doc_id % 4 = 0 AS peer_reviewed FROM documents),
 pc AS (SELECT *, CASE year WHEN 'x' THEN 0 WHEN 'NaN' THEN 0 ELSE CAST(try_cast(year AS DOUBLE) AS BIGINT) END AS y, CASE WHEN citation_count = 'Infinity' THEN 0 ELSE CAST(try_cast(citation_count AS DOUBLE) AS BIGINT) END AS c FROM pp)"""


def _papers(spark, d):
    arr = lambda v, k: f"element_at(array({', '.join(repr(x) for x in v)}), cast({k} as int) + 1)"
    return table(spark, d, "documents").selectExpr(
        "doc_id AS paper_id", f"concat({arr(_TITLES, 'doc_id % 4')}, ' ', substr(text, 1, 20)) AS title", "text AS abstract", f"{arr(['2026', '2024', 'x', '2021', 'NaN', '2025'], 'doc_id % 6')} AS year",
        "CASE WHEN doc_id % 9 = 0 THEN 'Infinity' ELSE cast(doc_id * 7 % 1500 as string) END AS citation_count", f"{arr(_SOURCES, 'doc_id % 7')} AS source", f"{arr(_URLS, 'doc_id % 5')} AS url",
        "doc_id % 2 = 0 AS has_refs", "doc_id % 3 = 0 AS has_code", "doc_id % 4 = 0 AS peer_reviewed",
    )


def tier(tiers, default, x):
    return f"coalesce(map {{{', '.join(f'{chr(39)}{k}{chr(39)}: {v}' for k, v in tiers.items())}}}[{x}], {default})"


_ASK = "the novel rag with that"
_DW = "list_distinct(regexp_extract_all(lower(title || ' ' || abstract), '\\w+'))"
_AW = "list_distinct(regexp_extract_all('the novel rag with that', '\\w+'))"
CRED = f"""cr AS (SELECT *, CASE WHEN {YEAR} - y <= 0 THEN 1.0 WHEN {YEAR} - y = 1 THEN 0.85 WHEN {YEAR} - y = 2 THEN 0.7 WHEN {YEAR} - y = 3 THEN 0.5 WHEN {YEAR} - y = 4 THEN 0.3 ELSE 0.1 END AS currency,
 CAST(len(list_intersect({_AW}, {_DW})) AS DOUBLE) / len({_AW}) AS relevance, least(1.0, {tier(E.SOURCE_TIERS, 0.4, "lower(source)")} + least(0.3, greatest(0, c) / 1000) + CASE WHEN contains(url, '.edu') OR contains(url, '.gov') THEN 0.1 WHEN contains(url, '.org') THEN 0.05 ELSE 0 END) AS authority,
 0.3 + CAST(has_refs AS INTEGER) * 0.3 + CAST(has_code AS INTEGER) * 0.2 + CAST(peer_reviewed AS INTEGER) * 0.2 AS accuracy,
 CASE WHEN {any_hit("url", E.ACADEMIC_URLS)} THEN 0.9 WHEN {any_hit("url", E.CODE_URLS)} THEN 0.7 WHEN {any_hit("url", E.OPINION_URLS)} THEN 0.4 ELSE 0.5 END AS purpose FROM pc),
 cs AS (SELECT *, round(least(1.0, 0.15 * currency + 0.3 * relevance + 0.2 * authority + 0.2 * accuracy + 0.15 * purpose), 4) AS composite FROM cr)"""


@query("a29_credibility", f"WITH {PAPERS}, {CRED} SELECT paper_id, round(relevance, 4) AS relevance, round(authority, 4) AS authority, CAST(round(accuracy, 4) AS DOUBLE) AS accuracy, CAST(round(purpose, 4) AS DOUBLE) AS purpose, CAST(round(currency, 4) AS DOUBLE) AS currency, composite FROM cs")
def _(spark, d):
    return _papers(spark, d).select("paper_id", E.credibility(F.lit(_ASK), YEAR).alias("s")).select("paper_id", "s.*")


_BOTH = "lower(title) || ' ' || lower(substr(abstract, 1, 300))"
_W3 = "list_distinct(regexp_extract_all({0}, '\\w{3,}'))"
SAT = f"""sa AS (SELECT *, least(1.0, greatest(0.0, 0.25 - greatest(0, {YEAR} - CASE WHEN y = 0 THEN 2020 ELSE y END) * 0.06) + {tier(E.TRIAGE_TIERS, 0.5, "source")} * 0.20
 + least(0.20, len(list_intersect({_W3.replace("{0}", "lower(title)")}, {strings(E.SIGNAL_WORDS)})) * 0.07) + least(0.10, {sum_hits(_BOTH, E.METHOD_WORDS)} * 0.04)
 + CAST(len(list_intersect({_W3.replace("{0}", f"'{_ASK}'")}, {_W3.replace("{0}", _BOTH)})) AS DOUBLE) / len({_W3.replace("{0}", f"'{_ASK}'")}) * 0.15 + CASE WHEN c > 0 THEN least(0.10, c / 500 * 0.10) ELSE 0 END) AS satellite FROM pc)"""


@query("a30_triage", f"WITH {PAPERS}, {SAT}, b AS (SELECT paper_id FROM sa WHERE satellite >= 0.5 ORDER BY round(satellite, 9) DESC, paper_id LIMIT 5) SELECT paper_id, round(satellite, 6) AS satellite, satellite >= 0.3 AS satellite_pass, satellite >= 0.5 AS drone_pass, paper_id IN (SELECT paper_id FROM b) AS deep_dive FROM sa")
def _(spark, d):
    return r6(E.triage(_papers(spark, d), F.lit(_ASK), YEAR).select("paper_id", "satellite", "satellite_pass", "drone_pass", "deep_dive"), "satellite")


_KEY = "substr(sha256(title || ':' || substr(abstract, 1, 200)), 1, 16)"
_NW = " + ".join(f"CASE WHEN contains(lower(title || ' ' || abstract), '{k}') THEN {v} ELSE 0 END" for k, v in E.NOVELTY_WEIGHTS.items())


@query(
    "a31_novelty",
    f"""WITH {PAPERS}, k AS (SELECT *, {_KEY} AS key FROM pc), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY paper_id) AS nth, key IN (SELECT key FROM k WHERE paper_id % 10 = 0) AS known FROM k)
    SELECT paper_id, key, round(CASE WHEN known OR nth > 1 THEN 0 ELSE least(1.0, greatest(0.0, 0.3 - greatest(0, {YEAR} - y) * 0.1) + least(0.4, {_NW}) + CASE WHEN y >= {YEAR - 1} AND c > 0 THEN least(0.2, c / greatest(1, ({YEAR} - y) * 12 + 6) * 0.02) WHEN c > 50 THEN 0.1 ELSE 0 END
    + CASE WHEN {any_hit("lower(title)", E.TITLE_WORDS)} THEN 0.05 ELSE 0 END) END, 6) AS novelty FROM n""",
)
def _(spark, d):
    papers = _papers(spark, d)
    known = papers.where("paper_id % 10 = 0").select(E.record_key(F.col("title"), F.col("abstract")).alias("key"))
    return r6(E.novelty(papers, known, YEAR), "novelty")


WEIGH = f"""wr AS (SELECT paper_id, paper_id % 40 AS claim, composite, relevance, composite * greatest(0.1, 1.0 - ({YEAR} - CASE WHEN y = 0 THEN {YEAR} ELSE y END) * 0.15) * least(1.5, 1.0 + greatest(0, c) / 500) AS raw FROM cs),
 we AS (SELECT *, raw / sum(raw) OVER (PARTITION BY claim) AS weight FROM wr)"""


def _weighed(spark, d):
    papers = _papers(spark, d).withColumn("s", E.credibility(F.lit(_ASK), YEAR)).select("*", "s.composite", "s.relevance").withColumn("claim", F.col("paper_id") % 40)
    return E.weigh(papers, YEAR)


@query("a32_weigh", f"WITH {PAPERS}, {CRED}, {WEIGH} SELECT paper_id, claim, round(weight, 6) AS weight FROM we")
def _(spark, d):
    return r6(_weighed(spark, d).select("paper_id", "claim", "weight"), "weight")


@query("a32_summary", f"WITH {PAPERS}, {CRED}, {WEIGH}, x AS (SELECT claim, sum(weight * composite) AS confidence, avg(CAST(relevance > 0.5 AS INTEGER)) AS agreement FROM we GROUP BY 1) SELECT count(*) AS claims, round(avg(confidence), 6) AS confidence, count(*) FILTER (confidence > 0.7) AS high, count(*) FILTER (agreement < 0.6) AS contested FROM x")
def _(spark, d):
    return r6(E.evidence_summary(E.weighted_claims(_weighed(spark, d))), "confidence")
