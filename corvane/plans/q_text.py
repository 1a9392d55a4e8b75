"""Queries over row-local text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.catalog import query, table

NORM = r"lower(regexp_replace(regexp_replace(regexp_replace({0}, '[_\-./\\:]', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'))"
WORDS = r"regexp_extract_all({0}, '\S+')"


def norm(x: str) -> str:
    return NORM.replace("{0}", x)


def terms(x: str) -> str:
    return rf"regexp_extract_all({norm(x)}, '[\p{{L}}\p{{N}}]+')"


def unescape(x: str) -> str:
    for a, b in T.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def strings(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sum_hits(x: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, '{p.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for p in phrases) + ")"


def any_hit(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in phrases) + ")"


def clamp(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


@query("p01_normalize_search", f"SELECT doc_id, {norm('text')} AS search_text FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_search(F.col("text")).alias("search_text"))


@query("p02_terms", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms FROM (SELECT doc_id, {terms('text')} AS t FROM documents)")
def _(spark, d):
    t = T.terms(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.array_join(t, " ").alias("terms"))


@query("p03_strip_html", f"SELECT page_id, {collapse('regexp_replace(' + unescape('html') + chr(44) + ' ' + chr(39) + '<[^>]+>' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS plain FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


_BARE = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>', '', 'g')"
_LINES = f"list_filter(list_transform(string_split({unescape(f'regexp_replace({_BARE}, {chr(39)}<[^>]+>{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')}, chr(10)), lambda x: {collapse('x')}), lambda x: x <> '')"


@query("p04_page_text", f"SELECT page_id, CASE WHEN length(t) > 50000 THEN substr(t, 1, 50000) || chr(10) || '... [truncated]' ELSE t END AS body FROM (SELECT page_id, array_to_string({_LINES}, chr(10)) AS t FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_text(F.col("html"), 50_000).alias("body"))


_MARKUP = collapse("regexp_replace(" + unescape(r"regexp_replace(regexp_replace(text, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '<[^>]+>', ' ', 'g')") + ", '[*_~>#-]+', ' ', 'g')")


@query("p05_strip_markup", f"SELECT doc_id, {_MARKUP} AS plain FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.strip_markup(F.col("text")).alias("plain"))


_MD = r"'# ' || role || chr(10) || 'x `' || substr(text, 1, 20) || '` y' || chr(10) || '```Py' || chr(10) || text || '```' || ' <code>' || substr(text, 5, 30) || '</code>'"
_MD_SPARK = "concat('# ', role, '\n', 'x `', substr(text, 1, 20), '` y', '\n', '```Py', '\n', text, '```', ' <code>', substr(text, 5, 30), '</code>')"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _blocks_sql() -> str:
    fence = r"'(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```'"
    trimmed = lambda x: _TRIM.replace("{0}", x)
    fenced = f"list_transform(list_zip(regexp_extract_all(m, {fence}, 1), regexp_extract_all(m, {fence}, 2)), lambda z: lower(trim(z[1])) || '|' || {trimmed('z[2]')})"
    tagged = rf"list_transform(regexp_extract_all(m, '(?is)<code>(.*?)</code>', 1), lambda c: '|' || {trimmed(unescape('c'))})"
    inline = rf"list_transform(regexp_extract_all(m, '`([^`\n]{{3,}})`', 1), lambda c: '|' || {trimmed('c')})"
    every = f"list_filter({fenced} || {tagged} || {inline}, lambda b: NOT ends_with(b, '|'))"
    return f"""SELECT conv_id, turn, CAST(unnest(range(1, len(b) + 1)) AS INTEGER) AS nth, unnest(b) AS block FROM (
      SELECT conv_id, turn, list_filter(e, lambda x, i: list_position(e, x) = i) AS b FROM (SELECT conv_id, turn, {every} AS e FROM (SELECT conv_id, turn, {_MD} AS m FROM conversations)))"""


@query("p06_code_blocks", _blocks_sql())
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_MD_SPARK).alias("m"))
    blocks = rows.select("conv_id", "turn", F.posexplode(T.code_blocks(F.col("m"))).alias("i", "b"))
    return blocks.select("conv_id", "turn", (F.col("i") + 1).alias("nth"), F.concat("b.lang", F.lit("|"), "b.code").alias("block"))


@query("p07_strip_code", rf"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace({_MD}, '(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```', ' ', 'g'), '(?is)<code>(.*?)</code>', ' ', 'g'), '`([^`\n]{{3,}})`', ' ', 'g') AS plain FROM conversations")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.strip_code(F.expr(_MD_SPARK)).alias("plain"))


_PATHS = "'/data/' || source || '/f' || doc_id || ['.py', '.md', '.rs', '.tsx', '', '.JS'][CAST(doc_id % 6 AS INTEGER) + 1]"
_PATHS_SPARK = "concat('/data/', source, '/f', doc_id, element_at(array('.py', '.md', '.rs', '.tsx', '', '.JS'), cast(doc_id % 6 as int) + 1))"
_TAGS = "'<' || ['regex', 'C++', 'JS', 'misc'][CAST(doc_id % 4 AS INTEGER) + 1] || '><' || ['python', 'go', 'none'][CAST(doc_id % 3 AS INTEGER) + 1] || '>'"
_TAGS_SPARK = "concat('<', element_at(array('regex', 'C++', 'JS', 'misc'), cast(doc_id % 4 as int) + 1), '><', element_at(array('python', 'go', 'none'), cast(doc_id % 3 as int) + 1), '>')"
_EXT = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGE_OF_EXTENSION.items()) + "}"
_ALIAS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGE_ALIASES.items()) + "}"


@query(
    "p13_code_language",
    f"""SELECT doc_id, {_EXT}[lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1))] AS path_language,
    coalesce(list_filter(list_transform(regexp_extract_all(t, '<([^>]+)>', 1), lambda x: coalesce({_ALIAS}[lower(trim(x))], lower(trim(x)))), lambda x: list_contains({strings(T.LANGUAGE_TAGS)}, x))[1], 'unknown') AS tag_language
    FROM (SELECT doc_id, {_PATHS} AS p, {_TAGS} AS t FROM documents)""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.lang_from_path(F.expr(_PATHS_SPARK)).alias("path_language"), T.lang_from_tags(F.expr(_TAGS_SPARK)).alias("tag_language"))


_CODE = "|".join(T.CODE_LINE)


@query(
    "p15_content_type",
    f"""SELECT page_id, CASE WHEN share >= 0.3 THEN 'code' ELSE 'text' END AS content_type, round(share, 6) AS share FROM (
    SELECT page_id, len(list_filter(l, lambda x: regexp_matches(x, '{_CODE}'))) / nullif(len(l), 0) AS share FROM (
    SELECT page_id, list_filter(string_split(html, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM pages))""",
)
def _(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", T.content_type(html).alias("content_type"), F.round(T.code_share(html), 6).alias("share"))


@query(
    "p16_quality_score",
    rf"""SELECT doc_id, CAST(regexp_matches(text, '(?s)\x22\x22\x22.*?\x22\x22\x22|\x27\x27\x27.*?\x27\x27\x27|^\s*#\s+\S') AS INTEGER) + CAST(regexp_matches(text, '\bdef\s+\w+|class\s+\w+') AS INTEGER)
    + CAST(length(text) BETWEEN 50 AND 2000 AS INTEGER) + CAST({any_hit('lower(source)', T.CURATED_SOURCES)} AS INTEGER)
    + CAST(regexp_matches(text, '\bimport\s+\w+|:\s*(int|str|float|bool|list|dict|Optional)') AS INTEGER) AS quality FROM documents""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.quality_score(F.col("text"), F.col("source")).alias("quality"))


@query("p17_gate", "SELECT doc_id, lang, n_chars FROM documents WHERE length(text) BETWEEN 50 AND 100000 AND length(text) - length(replace(text, chr(10), '')) >= 3 AND lang IN ('en', 'de')")
def _(spark, d):
    return table(spark, d, "documents").where(T.gate(F.col("text")) & F.col("lang").isin("en", "de")).select("doc_id", "lang", "n_chars")


@query("p19_render", "SELECT p_partkey, 'Question: ' || p_name || chr(10) || chr(10) || 'Type: ' || p_type || chr(10) || chr(10) || 'Answer: ' || p_brand AS rendered FROM part WHERE length('Question: ' || p_name || chr(10) || chr(10) || 'Type: ' || p_type || chr(10) || chr(10) || 'Answer: ' || p_brand) >= 30")
def _(spark, d):
    from corvane.functions.records import render

    text = render([("Question", "p_name", None), ("Type", "p_type", None), ("Answer", "p_brand", None)])
    return table(spark, d, "part").select("p_partkey", text.alias("rendered")).where(F.length("rendered") >= 30)


@query(
    "p20_flatten_turns",
    "SELECT conv_id, count(*) AS n_turns, string_agg(CASE role WHEN 'assistant' THEN 'Assistant: ' WHEN 'user' THEN 'Human: ' ELSE 'System: ' END || text, chr(10) || chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id",
)
def _(spark, d):
    from corvane.functions.records import flatten_turns

    return flatten_turns(table(spark, d, "conversations"))


@query("p21_est_tokens", "SELECT source, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS est_tokens FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(T.est_tokens(F.col("text"))).alias("est_tokens"))


_ART = r"'# Title ' || doc_id || chr(10) || chr(10) || text || chr(10) || '## Part' || chr(10) || 'end'"
_ART_SPARK = "concat('# Title ', doc_id, '\n', '\n', text, '\n', '## Part', '\n', 'end')"


@query(
    "p22_headings_summary",
    rf"""SELECT doc_id, array_to_string(list_transform(list_filter(string_split(a, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}}\s+\S')), lambda x: length(regexp_extract(x, '^(#+)', 1)) || ':' || trim(regexp_replace(x, '^#+\s+', ''))), '|') AS headings,
    substr(coalesce(list_filter(list_transform(regexp_split_to_array(a, '\n\s*\n'), lambda x: {collapse('x')}), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], ''), 1, 250) AS summary,
    regexp_replace(regexp_replace(lower(source || '_Doc ' || doc_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT doc_id, source, {_ART} AS a FROM documents)""",
)
def _(spark, d):
    a = F.expr(_ART_SPARK)
    heads = F.array_join(F.transform(T.headings(a), lambda h: F.concat(h["level"].cast("string"), F.lit(":"), h["title"])), "|")
    return table(spark, d, "documents").select("doc_id", heads.alias("headings"), T.summary(a).alias("summary"), T.slug(F.concat("source", F.lit("_Doc "), "doc_id")).alias("slug"))


@query(
    "p23_keywords",
    f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: length(w) > 2 AND NOT list_contains({strings(T.STOP_WORDS)}, w)))), ' ') AS keywords FROM conversations",
)
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


_QT = "CASE " + " ".join(f"WHEN {any_hit('l', p)} THEN '{n}'" for n, p in T.QUERY_TYPES) + " ELSE 'explain' END"


@query(
    "p24_classify_query",
    rf"""SELECT item_id, {_QT} AS query_type, round(least(1.0, {clamp('(n - 5) / 40.0')} + {sum_hits('l', T.COMPLEX_WORDS)} * 0.15), 6) AS complexity,
    CASE WHEN n <= 8 THEN 'short' WHEN n <= 25 THEN 'medium' ELSE 'long' END AS length_bucket, regexp_matches(text, '[a-zA-Z_]\w*\.\w+|def\s+\w+|class\s+\w+|```') AS has_code,
    regexp_matches(l, '\band\b|\balso\b|,.*\?') AS multi_part FROM (SELECT item_id, text, lower(text) AS l, len({WORDS.replace("{0}", "text")}) AS n FROM benchmark)""",
)
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", T.classify_query(F.col("text")).alias("c")).select("item_id", "c.*")
    return rows.withColumn("complexity", F.round("complexity", 6))


#: A project's own intents, besides the default ones.
_INTENTS = (*T.INTENTS, (("license", "terms"), ((r"license\.txt$", 0.35),)))


def _boost_sql(q: str, p: str) -> str:
    parts = ["0.0"]
    for names, rules in _INTENTS:
        for rule, value in rules:
            parts.append(f"CASE WHEN list_has_any(regexp_split_to_array({norm(q)}, '\\s+'), {strings(names)}) AND regexp_matches(lower({p}), '{rule}') THEN {value} ELSE 0.0 END")
    return "greatest(" + ", ".join(parts) + ")"


_Q25 = "['the yaml config of ', 'fake mock in ', 'gpu health ', 'license terms ', 'plain '][CAST(doc_id % 5 AS INTEGER) + 1] || source"
_Q25_SPARK = "concat(element_at(array('the yaml config of ', 'fake mock in ', 'gpu health ', 'license terms ', 'plain '), cast(doc_id % 5 as int) + 1), source)"
_P25 = "['/a/config/x', '/b/ports.yaml', '/c/mock.py', '/d/health.py', '/x.yml', '/LICENSE.txt'][CAST(doc_id % 6 AS INTEGER) + 1]"
_P25_SPARK = "element_at(array('/a/config/x', '/b/ports.yaml', '/c/mock.py', '/d/health.py', '/x.yml', '/LICENSE.txt'), cast(doc_id % 6 as int) + 1)"


@query(
    "p25_path_boost",
    rf"SELECT doc_id, regexp_matches(q, '[a-z]+_[a-z]+|[a-z][a-zA-Z]*[A-Z]|\w+\.\w+|\w+\(') AS identifier_heavy, CAST({_boost_sql('q', 'p')} AS DOUBLE) AS boost FROM (SELECT doc_id, {_Q25} AS q, {_P25} AS p FROM documents)",
)
def _(spark, d):
    q, p = F.expr(_Q25_SPARK), F.expr(_P25_SPARK)
    return table(spark, d, "documents").select("doc_id", T.identifier_heavy(q).alias("identifier_heavy"), T.path_boost(q, p, _INTENTS).alias("boost"))


_KW = f"list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*'), lambda w: NOT list_contains({strings(T.CLAIM_STOP_WORDS)}, lower(w)) AND length(w) > 2)"


@query(
    "p26_expand_queries",
    rf"""WITH b AS (SELECT item_id, text, {_KW} AS k, list_filter(list_transform(regexp_split_to_array(text, '(?i)\band\b|\bor\b|,|\?'), lambda x: trim(x)), lambda x: length(x) > 10) AS p,
    list_filter(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_.]*'), lambda w: NOT list_contains({strings(T.QUERY_STOP_WORDS)}, lower(w)) AND length(w) > 1) AS q FROM benchmark)
    SELECT item_id, 'keywords' AS variant, array_to_string(q, ' ') AS query FROM b WHERE len(q) > 0
    UNION ALL SELECT item_id, 'part' AS variant, unnest(p[1:3]) AS query FROM b WHERE len(p) >= 2
    UNION ALL SELECT item_id, 'critical' AS variant, text || unnest({strings(T.CRITICAL_SUFFIXES)}) AS query FROM b
    UNION ALL SELECT item_id, 'claim' AS variant, CASE WHEN len(k) = 0 THEN text ELSE array_to_string(k, ' ') END AS query FROM b
    UNION ALL SELECT item_id, 'claim' AS variant, array_to_string(k[1:greatest(1, len(k) // 2)], ' ') AS query FROM b WHERE len(k) > 1""",
)
def _(spark, d):
    from corvane.functions.records import expand_queries

    return expand_queries(table(spark, d, "benchmark"), "item_id", "text")


_ERR = "['AssertionError: ', 'TypeError: ', 'IndexError: ', 'KeyError: ', 'timeout ', 'NameError: ', 'RecursionError: ', 'Other: '][CAST(event_id % 8 AS INTEGER) + 1] || event_type"
_ERR_SPARK = "concat(element_at(array('AssertionError: ', 'TypeError: ', 'IndexError: ', 'KeyError: ', 'timeout ', 'NameError: ', 'RecursionError: ', 'Other: '), cast(event_id % 8 as int) + 1), event_type)"
_LESSON = "CASE " + " ".join(f"WHEN contains(lower(e), '{p}') THEN '{t}'" for p, t in T.LESSONS) + " ELSE 'Runtime error: ' || substr(e, 1, 200) END"


@query("p27_lesson", f"SELECT {_LESSON} AS lesson, count(*) AS n FROM (SELECT {_ERR} AS e FROM events) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy(T.lesson(F.expr(_ERR_SPARK)).alias("lesson")).agg(F.count(F.lit(1)).alias("n"))


_SIG = "1.0 / (1.0 + exp(-value / 100.0))"


@query(
    "p28_niche",
    f"""SELECT 'answer_type=' || CAST(least(3, floor(v * 4)) AS INTEGER) || '|complexity=' || CAST(least(3, floor(c * 4)) AS INTEGER) || '|retrieval_conf=' || CAST(least(3, floor(r * 4)) AS INTEGER) AS niche, count(*) AS n
    FROM (SELECT CASE user_id % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 0.75 ELSE 1.0 END AS v, (event_id % 101) / 100.0 AS c, (event_id % 37) / 36.0 AS r FROM events) GROUP BY 1""",
)
def _(spark, d):
    kind = F.expr("element_at(array('lookup', 'explain', 'debug', 'reasoning', 'design'), cast(user_id % 5 as int) + 1)")
    key = T.niche(F.expr("(event_id % 101) / 100.0D"), kind, F.expr("(event_id % 37) / 36.0D"))
    return table(spark, d, "events").groupBy(key.alias("niche")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p29_learnability",
    """SELECT event_id, round(1.0 - abs(2.0 * s - 1.0), 6) AS learnability, s BETWEEN 0.3 AND 0.7 AS near_miss, round(4.0 * s * (1.0 - s), 6) AS frontier,
    round(CASE WHEN p + f = 0 THEN s ELSE least(1.0, greatest(0.0, (0.5 * s + 0.5 * p / (p + f)) * CASE WHEN f = 1 THEN 1.2 ELSE 1.0 END)) END, 6) AS priority
    FROM (SELECT event_id, (event_id % 101) / 100.0 AS s, event_id % 4 AS p, event_id % 3 AS f FROM events)""",
)
def _(spark, d):
    s, p, f = F.expr("(event_id % 101) / 100.0D"), F.expr("event_id % 4"), F.expr("event_id % 3")
    return table(spark, d, "events").select(
        "event_id", F.round(T.learnability(s), 6).alias("learnability"), T.near_miss(s).alias("near_miss"), F.round(T.frontier(s), 6).alias("frontier"), F.round(T.priority(s, p, f), 6).alias("priority")
    )


@query(
    "p32_text_blocks",
    r"""SELECT doc_id, unnest(b) AS block FROM (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 50) END AS b
    FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 50) AS p FROM documents))""",
)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.text_blocks(F.col("text"))).alias("block"))


_QC = rf"""least(1.0, greatest(0.0, CASE WHEN n <= 5 THEN 0.0 WHEN n <= 15 THEN 0.15 WHEN n <= 30 THEN 0.3 ELSE 0.5 END + least(0.3, {sum_hits('l', T.COMPLEX_SIGNALS)} * 0.1) - least(0.2, {sum_hits('l', T.SIMPLE_SIGNALS)} * 0.1)
    + least(0.2, (len(regexp_extract_all(l, '\band\b|\bor\b|\balso\b')) + len(regexp_extract_all(l, '[,?]'))) * 0.05) + least(0.15, len(regexp_extract_all(text, '[a-zA-Z_]\w*\.\w+')) * 0.05)))"""
_AC = f"""CASE WHEN NOT regexp_matches(text, '\\S') THEN 0.0 ELSE least(1.0, greatest(0.0, CASE WHEN n <= 5 THEN 0.1 WHEN n <= 20 THEN 0.3 WHEN n <= 80 THEN 0.5 ELSE 0.45 END + CASE WHEN c >= 2 THEN 0.25 ELSE 0.0 END
    + CASE WHEN k - 3 * c > 0 THEN least(0.15, (k - 3 * c) * 0.03) ELSE 0.0 END - least(0.4, {sum_hits('l', T.HEDGES)} * 0.1))) END"""


@query(
    "p33_confidence",
    f"SELECT conv_id, turn, CAST(round({_QC}, 6) AS DOUBLE) AS complexity, CAST(round({_AC}, 6) AS DOUBLE) AS confidence FROM (SELECT conv_id, turn, text, lower(text) AS l, len({WORDS.replace('{0}', 'text')}) AS n, len(regexp_extract_all(text, '```')) AS c, len(regexp_extract_all(text, '`')) AS k FROM conversations)",
)
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(T.query_complexity(t), 6).alias("complexity"), F.round(T.answer_confidence(t), 6).alias("confidence"))


_OWN = ("shop",)
_SRC = r"'import ' || ['os', 'numpy', 'json'][CAST(doc_id % 3 AS INTEGER) + 1] || chr(10) || 'from shop.x import y' || chr(10) || 'def run_it():' || chr(10) || '    ' || text"
_SRC_SPARK = "concat('import ', element_at(array('os', 'numpy', 'json'), cast(doc_id % 3 as int) + 1), '\n', 'from shop.x import y', '\n', 'def run_it():', '\n', '    ', text)"


@query(
    "p34_code_style",
    rf"""SELECT doc_id, round(coalesce(len(list_filter(i, lambda r: list_contains({strings((*T.STANDARD_MODULES, *_OWN))}, r))) / nullif(len(i), 0), 1.0), 6) AS imports,
    CASE WHEN s > c THEN 'snake' ELSE 'camel' END AS style FROM (SELECT doc_id, regexp_extract_all(code, '(?:from|import)\s+([a-zA-Z_]\w*)', 1) AS i,
    len(regexp_extract_all(code, '[a-z]+_[a-z]+')) AS s, len(regexp_extract_all(code, '[a-z]+[A-Z][a-z]+')) AS c FROM (SELECT doc_id, {_SRC} AS code FROM documents))""",
)
def _(spark, d):
    code = F.expr(_SRC_SPARK)
    return table(spark, d, "documents").select("doc_id", F.round(T.import_score(code, _OWN), 6).alias("imports"), T.naming_style(code).alias("style"))


@query("p34_structure")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.structure_score(F.expr(_SRC_SPARK)), 6).alias("structure"))


@query(
    "p36_grade",
    f"""SELECT conv_id, turn, contains(lower(text), lower(k)) OR coalesce(len(list_filter(w, lambda x: contains(lower(text), x))) / nullif(len(w), 0) >= 0.6, false) AS passed
    FROM (SELECT *, list_filter({WORDS.replace('{0}', 'lower(k)')}, lambda x: length(x) > 3) AS w FROM (SELECT conv_id, turn, text, substr(text, 10, 30) || ['', ' zzzzz yyyyy', ' qqqqq wwwww eeeee rrrrr'][CAST(turn % 3 AS INTEGER) + 1] AS k FROM conversations))""",
)
def _(spark, d):
    key = F.expr("concat(substr(text, 10, 30), element_at(array('', ' zzzzz yyyyy', ' qqqqq wwwww eeeee rrrrr'), cast(turn % 3 as int) + 1))")
    return table(spark, d, "conversations").select("conv_id", "turn", T.grade(F.col("text"), key).alias("passed"))
