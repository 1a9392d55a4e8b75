"""URL rules by host and path: expressions of each URL, an equi-join on short hashes, full digests, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules that go to all tasks, of about 100 bytes each; more of them meet the expressions in a shuffle.
SENT_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) from a list."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty for null and for what has no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign)))


def _short(digest: Column) -> Column:
    """The first 32 bits of a digest in hex."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Every host suffix of up to ``labels`` labels with every path prefix that ends in one of the first ``depth`` slashes, or is empty.

    No rule has more labels or slashes than that, so nothing that could fit is left out.
    """
    upto = lambda most, there: F.sequence(F.lit(1), F.least(F.lit(most), there))
    suffixes = F.transform(upto(max(labels, 1), _count(host, ".") + 1), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    dirs = F.transform(upto(max(depth, 1), _count(path, "/")), lambda n: F.concat(F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))
    prefixes = F.concat(F.array(F.lit("")), F.when(path.contains("/"), dirs).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", sent: int = SENT_RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row, by ``rules`` (host, path, verdict); only DataFrame functions run.

    A rule fits its host and all hosts that end in a dot and it, if the URL's path starts with the
    rule's, sign by sign. The longest fitting rule wins; of equal ones the longer host, then
    ``block``. Where none fits, rule is null and verdict ``default``.

    A rule is looked up by its host and its path up to the last slash. URLs are expanded to such
    expressions and meet the rules by the first 32 bits of a SHA-256; then the whole digest and the
    rest of the path decide. Up to ``sent`` rules are broadcast, after they have been counted; more
    are joined by a shuffle, whose hot keys adaptive execution splits. What a URL has hit is reduced
    in the task that expanded it, so the one shuffle here has a row for each URL, whatever the number
    of its expressions, and no key of it is shared by two rows.

    Null URLs, and those without ``://``, have an empty host and path. Null ids are kept, repeated
    rows too. A very long URL has no more expressions than the rules' largest number of labels times
    their largest number of slashes plus one. Hosts of rules are compared in lower case; rules with a
    null or empty host fit nothing, a null path is empty, a null verdict is ``block``; no rules at
    all give ``default`` to all. Other columns, whatever their names, are not read. An empty table
    stays empty.
    """
    r_host, r_path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    r_dir = F.when(r_path.contains("/"), F.regexp_extract(r_path, "(?s)^(.*/)", 1)).otherwise("")
    known = rules.where("host <> ''").select(r_host.alias("r_host"), r_path.alias("r_path"), F.coalesce("verdict", F.lit("block")).alias("r_verdict"), F.sha2(F.concat(r_host, r_dir), 256).alias("r_digest"))
    known = known.withColumn("short", _short(F.col("r_digest"))).distinct()
    top = known.agg(F.count(F.lit(1)).alias("n"), F.max(_count(F.col("r_host"), ".") + 1).alias("labels"), F.max(_count(F.col("r_path"), "/")).alias("depth")).first()
    host, path = split_url(F.col(url_col))
    parsed = df.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    asked = parsed.withColumn("expression", F.explode(expressions(F.col("host"), F.col("path"), top["labels"] or 1, top["depth"] or 0)))
    asked = asked.withColumn("digest", F.sha2("expression", 256)).drop("expression").withColumn("short", _short(F.col("digest")))
    met = asked.join(F.broadcast(known) if top["n"] <= sent else known, "short", "left")
    fits = (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
    won = F.struct((F.length("r_host") + F.length("r_path")).alias("long"), F.length("r_host").alias("host"), (F.col("r_verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met.groupBy("_row", "_id", "host", "path").agg(F.max(F.when(fits, won)).alias("best"))
    return best.select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def keep_allowed(df: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Rows of ``df``, all columns, whose URL is not blocked; URLs are judged once each and blocked ones anti-joined."""
    urls = df.select(F.col(url_col).alias("_url")).distinct()
    blocked = judge(urls.withColumn("_copy", F.col("_url")), rules, "_url", "_copy", default).where("verdict = 'block'").select("_url")
    return df.join(blocked, df[url_col].eqNullSafe(blocked["_url"]), "left_anti")


#: Fixed values of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def oracle() -> str:
    """Each rule tried on each page."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""WITH u AS (SELECT page_id, row_number() OVER () AS row,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
    r AS (SELECT * FROM (VALUES {rules}) v(h, p, v)),
    f AS (SELECT row, h || p AS rule, v FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
    w AS (SELECT row, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM f GROUP BY 1)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN w USING (row)"""
