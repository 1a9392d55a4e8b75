"""Scans and sinks over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import metrics as M
from corvane.operators.joins import compare_tables
from corvane.plans.catalog import query, table
from corvane.plans.scratch import scratch_path
from corvane.sources import files as S
from corvane.sources import sinks as K


@query("s01_scan_files", "SELECT count(*) AS lines, CAST(sum(length(text) - length(replace(text, 'a', ''))) AS BIGINT) AS n_a FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark)")
def _(spark, d):
    """A tree of small text files, with a skipped folder and files of another type beside them."""
    root = scratch_path(spark, "tree")
    lines = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("value"))
    for folder in ("src/notes", "node_modules/notes"):
        lines.write.option("maxRecordsPerFile", 1000).text(f"{root}/{folder}")
    lines.write.json(f"{root}/src/rows")
    files, _ = S.scan_files(spark, root, ["txt"])
    return files.agg(F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines"), F.sum(F.regexp_count("text", F.lit("a"))).alias("n_a"))


@query("s02_scan_text", "SELECT count(*) AS lines, CAST(sum(length(text) - length(replace(text, 'a', ''))) AS BIGINT) AS n_a FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark)")
def _(spark, d):
    path = scratch_path(spark, "texts")
    table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    texts = S.scan_text(spark, path)
    return texts.agg(F.sum(F.regexp_count("text", F.lit("\n"))).alias("lines"), F.sum(F.regexp_count("text", F.lit("a"))).alias("n_a"))


@query("s03_scan_jsonl", "SELECT conv_id, text FROM conversations WHERE length(text) >= 40")
def _(spark, d):
    path = scratch_path(spark, "jsonl")
    rows = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("code"), F.when(F.col("turn") % 2 == 1, F.col("text")).alias("func"))
    rows.write.json(path)
    kept, _ = S.scan_jsonl(spark, path, {"text": ["code", "func"], "conv_id": ["conv_id"]}, 40)
    return kept.select(F.col("conv_id").cast("long").alias("conv_id"), "text")


@query("s05_scan_posts", "SELECT o_orderkey AS id, CAST(floor(o_totalprice / 1000) AS INTEGER) AS score, o_orderpriority AS title FROM orders")
def _(spark, d):
    path = scratch_path(spark, "posts")
    rows = table(spark, d, "orders").selectExpr("o_orderkey AS _Id", "1 AS _PostTypeId", "cast(floor(o_totalprice / 1000) as int) AS _Score", "o_orderpriority AS _Title", "'<p>x</p>' AS _Body")
    rows.write.format("xml").option("rowTag", "row").option("rootTag", "posts").save(path)
    return S.scan_posts_xml(spark, path).select("id", "score", "title")


@query("s06_scan_reddit", "SELECT role AS subreddit, CASE WHEN turn % 2 = 0 THEN 'T' || turn || chr(10) || chr(10) || text ELSE text END AS text FROM conversations")
def _(spark, d):
    path = scratch_path(spark, "dump")
    rows = table(spark, d, "conversations").select(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("T"), "turn")).alias("title"), F.when(F.col("turn") % 3 == 0, F.col("text")).alias("selftext"), F.when(F.col("turn") % 3 > 0, F.col("text")).alias("body"), F.col("role").alias("subreddit"))
    rows.write.json(path)
    return S.scan_reddit(spark, path)


@query("s08_file_catalog", "SELECT 'other' AS doc_type, s AS site, count(DISTINCT lang) AS files FROM documents, (VALUES ('germany', 'lang=de'), ('france', 'lang=(fr|es)'), ('all', 'lang=')) v(s, p) WHERE regexp_matches('lang=' || lang, p) GROUP BY 2")
def _(spark, d):
    path = scratch_path(spark, "tree")
    table(spark, d, "documents").select("doc_id", "lang").where("lang IS NOT NULL").repartition("lang").write.partitionBy("lang").parquet(path)
    files = S.file_catalog(spark, path, [("germany", "lang=de"), ("france", "lang=(fr|es)"), ("all", "LANG=")]).where("extension = 'parquet'")
    return files.select("doc_type", F.explode("sites").alias("site"), "path").groupBy("doc_type", "site").agg(F.count(F.lit(1)).alias("files"))


@query("s09_incremental", "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return S.incremental(pages, pages.where("page_id % 3 = 0"), "url")


@query("k01_write_clean", "SELECT lang AS language, source AS source_kind, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    path = scratch_path(spark, "clean")
    K.write_clean(table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("source_kind")).repartition("language", "source_kind"), path)
    return spark.read.parquet(path).groupBy("language", "source_kind").agg(F.count(F.lit(1)).alias("n"))


@query("k02_write_chunks", "SELECT source AS index_name, CASE WHEN source = 'src1' THEN 2 ELSE 1 END AS version, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    path = scratch_path(spark, "chunks")
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("index_name"), F.lit(1).alias("version")).repartition("index_name")
    K.write_chunks(docs, path)
    K.write_chunks(docs.where("index_name = 'src1'").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).groupBy("index_name", "version").agg(F.count(F.lit(1)).alias("n"))


@query("k03_write_manifest", "SELECT p_brand AS source, count(*) AS files FROM part GROUP BY 1")
def _(spark, d):
    path = scratch_path(spark, "manifest")
    K.write_manifest(table(spark, d, "part").groupBy(F.col("p_brand").alias("source")).agg(F.count(F.lit(1)).alias("files")), path)
    return spark.read.schema("source string, files long").json(f"{path}/json").join(spark.read.option("header", "true").schema("source string, files long").csv(f"{path}/csv"), ["source", "files"])


@query("k04_write_training", "SELECT role AS instruction, text AS output FROM conversations WHERE turn % 4 <> 0 UNION ALL SELECT 'calibrate', r_name FROM region")
def _(spark, d):
    path = scratch_path(spark, "training")
    rows = table(spark, d, "conversations").select(F.col("role").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("answer"), (F.col("turn") % 4 == 0).alias("failed"))
    extra = table(spark, d, "region").select(F.lit("calibrate").alias("instruction"), F.lit("").alias("input"), F.col("r_name").alias("output"))
    K.write_training(rows, extra, path)
    return spark.read.json(path).select("instruction", "output")


@query("k05_write_grouped", "SELECT count(*) AS n, true AS small FROM part")
def _(spark, d):
    path = scratch_path(spark, "grouped")
    K.write_grouped(table(spark, d, "part").select("p_partkey"), path, 50)
    sizes = spark.read.schema("p_partkey long").json(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n"), (F.max("n") <= 50).alias("small"))


@query("a39_verify_seal", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'drifted' ELSE 'same' END AS status FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    now = part.where("p_partkey % 11 <> 0").select("p_partkey", F.expr("CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, '!') ELSE p_name END").alias("p_name"))
    return compare_tables(M.seal(part, "p_partkey", "p_name"), M.seal(now, "p_partkey", "p_name"), "p_partkey", "digest")
