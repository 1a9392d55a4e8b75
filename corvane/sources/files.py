"""Scans of files: source trees, texts, JSON lines, posts, dumps and catalogues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a source tree scan skips.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".idea", ".vscode", ".pytest_cache")
BINARY_MAGIC = ("7F454C46", "4D5A", "504B0304", "89504E47", "FFD8FF", "25504446", "1F8B", "D0CF11E0")
DOC_TYPES = {"md": "text", "txt": "text", "rst": "text", "pdf": "document", "doc": "document", "docx": "document", "xls": "sheet", "xlsx": "sheet", "csv": "sheet", "ppt": "slides", "pptx": "slides", "py": "code", "js": "code", "java": "code"}


def _ext(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan_files(spark: SparkSession, root: str, exts: list[str], max_kb: int = 512) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): readable files (path, length, content as text), and how many were left out for each reason.

    Spark's file scan passes over files of no bytes, so these are in neither table.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime", "content")
    folder = "|".join(x.replace(".", r"\.") for x in SKIPPED)
    magic = F.hex(F.substring("content", 1, 4))
    binary = F.lit(False)
    for m in BINARY_MAGIC:
        binary = binary | magic.startswith(m)
    reason = (
        F.when(F.col("path").rlike(f"/({folder})/"), "skipped_folder").when(~_ext(F.col("path")).isin(*exts), "extension")
        .when(F.col("length") > max_kb * 1024, "too_large").when(binary, "binary")
    )
    marked = raw.withColumn("reason", reason)
    files = marked.where("reason IS NULL").select("path", "length", F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    return files, marked.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def scan_text(spark: SparkSession, root: str, exts: tuple[str, ...] = ("md", "txt", "rst")) -> DataFrame:
    """(path, text): whole files of the first extension of which there are any."""
    for ext in exts:
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{ext}").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        if not df.isEmpty():
            return df
    return df


def scan_jsonl(spark: SparkSession, path: str, aliases: dict[str, list[str]], min_len: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the first alternate name of each field that a line has; malformed lines and short texts are counted, not kept.

    The first key of ``aliases`` is the text.
    """
    names = [n for alts in aliases.values() for n in alts]
    schema = ", ".join(f"`{n}` string" for n in dict.fromkeys(names)) + ", _corrupt_record string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    row = raw.select(*[F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in alts]).alias(k) for k, alts in aliases.items()], "_corrupt_record")
    text = F.col(next(iter(aliases)))
    status = F.when(F.col("_corrupt_record").isNotNull(), "malformed").when(F.coalesce(F.length(text), F.lit(0)) < min_len, "short").otherwise("kept")
    marked = row.withColumn("_status", status)
    return marked.where("_status = 'kept'").drop("_status", "_corrupt_record"), marked.groupBy(F.col("_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


POSTS = "_Id BIGINT, _PostTypeId INT, _ParentId BIGINT, _AcceptedAnswerId BIGINT, _Score INT, _Title STRING, _Tags STRING, _Body STRING, _CreationDate TIMESTAMP"


def scan_posts_xml(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a dump, one self-closing row each."""
    raw = spark.read.format("xml").option("rowTag", "row").schema(POSTS).load(path)
    return raw.toDF("id", "kind", "parent", "accepted", "score", "title", "tags", "body", "created")


def scan_reddit(spark: SparkSession, path: str) -> DataFrame:
    """(subreddit, text): title and body of each line; lines without either go."""
    raw = spark.read.schema("title string, selftext string, body string, subreddit string").json(path)
    body = F.coalesce(F.nullif("selftext", F.lit("")), F.nullif("body", F.lit("")))
    return raw.select("subreddit", F.concat_ws("\n\n", F.nullif("title", F.lit("")), body).alias("text")).where("text <> ''")


def scan_events(spark: SparkSession, path: str, schema: str, session: str | None = None, kind: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """JSON events (timestamp, session_id, event_type, ...) by session, type and time; malformed lines are skipped, newest first if limited."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    for column, value in (("session_id", session), ("event_type", kind)):
        df = df if value is None else df.where(F.col(column) == value)
    df = df if since is None else df.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    return df if limit is None else df.orderBy(F.col("timestamp").desc()).limit(limit)


def file_catalog(spark: SparkSession, root: str, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, name, extension, doc_type, size, modified, sites); contents aren't read. Sites are those whose alias (site, pattern) the path below ``root`` matches."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "modificationTime")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv]), _ext(F.col("path"))), F.lit("other"))
    return raw.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), _ext(F.col("path")).alias("extension"), kind.alias("doc_type"), F.col("length").alias("size"), F.to_date("modificationTime").alias("modified"), _sites(F.regexp_replace("path", f"^(?:file:)?/*{re.escape(root.removeprefix('file:').strip('/'))}", ""), aliases or []).alias("sites"))


def _sites(path: Column, aliases: list[tuple[str, str]]) -> Column:
    hits = [F.when(path.rlike(f"(?i){pattern}"), F.lit(site)) for site, pattern in aliases]
    return F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")


def match_sites(files: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """(path, site) of every alias (site, pattern) that a path matches; the list of aliases is a parameter, so it is short."""
    return files.select("path", F.explode(_sites(F.col("path"), aliases)).alias("site"))


def incremental(files: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """Files that the ledger doesn't hold."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")
