"""Retrieval for many queries at once: keyword index, vector search, fusion, and what is built on them.

Hits are rows (query_id, chunk_id, score); ranks start at 1, and ties go to the smaller chunk id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.plans.scratch import cut

#: Query vectors that are sent to all tasks at once; more of them take more passes.
QUERY_BLOCK = 4096

#: Products of queries and vectors that a task holds at once.
PRODUCTS = 1 << 21


#: Rows of query terms that go to all tasks; more of them meet the postings in a shuffle.
ASKED_ROWS = 1_000_000


@dataclass
class Index:
    """A forward index: a row for each chunk with its length and its terms (chunk_id, dl, terms of term and tf).

    Postings of a chunk lie together, so a common term is spread like the chunks are, and scores of
    a chunk are added up before anything is shuffled.
    """

    table: DataFrame

    @property
    def chunks(self) -> DataFrame:
        return self.table.select("chunk_id", "dl")

    @property
    def postings(self) -> DataFrame:
        """(chunk_id, dl, term, tf)."""
        return self.table.select("chunk_id", "dl", F.explode("terms").alias("t")).select("chunk_id", "dl", "t.term", "t.tf")

    @property
    def terms(self) -> DataFrame:
        """(term, df)."""
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def index_rows(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The rows of an index. Terms of a chunk are counted where it lies; nothing is shuffled. Null texts have no terms but count as chunks."""
    words = chunks.select(F.col(id_col).alias("chunk_id"), T.terms(F.coalesce(F.col(text_col), F.lit(""))).alias("t"))
    return words.mapInArrow(_counted, f"chunk_id {words.schema['chunk_id'].dataType.simpleString()}, dl long, terms array<struct<term:string,tf:bigint>>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, dl, terms) from (chunk_id, terms with repeats)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            piece = batch.slice(at, 2048)
            flat = piece.column(1).flatten().dictionary_encode()
            size, n = np.diff(piece.column(1).offsets.to_numpy()), max(1, len(flat.dictionary))
            keys, tf = np.unique(np.repeat(np.arange(piece.num_rows), size) * n + flat.indices.to_numpy(), return_counts=True)
            terms = pa.StructArray.from_arrays([flat.dictionary.take(pa.array(keys % n)), pa.array(tf)], ["term", "tf"])
            begins = pa.array(np.searchsorted(keys // n, np.arange(piece.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(begins, terms)], ["chunk_id", "dl", "terms"])


def write_index(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "text", append: bool = False) -> Index:
    """Writes an index as a table, or appends the rows of new chunks to one, and returns it."""
    index_rows(chunks, id_col, text_col).write.mode("append" if append else "errorifexists").parquet(path)
    return read_index(chunks.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(path))


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> Index:
    """An index in the shared folder; texts are read once."""
    return Index(cut(index_rows(chunks, id_col, text_col), "index"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """(query_id, term, weight): repeated terms of a query add up."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(T.terms(F.col(text_col))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def bm25_scores(terms: DataFrame, index: Index, k1: float = 1.2, b: float = 0.75, best: int | None = None) -> DataFrame:
    """Every match of any term: (query_id, chunk_id, score), score = sum of weight x idf x tf (k1 + 1) / (tf + k1 (1 - b + b dl / mean dl)).

    idf = ln((N - df + 0.5) / (df + 0.5)), a millionth at least. Only postings of the queries' terms
    are counted and joined. Up to ASKED_ROWS query terms go to all tasks, which add up a chunk's
    scores where its row lies, so no scores are shuffled; their number is counted first. With ``best``
    a task keeps that many hits a query, ``top_hits`` of which are those of all matches. Rows that
    share an id add up: then, as with more terms, scores are added up in a shuffle.
    """
    total = index.chunks.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("mean_dl")).first()
    asked = cut(terms.select("query_id", "term", "weight"), "asked")
    small = asked.count() <= ASKED_ROWS
    sent = F.broadcast if small else lambda df: df
    if small:
        counts = index.table.select("terms").mapInArrow(_holding(asked.sparkSession.sparkContext.broadcast(asked.select("term").distinct().toArrow()["term"].combine_chunks())), "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    else:
        counts = index.postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.lit(total["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = cut(asked.join(counts, "term").select("query_id", "term", (F.col("weight") * idf).alias("w")), "asked")
    if small and total["ids"] == total["n"]:
        by_query = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("l")).toArrow()
        shared = asked.sparkSession.sparkContext.broadcast(Asked.of(by_query))
        kinds = [weighed.schema["query_id"].dataType.simpleString(), index.table.schema["chunk_id"].dataType.simpleString()]
        return index.table.select("chunk_id", "dl", "terms").mapInArrow(_scored(shared, total["mean_dl"], k1, b, best), f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(total["mean_dl"]))
    found = index.postings.join(sent(weighed), "term").select("query_id", "chunk_id", (F.col("w") * F.col("tf") * (k1 + 1) / norm).alias("part"))
    return found.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))


@dataclass
class Asked:
    """The terms of all queries, with the queries that have each: numbers and weights of term i stand in begins[i] to begins[i + 1]."""

    ids: pa.Array
    terms: pa.Array
    begins: np.ndarray
    query: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, by_query: pa.Table) -> Asked:
        """From one row a query: its id and a list of (term, weight)."""
        lists = by_query.column("l").combine_chunks()
        flat, size = lists.flatten(), np.diff(lists.offsets.to_numpy())
        terms = flat.field("term").dictionary_encode()
        code = terms.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        begins = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1))
        return cls(by_query.column("query_id").combine_chunks(), terms.dictionary, begins, np.repeat(np.arange(len(size)), size)[order], flat.field("w").to_numpy()[order])


#: Scores of a term in a chunk that are added up at once.
PARTS = 1 << 20


def _holding(shared) -> Callable:
    """How many rows of an index hold each of the terms, one row a term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            code = pc.drop_null(pc.index_in(batch.column(0).flatten().field("term"), value_set=terms)).to_numpy()
            n += np.bincount(code, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(some)), pa.array(n[some])], ["term", "df"])

    return run


def _scored(shared, mean_dl: float, k1: float, b: float, best: int | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        names = ["query_id", "chunk_id", "score"]
        held = None
        for batch in batches:
            for query, row, score in _added(batch, asked, mean_dl, k1, b):
                if best is None:
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(query)), batch.column(0).take(pa.array(row)), pa.array(score)], names)
                    continue
                tied = np.round(score, 6)  # only rows that may be among a query's best meet those held
                order = np.lexsort((-tied, query))
                query, row, score, tied = query[order], row[order], score[order], tied[order]
                first = np.searchsorted(query, query)
                enough = np.minimum(first + best, np.searchsorted(query, query, "right")) - 1
                on = tied >= tied[enough]
                chunk, query, score = batch.column(0).take(pa.array(row[on])), query[on], score[on]
                if held is not None:
                    query, score, chunk = np.concatenate([held[0], query]), np.concatenate([held[1], score]), pa.concat_arrays([held[2], chunk])
                place = pc.sort_indices(pa.table({"q": query, "s": -np.round(score, 6), "c": chunk}), [("q", "ascending"), ("s", "ascending"), ("c", "ascending")], null_placement="at_start").to_numpy()
                query = query[place]
                on = np.arange(len(query)) - np.searchsorted(query, query) < best
                held = query[on], score[place[on]], chunk.take(pa.array(place[on]))
        if held is not None:
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(held[0])), held[2], pa.array(held[1])], names)

    return run


def _added(batch: pa.RecordBatch, asked: Asked, mean_dl: float, k1: float, b: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of query, row, score) of a batch of an index, about PARTS parts of scores at a time."""
    postings = batch.column(2).flatten()
    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(2).offsets.to_numpy()))
    code = pc.fill_null(pc.index_in(postings.field("term"), value_set=asked.terms), -1).to_numpy()
    on = np.flatnonzero(code >= 0)
    code, row, tf = code[on], row[on], postings.field("tf").to_numpy()[on]
    dl = batch.column(1).to_numpy()[row]
    value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean_dl))
    n = asked.begins[code + 1] - asked.begins[code]
    parts = np.cumsum(n)
    last = np.searchsorted(row, np.arange(batch.num_rows), "right")  # postings up to each row's end
    at = 0
    while at < batch.num_rows:
        lo = last[at - 1] if at else 0
        done = parts[lo - 1] if lo else 0
        to = max(at + 1, int(np.searchsorted(np.append(0, parts)[last], done + PARTS, "right")))
        hi = last[to - 1]
        m = n[lo:hi]
        if m.sum():
            each = np.repeat(asked.begins[code[lo:hi]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            key = asked.query[each] * (to - at) + np.repeat(row[lo:hi] - at, m)
            part = asked.weight[each] * np.repeat(value[lo:hi], m)
            if len(asked.ids) * (to - at) <= 4 * PARTS:
                found, score = np.flatnonzero(np.bincount(key, minlength=1)), np.bincount(key, part)
                score = score[found]
            else:
                found, where = np.unique(key, return_inverse=True)
                score = np.bincount(where, part)
            yield found // (to - at), at + found % (to - at), score
        at = to


def top_hits(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), digits: int = 6) -> DataFrame:
    """The best k hits of each query with their rank; scores that agree to ``digits`` places tie."""
    order = Window.partitionBy(*by).orderBy(F.round("score", digits).desc(), F.col("chunk_id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, index: Index, k: int = 10, **kw) -> DataFrame:
    """The best k hits of each query, written, so that joins know their size."""
    return cut(top_hits(bm25_scores(query_terms(queries), index, best=k, **kw), k), "hits")


def bm25_quality(queries: DataFrame, index: Index, quality: DataFrame, min_quality: int, k: int = 10) -> DataFrame:
    """Hits among chunks of enough quality (chunk_id, quality); queries with fewer than min(3, k) of them get unfiltered hits."""
    scores = bm25_scores(query_terms(queries), index)
    good = top_hits(scores.join(quality.where(F.col("quality") >= min_quality).select("chunk_id"), "chunk_id", "left_semi"), k)
    enough = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(3, k)).select("query_id")
    kept = good.join(enough, "query_id", "left_semi").withColumn("filtered", F.lit(True))
    return kept.unionByName(top_hits(scores.join(enough, "query_id", "left_anti"), k).withColumn("filtered", F.lit(False)))


def bm25_boosted(queries: DataFrame, index: Index, chunk_index: DataFrame, technical: list[str], k: int = 10, per_index: int = 3) -> DataFrame:
    """Technical terms count double and stop words nothing; the best ``per_index`` of each index (chunk_id, index_name), then the best k."""
    terms = query_terms(queries).where(~F.col("term").isin(*T.QUERY_STOP_WORDS)).withColumn("weight", F.col("weight") * F.when(F.col("term").isin(*technical), 2.0).otherwise(1.0))
    scores = bm25_scores(terms, index).join(chunk_index, "chunk_id")
    return top_hits(top_hits(scores, per_index, ("query_id", "index_name")).drop("rank"), k)


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """The k largest inner products, in double precision, of every query (query_id, embedding) over all (chunk_id, embedding).

    Queries go to the tasks in blocks of ``block`` at most; each task keeps k hits a query of its rows.
    Null vectors match nothing; all others must have one length.
    """
    spark = queries.sparkSession
    have = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("v"))
    n = -(-have.count() // block)
    rows = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", F.col("embedding").cast("array<double>").alias("v"))
    out = None
    for b in range(n):
        part = have if n == 1 else have.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        got = part.toPandas()
        if not len(got):
            continue
        shared = spark.sparkContext.broadcast((got["query_id"].to_numpy(), np.stack(got["v"].to_numpy())))
        hits = rows.mapInArrow(_products(shared, k), f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = queries.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id {vectors.schema['chunk_id'].dataType.simpleString()}, score double")
    return top_hits(out, k)


def _products(shared, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)]  # query number, chunk, score
        for batch in batches:
            step = max(64, PRODUCTS // len(q))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                chunk = piece.column(0).to_numpy(zero_copy_only=False)
                x = piece.column(1).flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1)
                raw = q @ x.T
                s = np.round(raw, 6)
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                row, col = np.nonzero(s >= least[:, None])  # the best k of these rows, with all that tie
                row, chunk, score = np.concatenate([held[0], row]), np.concatenate([held[1], chunk[col]]), np.concatenate([held[2], raw[row, col]])
                order = np.lexsort((chunk, -np.round(score, 6), row))
                row = row[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                kept = order[place < k]
                held = [np.sort(row[place < k]), chunk[kept], score[kept]]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1].tolist()), pa.array(held[2])], ["query_id", "chunk_id", "score"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of exact hits that were found."""
    hit = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def rrf(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of hits with a ``list`` column: sum of weight / (k + rank)."""
    order = Window.partitionBy("query_id", "list").orderBy(F.round("score", 6).desc(), F.col("chunk_id").asc())
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("list") == name, F.lit(float(value))).otherwise(weight)
    return lists.withColumn("r", F.row_number().over(order)).groupBy("query_id", "chunk_id").agg(F.sum(weight / (k + F.col("r"))).alias("score"))


def dbsf(lists: DataFrame) -> DataFrame:
    """Fusion by distribution: each list's scores are placed in mean +- 3 sigma, clamped and added up."""
    of = Window.partitionBy("query_id", "list")
    sigma = F.stddev_pop("score").over(of)
    low = F.avg("score").over(of) - 3 * sigma
    scaled = T.clamp((F.col("score") - low) / F.when(sigma > 1e-12, 6 * sigma).otherwise(1.0))
    return lists.withColumn("s", scaled).groupBy("query_id", "chunk_id").agg(F.sum("s").alias("score"))


def hybrid(queries: DataFrame, index: Index, vectors: DataFrame, k: int = 10, fuse: Callable[[DataFrame], DataFrame] = rrf) -> DataFrame:
    """Keyword and vector hits of queries (query_id, query, embedding), fused. Identifier-heavy queries get a keyword pool three times as deep."""
    pool = top_hits(bm25_scores(query_terms(queries), index, best=3 * k), 3 * k)
    heavy = queries.select("query_id", T.identifier_heavy(F.col("query")).alias("heavy"))
    sparse = pool.join(heavy, "query_id").where(F.col("heavy") | (F.col("rank") <= k)).select("query_id", "chunk_id", "score", F.lit("keyword").alias("list"))
    dense = knn(queries.select("query_id", "embedding"), vectors, k).select("query_id", "chunk_id", "score", F.lit("vector").alias("list"))
    return top_hits(fuse(sparse.unionByName(dense)), k)


def federated(queries: DataFrame, index: Index, chunk_index: DataFrame, weights: dict[str, float] | None = None, k: int = 10, fuse_k: int = 60) -> DataFrame:
    """The best k of each index, fused by rank with the weights of the indexes; equal contents (chunk_id, index_name, content) count once.

    Copies' scores add up and the copy with the largest share stands for them.
    """
    hits = top_hits(bm25_scores(query_terms(queries), index).join(chunk_index.select("chunk_id", "index_name"), "chunk_id"), k, ("query_id", "index_name"))
    weight = F.lit(1.0)
    for name, value in (weights or {}).items():
        weight = F.when(F.col("index_name") == name, F.lit(float(value))).otherwise(weight)
    parts = hits.join(chunk_index.select("chunk_id", F.sha2("content", 256).alias("hash")), "chunk_id").withColumn("part", weight / (fuse_k + F.col("rank")))
    best = F.max_by(F.struct("chunk_id", "index_name"), F.struct(F.round("part", 9), -F.col("chunk_id")))
    merged = parts.groupBy("query_id", "hash").agg(F.sum("part").alias("score"), best.alias("best"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("best.chunk_id"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "best.chunk_id", "best.index_name", "score")


def overlap_score(query: Column, content: Column) -> Column:
    """The share of a query's words that a content has."""
    words = F.array_distinct(T.blank_words(F.lower(query)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, T.blank_words(F.lower(content)))), F.size(words)), F.lit(0.0))


def rerank(hits: DataFrame, score: Column, n: int) -> DataFrame:
    """Hits again by another score, the best n."""
    return top_hits(hits.drop("rank").withColumn("score", score), n)


def corrective(queries: DataFrame, index: Index, threshold: float, k: int = 5) -> DataFrame:
    """Hits of every query; those with confidence below ``threshold`` also get the hits of their variants.

    First hits stay before added ones; (query_id, chunk_id, origin, position).
    """
    from corvane.functions.records import expand_queries

    first = bm25(queries.select("query_id", "query"), index, k).select("query_id", "chunk_id", F.lit(0).alias("source"), "rank")
    weak = queries.where(F.col("confidence") < threshold).select("query_id", F.col("query").alias("text"))
    variants = expand_queries(weak, "query_id", "text").where(F.col("variant").isin("keywords", "part"))
    numbered = variants.select(F.struct("query_id", "variant", "query").alias("query_id"), F.col("query"))
    added = bm25(numbered, index, k).groupBy(F.col("query_id.query_id").alias("query_id"), "chunk_id").agg(F.min("rank").alias("rank")).select("query_id", "chunk_id", F.lit(1).alias("source"), "rank")
    merged = first.unionByName(added).groupBy("query_id", "chunk_id").agg(F.min(F.struct("source", "rank")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.source", "m.rank", "chunk_id")
    return merged.select("query_id", "chunk_id", F.when(F.col("m.source") == 0, "first").otherwise("added").alias("origin"), F.row_number().over(order).alias("position"))


def round_trip(questions: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """For questions (query_id, source_chunk): the rank of their source, how hard that was, and whether it passed."""
    found = hits.select(F.col("query_id").alias("q"), F.col("chunk_id").alias("c"), "rank")
    joined = questions.join(found, (F.col("query_id") == F.col("q")) & (F.col("source_chunk") == F.col("c")), "left")
    level = F.when(F.col("rank").isNull(), "missed").when(F.col("rank") == 1, "easy").when(F.col("rank") <= 3, "medium").otherwise("hard")
    return joined.select("query_id", "source_chunk", "rank", level.alias("difficulty"), F.coalesce(F.col("rank") <= k, F.lit(False)).alias("passed"))


def keyword_audit(docs: DataFrame, queries: DataFrame, min_score: float = 0.5, n: int = 3) -> DataFrame:
    """The n documents (chunk_id, text) with the largest share of each query's distinct terms, and whether that is enough."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("size"))
    have = docs.select("chunk_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    hits = wanted.join(have, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n")).join(size, "query_id").select("query_id", "chunk_id", (F.col("n") / F.col("size")).alias("score"))
    return top_hits(hits, n).withColumn("passed", F.col("score") >= min_score)


def experience_recall(queries: DataFrame, experiences: DataFrame, k: int = 5) -> DataFrame:
    """Past experiences (exp_id, query, quality, q_value) by 0.7 (0.6 Jaccard of key words + 0.4 quality) + 0.3 value, above 0.1."""
    q = queries.select("query_id", T.keywords(F.col("query")).alias("kq"))
    e = experiences.select("exp_id", T.keywords(F.col("query")).alias("ke"), "quality", "q_value")
    pairs = q.select("query_id", F.explode("kq").alias("w")).join(e.select("exp_id", F.explode("ke").alias("w")), "w").groupBy("query_id", "exp_id").agg(F.count(F.lit(1)).alias("both"))
    sized = pairs.join(q.select("query_id", F.size("kq").alias("nq")), "query_id").join(e.select("exp_id", F.size("ke").alias("ne"), "quality", "q_value"), "exp_id")
    jaccard = F.col("both") / (F.col("nq") + F.col("ne") - F.col("both"))
    score = 0.7 * (0.6 * jaccard + 0.4 * F.col("quality")) + 0.3 * T.clamp(F.col("q_value"))
    return top_hits(sized.select("query_id", F.col("exp_id").alias("chunk_id"), score.alias("score")).where(F.col("score") > 0.1), k)


def replay_blend(new: DataFrame, old: DataFrame, ratio: float, n: int) -> DataFrame:
    """Of each query's n places, floor(n x ratio) go to replayed rows, the rest to new ones; what one side lacks the other fills."""
    ranked = lambda df, o: top_hits(df, n).select("query_id", "chunk_id", F.lit(o).alias("origin"), "rank")
    both = ranked(new, "new").unionByName(ranked(old, "replayed"))
    quota = F.when(F.col("origin") == "replayed", int(n * ratio)).otherwise(n - int(n * ratio))
    order = Window.partitionBy("query_id").orderBy((F.col("rank") > quota), "origin", "rank", "chunk_id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def trail_boost(hits: DataFrame, trails: DataFrame, factor: float = 0.15) -> DataFrame:
    """Hits with ``factor`` x (2 / (1 + e^-strength) - 1) added for chunks that have a trail (chunk_id, strength), ranked again."""
    s = F.col("strength")
    lift = F.when(s > 0, factor * (2 / (1 + F.exp(-s)) - 1)).otherwise(0.0)
    return hits.drop("rank").join(trails.select("chunk_id", "strength"), "chunk_id", "left").withColumn("score", F.col("score") + F.coalesce(lift, F.lit(0.0))).drop("strength")


def search_all_terms(queries: DataFrame, index: Index, k: int = 10) -> DataFrame:
    """Hits that have every term of the query."""
    terms = query_terms(queries)
    need = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
    full = terms.join(index.postings, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("have")).join(need, "query_id").where("have = need")
    return top_hits(bm25_scores(terms, index).join(full, ["query_id", "chunk_id"], "left_semi"), k)


def lesson_recall(queries: DataFrame, index: Index, lessons: DataFrame, k: int = 3) -> DataFrame:
    """Among the best 2k hits with a long word in common, passes first, then failures that carry a lesson (chunk_id, passed, lesson)."""
    long = query_terms(queries).where(F.length("term") > 3)
    hits = top_hits(bm25_scores(long, index, best=2 * k), 2 * k).join(lessons, "chunk_id").where(F.col("passed") | (F.coalesce("lesson", F.lit("")) != ""))
    order = Window.partitionBy("query_id").orderBy(F.col("passed").desc(), F.col("rank"))
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "place", "chunk_id", "passed")


def verify_claims(pairs: DataFrame) -> DataFrame:
    """Claims (claim_id, claim, text) against candidate texts, a row each: how many support and how many hardly overlap, with a verdict.

    Overlap is the share of the claim's key words in the text: 0.4 or more supports, less than 0.15 is low.
    """
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*T.CLAIM_STOP_WORDS)))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(words(F.col("claim")), words(F.col("text")))), F.size(words(F.col("claim")))), F.lit(0.0))
    counted = pairs.withColumn("s", share).groupBy("claim_id").agg(F.count_if(F.col("s") >= 0.4).alias("supports"), F.count_if(F.col("s") < 0.15).alias("low_overlap"))
    base = F.when(F.col("supports") == 0, 0.0).when(F.col("supports") == 1, 0.4).when(F.col("supports") == 2, 0.7).otherwise(0.9)
    sure = T.clamp(base - 0.15 * F.col("low_overlap"))
    return counted.withColumn("confidence", F.round(sure, 6)).withColumn("verified", (F.col("supports") >= 2) & (F.col("supports") > F.col("low_overlap")))


def balance(sources: DataFrame) -> DataFrame:
    """Per claim (claim_id, side, title): the share of opposing among all sources, each title of a side once."""
    one = sources.select("claim_id", "side", F.lower(F.trim("title")).alias("t")).distinct()
    n = one.groupBy("claim_id").agg(F.count_if(F.col("side") == "opposing").alias("opposing"), F.count(F.lit(1)).alias("sources"))
    return n.withColumn("balance", F.round(F.col("opposing") / F.col("sources"), 6))


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunks and characters of every index and of all together (index_name null)."""
    return chunks.rollup("index_name").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


def with_embedding(df: DataFrame, text_col: str, dims: int = 256) -> DataFrame:
    """``df`` with ``embedding``: hashed term counts of unit length. Another embedder is a Column function in its place."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    hashed = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=dims).transform(df.withColumn("_terms", T.terms(F.coalesce(F.col(text_col), F.lit("")))))
    v = vector_to_array("_tf")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return hashed.withColumn("embedding", F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)).cast("float"))).drop("_terms", "_tf")
