"""Joins and comparisons of tables."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.scratch import cut

#: Bytes of phrases that go to all tasks at once; more of them take more passes over the texts.
PHRASE_BLOCK = 16 << 20

_built: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, phrases: list[str]) -> ahocorasick.Automaton:
    """The automaton of a block of phrases, built once in each worker; only the latest is held."""
    if name not in _built:
        _built.clear()
        made = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            made.add_word(p, i)
        made.make_automaton()
        _built[name] = made
    return _built[name]


def containing(docs: DataFrame, phrases: DataFrame, doc_id: str, phrase_id: str, doc_text: str = "text", phrase_text: str = "text", block: int = PHRASE_BLOCK) -> DataFrame:
    """(doc_id, phrase_id) wherever a text contains a phrase literally, once each.

    Different phrases are put into automata of about ``block`` bytes of phrases, their sum is taken
    first; each text is read through once a block and tells all phrases in it at once. Null texts
    contain nothing; null and empty phrases are nowhere. Rows with equal ids are taken together.
    """
    known = cut(phrases.select(F.col(phrase_id).alias("_p"), F.col(phrase_text).alias("_t")).where(F.length(phrase_text) > 0), "phrases")
    texts = known.select("_t").distinct()
    size = texts.agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()[0]
    n = max(1, -(-size // block))
    rows = docs.select(F.col(doc_id).alias("_d"), F.col(doc_text).alias("_x")).where(F.col(doc_text).isNotNull())
    kind = rows.schema["_d"].dataType.simpleString()
    found = None
    for i in range(n):
        sent = docs.sparkSession.sparkContext.broadcast([r["_t"] for r in texts.where(F.pmod(F.xxhash64("_t"), F.lit(n)) == i).toLocalIterator()])
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple[int, int]] = []
                if sent.value:
                    made = _automaton(name, sent.value)
                    for at, text in enumerate(batch.column(1).to_pylist()):
                        out += [(at, hit) for hit in {v for _, v in made.iter(text)}]
                at, hits = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([sent.value[h] for h in hits], pa.string())], ["_d", "_t"])

        hits = rows.mapInArrow(run, f"_d {kind}, _t string")
        found = hits if found is None else found.unionByName(hits)
    return found.join(known, "_t").select(F.col("_d").alias(doc_id), F.col("_p").alias(phrase_id)).distinct()


#: Rows of a key that meet as many others in one cell.
CELL = 1024


def met_pairs(rows: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """(keys, x, y): structs of the other columns of all two rows that share a key, x before y by ``id``.

    Keys with one row are left out. Rows of a key of more than ``cell`` are cut into chunks, and each
    two chunks meet under a key of their own, so no join task grows with a key.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    rest = [c for c in rows.columns if c not in keys]
    chunks = F.ceil(F.col("_size") / cell).cast("int")
    dealt = rows.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select(*keys, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), F.struct("_own", *rest).alias("x"))
    apart = (F.col("_i") == F.col("_j")) | (F.col("x._own") != F.col("y._own"))
    return dealt.join(dealt.withColumnRenamed("x", "y"), [*keys, "_i", "_j"]).where(apart & (F.col("x.id") < F.col("y.id"))).select(*keys, "x", "y")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, out: str = "place") -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= k)


def unprocessed(files: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the ledger; null keys are never processed."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")


def assign_source(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Source (first folder), method and index of each path; a source without a rule (source, method, index_name) is markdown if it holds any .md file."""
    named = files.withColumn("source", F.regexp_extract(path, "^/*([^/]+)/", 1))
    default = named.groupBy("source").agg(F.max(F.col(path).endswith(".md")).alias("_md")).select("source", F.when(F.col("_md"), "markdown").otherwise("code").alias("_default"))
    out = named.join(default, "source").join(rules, "source", "left")
    return out.select(*files.columns, "source", F.coalesce("method", "_default").alias("method"), F.coalesce("index_name", F.col("source")).alias("index_name"))


def qa_pairs(questions: DataFrame, answers: DataFrame, min_score: float, n: int) -> DataFrame:
    """Questions (qid, q_score) and their first n answers (aid, qid, a_score) in id order, both with enough score; questions without any stay."""
    good = top_k(answers.where(F.col("a_score") >= min_score), ["qid"], [F.col("aid")], n)
    return questions.where(F.col("q_score") >= min_score).join(good, "qid", "left")


def best_answers(questions: DataFrame, answers: DataFrame, n: int = 3) -> DataFrame:
    """The accepted answer of each question, then the best by score and age, n at most; questions (qid, accepted) without answers go."""
    joined = answers.join(questions, "qid").withColumn("is_accepted", F.coalesce(F.col("aid") == F.col("accepted"), F.lit(False)))
    return top_k(joined, ["qid"], [F.col("is_accepted").desc(), F.col("a_score").desc(), F.col("created").asc(), F.col("aid").asc()], n)


def compare_tables(src: DataFrame, dst: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): missing in dst, extra in dst, drifted, or same."""
    a, b = src.select(key, F.col(digest).alias("_a")), dst.select(F.col(key).alias("_k"), F.col(digest).alias("_b"))
    status = F.when(F.col("_k").isNull(), "missing").when(F.col(key).isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("drifted")
    return a.join(b, F.col(key) == F.col("_k"), "full_outer").select(F.coalesce(F.col(key), F.col("_k")).alias(key), status.alias("status"))


def pareto(df: DataFrame, up: str, down: str, by: list[str] | None = None) -> DataFrame:
    """Rows that no other row of the group beats: at least as good in ``up`` (more) and ``down`` (less), better in one.

    Costs are reduced to their best score first; the running best runs over one row a cost.
    """
    keys = by or []
    best = df.groupBy(*keys, down).agg(F.max(up).alias("_best"))
    before = F.max("_best").over(Window.partitionBy(*keys).orderBy(down).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    return df.join(front.select(*keys, down, F.col("_best").alias(up)), [*keys, down, up], "left_semi")


def best_for_budget(df: DataFrame, up: str, down: str, budget: float, by: list[str], tie: str) -> DataFrame:
    """Of each group the best row within the budget, else its cheapest."""
    fits = F.col(down) <= budget
    order = [fits.desc(), F.when(fits, F.col(up)).desc_nulls_last(), F.col(down).asc(), F.col(tie).asc()]
    return top_k(df, by, order, 1).drop("place")


def nearest_niche(queries: DataFrame, archive: DataFrame, dims: list[str], width: float = 1.0) -> DataFrame:
    """For each query (query_id, dims): the archive cell (niche, dims) at the least squared distance, ties to the smaller niche.

    Different points are looked up once each. Points are laid on a grid of ``width``; the archive is
    asked cell by cell in rings around a point, by equi-joins, first its own cell, then those at
    distance one, and so on, until what was found can't be beaten from farther out. An empty archive
    has no nearest cell for anyone.
    """
    spot = lambda x: F.floor(F.col(x) / width).cast("long")
    grid = [f"_g{i}" for i in range(len(dims))]
    at = cut(archive.select("niche", *[F.col(x).alias(f"_{x}") for x in dims], *[spot(x).alias(g) for x, g in zip(dims, grid, strict=True)]), "archive")
    points = cut(queries.select(*dims).distinct().select(*dims, *[spot(x).alias(g) for x, g in zip(dims, grid, strict=True)]), "points")
    span = lambda df: df.agg(*[f(g).alias(f"{n}{g}") for g in grid for n, f in (("lo", F.min), ("hi", F.max))]).first()
    a, p = span(at), span(points)
    if a[0] is None or p[0] is None:
        return queries.limit(0).select("query_id", F.lit(None).cast(archive.schema["niche"].dataType).alias("niche"), F.lit(None).cast("double").alias("distance"))
    last = max(max(abs(a[f"hi{g}"] - p[f"lo{g}"]), abs(p[f"hi{g}"] - a[f"lo{g}"])) for g in grid)
    far = sum(((F.col(x) - F.col(f"_{x}")) ** 2 for x in dims), F.lit(0.0))
    open_ = points.withColumn("best", F.lit(None).cast(f"struct<d: double, niche: {archive.schema['niche'].dataType.simpleString()}>"))
    done = None
    for ring in range(last + 1):
        steps = [s for s in itertools.product(range(-ring, ring + 1), repeat=len(dims)) if max(map(abs, s)) == ring]
        moved = F.explode(F.array(*[F.struct(*[(F.col(g) + s).alias(g) for g, s in zip(grid, step, strict=True)]) for step in steps]))
        asked = open_.select(*dims, moved.alias("_c")).select(*dims, *[F.col(f"_c.{g}").alias(g) for g in grid])
        near = asked.join(at, grid).groupBy(*dims).agg(F.min(F.struct(F.round(far, 9).alias("d"), F.col("niche"))).alias("now"))
        known = open_.join(near, dims, "left").withColumn("best", F.least("best", "now")).drop("now")
        known = cut(known, "rings")
        sure = F.col("best").isNotNull() & (F.col("best.d") <= (ring * width) ** 2) if ring < last else F.lit(True)
        ended = known.where(sure).select(*dims, "best")
        done = ended if done is None else done.unionByName(ended)
        open_ = known.where(~sure)
        if open_.isEmpty():
            break
    return queries.join(done, dims).select("query_id", F.col("best.niche").alias("niche"), F.col("best.d").alias("distance"))
