"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.operators.joins import containing, met_pairs
from corvane.plans.ranking import global_rank
from corvane.plans.scratch import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` can reach, for numbers as node ids.

    Alternates large-star and small-star steps: every node hands its larger (then its smaller)
    neighbours to the smallest node around it, until each node hangs on its component's smallest.
    That takes a logarithmic number of rounds. Each half round is written to the shared folder, so
    lineage stays short and a hub's rows meet its minimum in a join of two plain shuffles, which
    adaptive execution can split. Edges with a null end and loops add nothing; nodes without an
    edge are not in the result; no edges give an empty table.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    stars = cut(pairs.distinct(), "edges")
    seen = _mark(stars)
    while seen[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        stars = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _mark(stars)
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(pairs: DataFrame) -> tuple:
    """Rows of an edge table and a checksum of them."""
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


# --- Code graphs: nodes (id, name, kind, file, line), edges (src, dst, type) ---

#: Names that aren't calls.
NOT_CALLED = ("if", "for", "while", "return", "print", "len", "range", "int", "str", "float", "list", "dict", "set", "tuple", "super", "isinstance", "def", "class")


#: What may follow a definition's head: its docstring, of which DOC signs are kept.
_DOC = r'(?=[^\n]*\n\s*"""((?s:.{0,2000}?))"""|)'
DOC = 200


def entities(chunks: DataFrame) -> DataFrame:
    """(id, name, kind, file, doc): functions, classes and imported names of chunks (file, content); an id names its file, ``doc`` is the start of the docstring, empty where there is none.

    The largest of several strings is found by sorting, so equal rows are taken together by hash before; the shuffle in between keeps both steps apart.
    """
    kinds = (("function", r"(?m)^\s*(?:async\s+)?def\s+(\w+)" + _DOC), ("class", r"(?m)^\s*class\s+(\w+)" + _DOC), ("import", r"(?m)^\s*from\s+[\w.]+\s+import\s+(\w+)()"))
    found = F.concat(*[_named(k, p) for k, p in kinds])
    rows = chunks.select("file", F.explode(F.array_distinct(found)).alias("e")).select("file", "e.*").distinct().repartition("file", "name", "kind")
    return rows.groupBy("file", "name", "kind").agg(F.max("doc").alias("doc")).select(F.concat_ws("::", "file", "name").alias("id"), "name", "kind", "file", "doc")


def _named(kind: str, pattern: str):
    names, docs = (F.regexp_extract_all("content", F.lit(pattern), i) for i in (1, 2))
    return F.zip_with(names, docs, lambda n, d: F.struct(n.alias("name"), F.lit(kind).alias("kind"), F.substring(F.trim(F.coalesce(d, F.lit(""))), 1, DOC).alias("doc")))


def relations(chunks: DataFrame) -> DataFrame:
    """(src, dst, type): calls from the definition above them, inheritance and imports; targets elsewhere are ``*::name``.

    A text is cut before each definition, so what a piece calls below its first line is called by
    that definition; all happens inside the row, and several texts of one file count each.
    """
    pieces = chunks.select("file", F.explode(F.split("content", r"(?m)(?=^[^\S\n]*(?:async[^\S\n]+)?def[^\S\n]+\w)")).alias("p"))
    caller = F.nullif(F.regexp_extract("p", r"^[^\S\n]*(?:async[^\S\n]+)?def[^\S\n]+(\w+)", 1), F.lit(""))
    called = F.filter(F.regexp_extract_all(F.regexp_extract("p", r"(?s)^[^\n]*\n(.*)$", 1), F.lit(r"(\w+)\("), 1), lambda n: ~n.isin(*NOT_CALLED))
    body = pieces.select("file", caller.alias("caller"), F.explode(F.array_distinct(called)).alias("n")).where("caller IS NOT NULL")
    calls = body.select(F.concat_ws("::", "file", "caller").alias("src"), F.concat(F.lit("*::"), "n").alias("dst"), F.lit("calls").alias("type"))
    found = lambda pattern, i: F.regexp_extract_all("content", F.lit(pattern), i)
    base = r"(?m)^\s*class\s+(\w+)\(([^)]*)\)"
    heirs = chunks.select("file", F.explode(F.arrays_zip(found(base, 1).alias("c"), found(base, 2).alias("b"))).alias("h"))
    inherits = heirs.select("file", "h.c", F.explode(F.split("h.b", r",\s*")).alias("n")).where("n <> ''").select(F.concat_ws("::", "file", "c").alias("src"), F.concat(F.lit("*::"), "n").alias("dst"), F.lit("inherits").alias("type"))
    imports = chunks.select(F.col("file").alias("src"), F.explode(F.array_distinct(found(r"(?m)^\s*from\s+[\w.]+\s+import\s+(\w+)", 1))).alias("n")).select("src", F.concat(F.lit("*::"), "n").alias("dst"), F.lit("imports").alias("type"))
    return calls.unionByName(inherits).unionByName(imports).distinct()


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``*::name`` targets replaced by the smallest node of that name; those without one go."""
    by_name = nodes.groupBy("name").agg(F.min("id").alias("target"))
    wild = edges.where(F.col("dst").startswith("*::")).withColumn("name", F.substring("dst", 4, 10_000)).join(by_name, "name")
    return edges.where(~F.col("dst").startswith("*::")).unionByName(wild.select("src", F.col("target").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def neighbors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbor) of each of ``nodes`` (node), in both directions, once."""
    out = nodes.join(edges, F.col("node") == F.col("src")).select("node", F.col("dst").alias("neighbor"))
    back = nodes.join(edges, F.col("node") == F.col("dst")).select("node", F.col("src").alias("neighbor"))
    return out.union(back).distinct()


#: Queries whose scores lie side by side in a row of ``ppr``.
WIDE = 32

#: Links of the targets of a block of ``ppr``, links that are laid out as one row, scores of a task, and nodes whose scores are one row.
LINKED, LAID, SCORED, SENT = 1 << 26, 1 << 21, 1 << 25, 1 << 16


def ppr(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 5, wide: int = WIDE, linked: int = LINKED) -> DataFrame:
    """(query_id, node, score): personalised PageRank of many queries at once over undirected edges.

    Seeds (query_id, node) share the teleport; what nodes without neighbours hold is lost. Nodes and
    queries are numbered. Targets are dealt to blocks of about ``linked`` links, queries to groups of
    ``wide`` at most, and a task holds the links of a block and the scores of a group. Links are laid
    out once as arrays, written, and kept so in memory and on disk of the executors; a lost executor's part is laid
    out again from the written table. A round sends a node's scores once to each block, not
    once an edge, as arrays of those nodes that a query has come to, and adds them up where the links
    lie. Scores are written to the shared folder every few rounds.
    """
    spark = edges.sparkSession
    pairs = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "pairs")
    names = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    nodes = cut(global_rank(names, [F.col("node")], "id"), "nodes")
    start = cut(seeds.select("query_id", "node").distinct(), "seeds")
    share = start.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    numbers = cut(global_rank(share, [F.col("query_id")], "nth"), "numbers")
    size, links, asked = nodes.count(), 2 * pairs.count(), numbers.count()
    blocks = max(1, min(size, -(-links // linked)))
    # Two groups of queries a core, if there are so many.
    wide = max(1, min(wide, SCORED // max(1, size), -(-asked * blocks // (2 * spark.sparkContext.defaultParallelism))))
    teleport = start.join(numbers, "query_id").join(nodes, "node", "left").select("query_id", "nth", "node", "id", (1 / F.col("n")).alias("t"))
    teleport = cut(teleport, "teleport")
    laid = cut(_laid(pairs, nodes, size, links, blocks), "links").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(0, (asked - 1) // wide)))))
    held = laid.unionByName(_jumps(teleport, blocks, wide)).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block", "group").persist()
    scores = spark.createDataFrame([], _SCORES)
    for i in range(rounds + 1):
        sent = scores.withColumnRenamed("block", "origin").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        scores = sent.groupBy("block", "group").cogroup(held.groupBy("block", "group")).applyInArrow(_round(i, rounds, damping, size, blocks, wide), _SCORES)
        if i == rounds or i and i % every == 0:
            scores = cut(scores, "scores")
    held.unpersist()
    found = scores.mapInArrow(_told(blocks, wide), "id long, nth long, score double").join(nodes, "id").join(numbers, "nth").select("query_id", "node", "score")
    alone = teleport.where("id IS NULL").select("query_id", "node", (F.col("t") * (1 - damping if rounds else 1.0)).alias("score"))
    return found.unionByName(alone)


#: Scores of nodes of a block, by their places in it (the first, if they follow each other), one array of ``wide`` rows.
_SCORES = "block int, group int, at binary, score binary"
#: Links of the targets of a part of a block: how many each has, and their sources. Part -1 has the jumps of a group: places and a row of them for each query.
_HELD = "block int, part int, a binary, b binary"


def _laid(pairs: DataFrame, nodes: DataFrame, size: int, links: int, blocks: int) -> DataFrame:
    """(block, part, a, b): the links of targets with ids in turn dealt to blocks, in parts of about ``LAID`` links."""
    each = max(1, size * LAID // max(1, links))  # targets of a part
    numbered = pairs.join(nodes.toDF("u", "x"), "u").join(nodes.toDF("v", "y"), "v")
    ends = numbered.select(F.explode(F.array(F.struct(F.col("x").alias("to"), F.col("y").alias("source")), F.struct(F.col("y").alias("to"), F.col("x").alias("source")))).alias("e")).select("e.*")
    place = F.floor(F.col("to") / blocks)
    dealt = ends.select((F.col("to") % blocks).cast("int").alias("block"), F.floor(place / each).cast("int").alias("part"), place.cast("long").alias("place"), "source")

    def lay(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        to = part.column("place").to_numpy() - key[1].as_py() * each
        rank = np.sort(to * size + part.column("source").to_numpy())
        counts = np.bincount(rank // size)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "a": pa.array([counts.astype(np.int64).tobytes()]), "b": pa.array([(rank % size).astype(_whole(size)).tobytes()])})

    return dealt.groupBy("block", "part").applyInArrow(lay, _HELD)


def _whole(size: int) -> type:
    return np.int32 if size < 1 << 31 else np.int64


def _jumps(teleport: DataFrame, blocks: int, wide: int) -> DataFrame:
    """(block, group, part, a, b): the teleports of each group's queries."""

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at, column = np.unique(rows.column("place").to_numpy(), return_inverse=True)
        shares = np.zeros((wide, len(at)))
        shares[rows.column("row").to_numpy(), column] = rows.column("t").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([-1], pa.int32()), "a": pa.array([at.tobytes()]), "b": pa.array([shares.tobytes()]), "group": pa.array([key[1].as_py()], pa.int32())})

    dealt = teleport.where("id IS NOT NULL").select(
        (F.col("id") % blocks).cast("int").alias("block"), F.floor(F.col("nth") / wide).cast("int").alias("group"), (F.col("nth") % wide).cast("int").alias("row"), F.floor(F.col("id") / blocks).cast("long").alias("place"), "t",
    )
    return dealt.groupBy("block", "group").applyInArrow(pack, _HELD + ", group int")


def _places(at: np.ndarray, score: np.ndarray) -> np.ndarray:
    return at[0] + np.arange(score.shape[1]) if len(at) == 1 else at


def _arrays(table: pa.Table, name: str, dtype: type) -> list[np.ndarray]:
    """A binary column's values as arrays, not copied."""
    return [np.frombuffer(x.as_buffer(), dtype) for x in table.column(name)]


def _round(i: int, rounds: int, damping: float, size: int, blocks: int, wide: int):
    """What a block of targets gets in round ``i``; it is divided by their degrees for the next round, but not in the last, where NaN is a node that a query hasn't come to."""

    def run(key: tuple[pa.Scalar, ...], sent: pa.Table, held: pa.Table) -> pa.Table:
        block, group = key[0].as_py(), key[1].as_py()
        mine = -(-(size - block) // blocks)
        before = np.zeros((wide, size)) if sent.num_rows else None
        for origin, at, score in zip(sent.column("origin").to_pylist(), _arrays(sent, "at", np.int64), _arrays(sent, "score", np.float64), strict=True):
            score = score.reshape(wide, -1)
            before[:, _places(at, score) * blocks + origin] = score
        now, degree, jumps, first = np.zeros((wide, mine)), np.zeros(mine), [], 0
        parts = held.column("part").to_pylist()
        for part, nth in sorted((p, n) for n, p in enumerate(parts)):
            a, b = (held.column(c)[nth].as_buffer() for c in ("a", "b"))
            if part < 0:
                jumps = [np.frombuffer(a, np.int64), np.frombuffer(b, np.float64).reshape(wide, -1)]
                continue
            counts, source = np.frombuffer(a, np.int64), np.frombuffer(b, _whole(size))
            some = slice(first, first + len(counts))
            first, degree[some] = some.stop, counts
            if before is not None:
                starts = np.cumsum(counts) - counts  # every node has a link
                for k in range(wide):
                    now[k, some] = np.add.reduceat(before[k][source], starts)
        come = now > 0
        if not damping:
            now[:] = 0
        if jumps:
            at, shares = jumps
            now[:, at] += shares * (1 - damping if i else 1)
            come[:, at] |= shares > 0
        if i == rounds:
            now[~come] = np.nan
        elif damping:
            now *= damping / degree
        else:
            now = come.astype(np.float64)
        at = np.flatnonzero(come.any(axis=0))
        rows = [at[x : x + SENT] for x in range(0, len(at), SENT)]
        return pa.table({
            "block": pa.array([block] * len(rows), pa.int32()), "group": pa.array([group] * len(rows), pa.int32()),
            "at": pa.array([(x[:1] if x[-1] - x[0] < len(x) else x).tobytes() for x in rows], pa.binary()), "score": pa.array([now[:, x].tobytes() for x in rows], pa.binary()),
        })

    return run


def _told(blocks: int, wide: int):
    """Rows of the scores of the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nth in range(batch.num_rows):
                block, group = (batch.column(c)[nth].as_py() for c in (0, 1))
                score = np.frombuffer(batch.column(3)[nth].as_buffer(), np.float64).reshape(wide, -1)
                at = _places(np.frombuffer(batch.column(2)[nth].as_buffer(), np.int64), score)
                for k in range(wide):
                    good = ~np.isnan(score[k])
                    yield pa.RecordBatch.from_arrays([pa.array(at[good] * blocks + block), pa.array(np.full(good.sum(), group * wide + k)), pa.array(score[k][good])], ["id", "nth", "score"])

    return run


#: Queries, and nodes, of a class that meet as many others in one cell.
SEEDED = 4096


def seeds(queries: DataFrame, nodes: DataFrame, cell: int = SEEDED) -> DataFrame:
    """(query_id, node): nodes whose name, or doc if they have one, holds a word of the query of three signs at least, as a literal.

    Queries of equal words are one class, and so are nodes that hold the same of them. Classes are
    matched; their members then meet in cells of ``cell`` by ``cell`` at most. A pair comes out of one
    cell once, so pairs are neither shuffled nor made distinct.
    """
    words = _words(queries)
    asked = _classed(words.select("query_id", "w").distinct(), "query_id", cell)
    held = _classed(_holding(words, nodes), "id", cell)
    spread = lambda df: df.select("class", F.explode("words").alias("w")).distinct()
    met = spread(asked).join(spread(held).withColumnRenamed("class", "other"), "w").select("class", "other").distinct()
    left, right = asked.select("class", F.col("ids").alias("q")), held.select(F.col("class").alias("other"), F.col("ids").alias("n"))
    cells = met.join(left, "class").join(right, "other").select("q", "n").repartition(max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return cells.select(F.explode("q").alias("query_id"), "n").select("query_id", F.explode("n").alias("node"))


def _classed(rows: DataFrame, id_col: str, cell: int) -> DataFrame:
    """(class, words, ids): of ids with words (id_col, w), those with the same set of them, in chunks of ``cell`` or so; written, as it is read twice."""
    sets = rows.groupBy(id_col).agg(F.sort_array(F.collect_set("w")).alias("words"))
    sizes = sets.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64(id_col), F.ceil(F.col("n") / cell)).alias("chunk")
    chunks = sets.join(sizes, "words").groupBy("words", chunk).agg(F.collect_list(id_col).alias("ids"))
    return cut(chunks.select(F.sha2(F.to_json("words"), 256).alias("class"), "words", "ids"), "classes")


def _words(queries: DataFrame) -> DataFrame:
    return cut(queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"(\w{3,})"), 1))).alias("w")), "words")


def _holding(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, w): which of the different words each node holds, found by automata in one pass over the nodes."""
    text = F.lower(F.concat_ws("\n", "name", *(["doc"] if "doc" in nodes.columns else [])))
    return containing(nodes.select("id", text.alias("text")), words.select("w", F.col("w").alias("p")).distinct(), "id", "w", "text", "p")


def callers(edges: DataFrame, name: str) -> DataFrame:
    return edges.where((F.col("type") == "calls") & F.col("dst").endswith(f"::{name}")).select("src").distinct()


def blast_radius(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of all that depend on the start nodes within ``depth`` steps along edges src -> dst, backwards."""
    seen = cut(start.select("node", F.lit(0).alias("depth")), "reached")
    front = seen
    for i in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("dst")).select(F.col("src").alias("node")).distinct().join(seen, "node", "left_anti")
        front = cut(step.withColumn("depth", F.lit(i)), "front")
        seen = cut(seen.unionByName(front), "reached")
    return seen


def file_blast_radius(edges: DataFrame, nodes: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(file, depth, nodes): files whose nodes (id, file) depend on the start files (file) within ``depth`` steps, with how many nodes each has."""
    place = nodes.select("id", "file")
    of = lambda end, name: place.select(F.col("id").alias(end), F.col("file").alias(name))
    files = edges.select("src", "dst").join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    reached = blast_radius(cut(files, "files"), start.select(F.col("file").alias("node")), depth).where("depth > 0")
    counts = nodes.groupBy("file").agg(F.count(F.lit(1)).alias("nodes"))
    return reached.join(counts, F.col("node") == F.col("file")).select("file", "depth", "nodes")


def structural_context(queries: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """The first matching node of each file, by name or doc, the first n files of a query.

    A word's first n files are enough: of the first n files of a query, each is among the first n of
    every word that it holds. So hits are cut down word by word before queries come in.
    """
    words = _words(queries)
    hits = _holding(words, nodes).join(nodes.select("id", "file"), "id").groupBy("w", "file").agg(F.min("id").alias("node"))
    few = hits.withColumn("place", F.row_number().over(Window.partitionBy("w").orderBy("file"))).where(F.col("place") <= n).drop("place")
    each = words.join(few, "w").groupBy("query_id", "file").agg(F.min("node").alias("node"))
    return each.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("file"))).where(F.col("place") <= n)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by kind of node and type of edge."""
    a = nodes.groupBy(F.concat(F.lit("node:"), "kind").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    b = edges.groupBy(F.concat(F.lit("edge:"), "type").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("files"))
    return a.unionByName(b)


#: Articles of a block of ``see_also``, and pairs of an article and a shared keyword that a task counts at once.
BLOCK, COUNTED = 8192, 4_000_000


def see_also(keywords: DataFrame, least: int = 2, n: int = 5, block: int = BLOCK) -> DataFrame:
    """(a, b, common, place): of articles (article, keyword) the n with most keywords in common, ``least`` or more.

    Articles are dealt to blocks, and each two blocks meet in one task, by a key of their own. It
    counts common keywords article by article in the other block's lists of each keyword, and keeps
    the best n of an article; so pairs are never rows, and what is shuffled are blocks, as numbers.
    Exact, and for common keywords a square in the number of articles.
    """
    kind = keywords.schema["article"].dataType
    k = keywords.where("article IS NOT NULL AND keyword IS NOT NULL").select("article", F.xxhash64("keyword").alias("h"))
    sets = cut(k.groupBy("article").agg(F.collect_set("h").alias("set")).where(F.size("set") >= least), "keyword_sets")
    blocks = max(1, -(-sets.count() // block))
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("article"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = dealt.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    cells = both.select(F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("j"), "side", "article", "set")
    schema = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind)), ("common", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        left, right = (part.filter(pc.equal(part.column("side"), s)).sort_by("article") for s in (0, 1))
        a, b, common = _best_common(_lists(left.column("set")), _lists(right.column("set")), key[0].as_py() == key[1].as_py(), least, n)
        return pa.Table.from_arrays([left.column("article").take(pa.array(a)), right.column("article").take(pa.array(b)), pa.array(common)], schema=schema)

    best = cells.groupBy("i", "j").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, common long")
    order = Window.partitionBy("a").orderBy(F.col("common").desc(), "b")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a list column, and how many each row has."""
    return pc.list_flatten(column).to_numpy(), pc.list_value_length(column).to_numpy().astype(np.int64)


def _best_common(left: tuple, right: tuple, same: bool, least: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, common) for the n columns of each row that share most entries with it, ``least`` at least, ties to the smaller column; ``same`` leaves out the row itself."""
    (x, lengths), (y, widths) = left, right
    if not len(lengths) or not len(widths):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    by = np.argsort(y, kind="stable")
    y, columns = y[by], np.repeat(np.arange(len(widths)), widths)[by]
    first = np.searchsorted(y, x, "left")
    met = np.searchsorted(y, x, "right") - first
    ends = np.concatenate([[0], np.cumsum(lengths)])
    sums = np.concatenate([[0], np.cumsum(met)])[ends]  # pairs before each row
    wide, out, at = len(widths), [], 0
    most = max(1, COUNTED // wide)
    while at < len(lengths):
        stop = max(at + 1, min(at + most, int(np.searchsorted(sums, sums[at] + COUNTED, "right")) - 1))
        some = slice(ends[at], ends[stop])
        m = met[some]
        place = np.repeat(first[some] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        row = np.repeat(np.repeat(np.arange(stop - at), lengths[at:stop]), m)
        common = np.bincount(row * wide + columns[place], minlength=(stop - at) * wide).reshape(stop - at, wide)
        if same:
            common[np.arange(stop - at), np.arange(at, stop)] = 0
        # One number that orders by common entries, then by the smaller column.
        rank = common * wide + np.arange(wide - 1, -1, -1)
        top = np.partition(rank, -n, axis=1)[:, -n:] if wide > n else rank
        row, nth = np.nonzero(top // wide >= least)
        good = top[row, nth]
        out.append((row + at, wide - 1 - good % wide, good // wide))
        at = stop
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def related(items: DataFrame) -> DataFrame:
    """(a, b, common), a < b: sites (site, file) that share files; a file of many sites is dealt to many tasks."""
    met = met_pairs(items.distinct().select("file", F.col("site").alias("id")), ["file"])
    return met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count(F.lit(1)).alias("common"))
