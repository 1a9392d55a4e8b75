"""Vectors in cells: an index whose number of cells grows with the table, searched in the nearest cells only, and exact pairs by blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.operators.retrieve import PRODUCTS, knn, top_hits
from corvane.plans import sampling
from corvane.plans.scratch import cut, scratch_path

#: Vectors of a block, and queries that meet one at a time.
TILE = 2048

#: Copies of query vectors that leave a task at once.
COPIES = 1 << 13

#: Blocks that vectors are dealt to for pairs, so a vector is sent this often; more once a block has so many bytes of single precision.
BLOCKS, BLOCK_BYTES = 32, 8 << 20


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of one length, without nulls, as a matrix of doubles."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most k centres of the rows of x; a centre that no row is nearest to stays where it was."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less the length of each row."""
    return (centres * centres).sum(1)[None, :] - 2 * x @ centres.T


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_gaps(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Layers:
    """Centres of two layers: those of ``top``, and below each of them those in rows begins[i] to begins[i + 1] of ``low``; a cell is a row of ``low``."""

    top: np.ndarray
    low: np.ndarray
    begins: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: the nearest centre below its nearest top centre."""
        above, out = _nearest(x, self.top), np.zeros(len(x), np.int64)
        for t in np.unique(above):
            at = np.flatnonzero(above == t)
            out[at] = self.begins[t] + _nearest(x[at], self.low[self.begins[t] : self.begins[t + 1]])
        return out


@dataclass
class CellIndex:
    """Vectors (chunk_id, v, cell) written by cell, and the centres. The centres, about the square root of the vectors' number, are what goes to all tasks."""

    table: DataFrame
    layers: Layers

    @property
    def size(self) -> int:
        return len(self.layers.low)

    def _sent(self) -> Broadcast:
        return self.table.sparkSession.sparkContext.broadcast(self.layers)

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, v, cell) for the ``probes`` cells nearest to each query (query_id, v)."""
        sent, kind = self._sent(), queries.schema["query_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = min(probes, len(sent.value.low))
                step = max(1, COPIES // n)
                for i in range(0, batch.num_rows, step):
                    piece = batch.slice(i, step)
                    gaps = _gaps(_stacked(piece.column(1)), sent.value.low)
                    near = np.argpartition(gaps, n - 1, axis=1)[:, :n] if n < gaps.shape[1] else np.tile(np.arange(n), (len(gaps), 1))
                    rows = pa.array(np.repeat(np.arange(piece.num_rows), n))
                    yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), piece.column(1).take(rows), pa.array(near.reshape(-1))], ["query_id", "v", "cell"])

        return queries.select("query_id", "v").mapInArrow(run, f"query_id {kind}, v array<double>, cell long")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, tile: int = TILE) -> DataFrame:
        """The k largest inner products of each query (query_id, embedding) in its nearest cells.

        Cells of more than ``tile`` vectors are split, and so are the queries that ask for one, so a
        task has at most about ``tile`` of each. Null vectors match nothing.
        """
        wanted = queries.where(F.col("embedding").isNotNull() & F.lit(self.layers.low.size > 0)).select("query_id", F.col("embedding").cast("array<double>").alias("v"))
        asked = cut(self.probed(wanted, probes or max(1, self.size // 10)), "probed")
        strips = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("strips"))
        blocks = self.table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"))
        layout = cut(strips.join(blocks, "cell"), "layout")  # a row for each cell that is asked for
        part = lambda x, n: F.pmod(F.xxhash64(x), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = self.table.join(layout, "cell").withColumn("block", part("chunk_id", "blocks")).withColumn("strip", each("strips"))
        right = asked.join(layout, "cell").withColumn("strip", part("query_id", "strips")).withColumn("block", each("blocks"))
        keys = ["cell", "block", "strip"]
        kinds = [queries.schema["query_id"].dataType, self.table.schema["chunk_id"].dataType]
        schema = pa.schema([("query_id", to_arrow_type(kinds[0])), ("chunk_id", to_arrow_type(kinds[1])), ("score", pa.float64())])

        def run(key: tuple, vectors: pa.Table, asks: pa.Table) -> pa.Table:
            if not vectors.num_rows or not asks.num_rows:
                return schema.empty_table()
            vectors = vectors.sort_by("chunk_id")
            x, asked = _stacked(vectors.column("v")).T, _stacked(asks.column("v"))
            step, parts = max(1, PRODUCTS // vectors.num_rows), []
            for i in range(0, len(asked), step):
                s = asked[i : i + step] @ x
                tied = np.round(s, 6)
                least = np.partition(tied, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                row, col = np.nonzero(tied >= least[:, None])
                order = np.lexsort((col, -tied[row, col], row))
                row, col = row[order], col[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[keep], col[keep]
                parts.append((i + row, col, s[row, col]))
            row, col, score = (np.concatenate(part) for part in zip(*parts, strict=True))
            return pa.Table.from_arrays([asks.column("query_id").take(pa.array(row)), vectors.column("chunk_id").take(pa.array(col)), pa.array(score)], schema=schema)

        found = left.select(*keys, "chunk_id", "v").groupBy(*keys).cogroup(right.select(*keys, "query_id", "v").groupBy(*keys)).applyInArrow(run, f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double")
        return top_hits(found, k)

    def probes_for(self, k: int = 10, recall: float = 0.9, sample: int = 200, seed: int = 7) -> int:
        """The fewest cells to probe with which the k best of all vectors are found with this recall.

        Measured on about ``sample`` of the index's own vectors as queries, against all vectors by
        brute force: each true hit tells how many cells must be looked into before its own.
        """
        rows = self.table.where(sampling.chosen(sampling.threshold(sample, self.table.count()), "chunk_id", seed=seed))
        asked = cut(rows.select(F.col("chunk_id").alias("query_id"), "v"), "measured")
        exact = knn(asked.withColumnRenamed("v", "embedding"), self.table.withColumnRenamed("v", "embedding").select("chunk_id", "embedding"), k)
        at = exact.select("query_id", "chunk_id").join(self.table.select("chunk_id", "cell"), "chunk_id").select("query_id", "cell").toPandas()  # k rows a query of the sample
        q = asked.toPandas()
        if not len(q):
            return 1
        gaps = _gaps(np.stack(q["v"].to_numpy()), self.layers.low)
        place = np.argsort(np.argsort(gaps, axis=1), axis=1)
        number = {x: i for i, x in enumerate(q["query_id"])}
        need = np.sort([place[number[x], cell] for x, cell in zip(at["query_id"], at["cell"], strict=True)])
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def build_cells(vectors: DataFrame, path: str | None = None, cells: int | None = None, per_cell: int = 64, seed: int = 1) -> CellIndex:
    """Puts (chunk_id, embedding) into about √N cells, ``cells`` if given, and writes them by cell to ``path``, else to the shared folder.

    Centres are fitted on about ``per_cell`` vectors a cell: the top layer, √cells of them, on the
    driver from at most 256 a centre; the cells below each in a task of its own. All vectors are
    placed. Null vectors are left out; the others must have one length.
    """
    spark = vectors.sparkSession
    rows = cut(vectors.where(F.col("embedding").isNotNull()).select("chunk_id", F.col("embedding").cast("array<double>").alias("v")), "cell_rows")
    n = rows.count()
    if not n:
        return CellIndex(rows.withColumn("cell", F.lit(0).cast("long")), Layers(np.zeros((1, 0)), np.zeros((1, 0)), np.array([0, 1])))
    cells = cells or max(1, round(n**0.5))
    tops = max(1, round(cells**0.5))
    pick = lambda most: rows.where(sampling.chosen(sampling.threshold(most, n), "chunk_id", seed=seed))
    few = pick(256 * tops).select("v").toPandas()["v"]
    few = np.stack(few.to_numpy()) if len(few) else np.stack([rows.first()["v"]])
    top = lloyd(few, tops, seed)
    sent = spark.sparkContext.broadcast(top)
    below = -(-cells // len(top))

    @F.pandas_udf("long")
    def nearest_top(v: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(v.to_numpy()), sent.value) if len(v) else np.zeros(0, np.int64))

    def split(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["v"].to_numpy())
        return pd.DataFrame({"t": key[0], "c": list(lloyd(x[:: max(1, len(x) // (256 * below))], below, seed))})

    fitted = pick(per_cell * cells).withColumn("t", nearest_top("v")).groupBy("t").applyInPandas(split, "t long, c array<double>").toPandas()
    parts = [np.stack(fitted["c"][fitted["t"] == t].to_numpy()) if (fitted["t"] == t).any() else top[t : t + 1] for t in range(len(top))]
    layers = Layers(top, np.concatenate(parts), np.cumsum([0, *map(len, parts)]))
    all_ = spark.sparkContext.broadcast(layers)

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(all_.value.cells(np.stack(v.to_numpy())) if len(v) else np.zeros(0, np.int64))

    path = path or scratch_path(spark, "cells")
    placed = rows.withColumn("cell", cell_of("v"))
    placed.repartitionByRange(F.col("cell"), F.xxhash64("chunk_id")).sortWithinPartitions("cell").write.parquet(path)
    return CellIndex(spark.read.schema(placed.schema).parquet(path), layers)


def knn_cells(queries: DataFrame, vectors: DataFrame, k: int = 10, recall: float = 0.9) -> DataFrame:
    """Approximate inner-product search in a fresh index, with as many probes as the recall takes; ask for a little more, as the sample of queries that measures it is small."""
    index = build_cells(vectors)
    return index.search(queries, k, index.probes_for(k, min(1.0, recall + 0.03)))


# --- exact pairs ---


def block_pairs(vectors: DataFrame, threshold: float, tile: int | None = None) -> DataFrame:
    """(a, b), a < b by id: vectors (id, embedding) with a cosine over ``threshold``; equal vectors are one, see ``vector_classes``.

    Vectors are dealt to blocks, and each two blocks meet in one task, by a key of their own: exact,
    and a square in the number of different vectors. A block has ``tile`` vectors; if none is given
    a share of 1 / BLOCKS, from TILE up to BLOCK_BYTES, so what is sent grows like the table until
    blocks are full. They travel in the precision they have. Null vectors have no pair; zero vectors neither.
    """
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = cut(vectors.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("v")), "pair_rows")
    have = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    tile = tile or max(TILE, min(-(-have["n"] // BLOCKS), BLOCK_BYTES // (4 * max(1, have["dims"] or 1))))
    n = max(1, -(-have["n"] // tile))
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    met = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = met.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")
    kind = vectors.schema["id"].dataType
    schema = pa.schema([("a", to_arrow_type(kind)), ("b", to_arrow_type(kind))])

    def run(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        part = part.sort_by("id")
        x, block = _stacked(part.column("v")), part.column("own").to_numpy()
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        first, second = (np.flatnonzero(block == b) for b in (i, j))
        right, step, found = x[second].T, max(1, PRODUCTS // max(1, len(second))), []
        for at in range(0, len(first), step):
            p, q = np.nonzero(x[first[at : at + step]] @ right > threshold)
            found.append((first[at + p], second[q]))
        p, q = (np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        keep = p < q if i == j else np.ones(len(p), bool)
        low, high = np.minimum(p, q)[keep], np.maximum(p, q)[keep]
        return pa.Table.from_arrays([part.column("id").take(pa.array(low)), part.column("id").take(pa.array(high))], schema=schema)

    return met.groupBy("i", "j").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}")


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(id, rep): the smallest id with an equal vector; zero vectors, which are like none, stand for themselves."""
    keyed = vectors.where(F.col("embedding").isNotNull()).select("id", "embedding", F.xxhash64("embedding").alias("h"))
    some = F.exists("embedding", lambda x: x != 0)
    reps = keyed.where(some).groupBy("h", "embedding").agg(F.min("id").alias("rep"))
    return keyed.where(some).join(reps, ["h", "embedding"]).select("id", "rep").unionByName(keyed.where(~some).select("id", F.col("id").alias("rep")))
