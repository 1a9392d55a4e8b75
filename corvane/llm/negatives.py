"""Hard negatives by exact inner products: length buckets, sorted coordinate lists, feasible ranges, exact checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.plans.scratch import cut

#: Vectors of a block, and anchors that meet one at a time.
TILE = 2048
#: Vectors of a bucket differ in length by this factor at most.
RATIO = 1.1
#: Coordinates of an anchor, its largest, whose lists are looked into.
FOCUS = 4
#: Anchors whose candidates are checked together.
GROUP = 32
#: Bounds of an anchor that has none.
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def quantised(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: float) -> DataFrame:
    """(row, id, label, d, norm, key): floor(scale * x) of every vector as the bytes of 32-bit integers, with its length; rows that take no part are left out."""
    types = [df.schema[c].dataType.simpleString() for c in (id_col, label_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, norms, keys = [], [], []
            for v in batch.column(2):
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64)) if v.is_valid else np.full(1, np.nan)
                norm = float(np.sqrt((x * x).sum()))
                fits = norm < 1 << 31  # false for NaN
                dims.append(len(x))
                norms.append(norm if fits else None)
                keys.append(x.astype("<i4").tobytes() if fits else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(keys, pa.binary())], ["id", "label", "d", "norm", "key"])

    usable = df.select(id_col, label_col, vec_col).where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    made = usable.mapInArrow(run, f"id {types[0]}, label {types[1]}, d int, norm double, key binary").where("key IS NOT NULL")
    return made.withColumn("row", F.monotonically_increasing_id())


def bucket(norm: Column) -> Column:
    """The length bucket of a vector; zero vectors have one of their own."""
    return F.when(norm > 0, F.floor(F.log(norm) / float(np.log(RATIO))).cast("int")).otherwise(F.lit(-1_000))


def _ranges(q: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest value that a coordinate of a unit vector can have whose product with a unit vector with q there is theta or more.

    The product is at most the cosine of the difference of the two angles with the axis.
    """
    at, turn = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(theta, -1, 1))
    return np.cos(np.minimum(np.pi, at + turn)) - 1e-6, np.cos(np.maximum(0, at - turn)) + 1e-6


def candidates(q: np.ndarray, q_norm: np.ndarray, least: np.ndarray, unit: np.ndarray, longest: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, vectors): small groups of anchors, and the vectors of a block that can reach the least score of one of them.

    Each of an anchor's FOCUS largest coordinates has a feasible range in the block's sorted list of
    that coordinate; its candidates lie in all of these ranges. Anchors with like coordinates are of
    one group, whose candidates are checked together. Where the least score isn't positive, nothing
    can be left out.
    """
    n, d = unit.shape
    bound = (least > 0) & (q_norm > 0)
    pruned = np.flatnonzero(bound & (q_norm * longest * (1 + 1e-9) >= least))
    if len(pruned) and d and longest > 0:
        order = np.argsort(unit, axis=0, kind="stable")
        lists, place = np.take_along_axis(unit, order, axis=0), np.argsort(order, axis=0)
        way = q[pruned] / q_norm[pruned, None]
        theta = least[pruned] / (q_norm[pruned] * longest) * (1 - 1e-9)
        focus = np.argsort(-np.abs(way), axis=1, kind="stable")[:, :FOCUS]
        value = np.take_along_axis(way, focus, axis=1)
        low, high = _ranges(value, theta[:, None])
        start, stop = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            a, b = np.nonzero(focus == f)
            start[a, b] = np.searchsorted(lists[:, f], low[a, b], "left")
            stop[a, b] = np.searchsorted(lists[:, f], high[a, b], "right")
        like = np.lexsort((value[:, 0], focus[:, 0]))
        for at in range(0, len(like), GROUP):
            group = like[at : at + GROUP]
            inside = np.ones((len(group), n), bool)
            for j in range(focus.shape[1]):
                there = place[:, focus[group, j]].T
                inside &= (there >= start[group, j, None]) & (there < stop[group, j, None])
            yield pruned[group], np.flatnonzero(inside.any(axis=0))
    free = np.flatnonzero(least <= 0)
    for at in range(0, len(free), GROUP):
        yield free[at : at + GROUP], np.arange(n)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k largest scores above LOWEST of each row, ties to the column that comes first; columns are in the order of ids."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), LOWEST)
    row, col = np.nonzero((scores >= least[:, None]) & (scores > LOWEST))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integer vectors: as doubles where none can pass 2^53, else by 64-bit integers."""
    return a @ b.T if exact else (a.astype(np.int64) @ b.astype(np.int64).T)


def _found(k: int, same: bool, out_types: pa.Schema) -> Callable:
    def run(key: tuple[pa.Scalar, ...], vectors: pa.Table, asks: pa.Table) -> pa.Table:
        if not vectors.num_rows or not asks.num_rows:
            return out_types.empty_table()
        vectors = vectors.take(pc.sort_indices(vectors, [("id", "ascending")]))
        read = lambda t: np.frombuffer(b"".join(t.column("key").to_pylist()), "<i4").reshape(t.num_rows, -1).astype(np.float64)
        p, q = read(vectors), read(asks)
        p_norm, q_norm = (t.column("norm").to_numpy() for t in (vectors, asks))
        rows, own = vectors.column("row").to_numpy(), asks.column("row").to_numpy()
        names = np.unique(np.concatenate([t.column("label").to_numpy(zero_copy_only=False) for t in (vectors, asks)]), return_inverse=True)[1]
        label, asked = names[: len(p)], names[len(p) :]
        width = max(len(x) for x in asks.column("low").to_pylist())
        low, high = np.full((len(q), width), HIGHEST), np.full((len(q), width), LOWEST)
        for i, (a, b) in enumerate(zip(asks.column("low").to_pylist(), asks.column("high").to_pylist(), strict=True)):
            low[i, : len(a)], high[i, : len(b)] = a, b
        unit = p / np.where(p_norm > 0, p_norm, 1)[:, None]
        exact = p_norm.max() * q_norm.max() < 1 << 53
        out: list[tuple[np.ndarray, ...]] = []
        for who, which in candidates(q, q_norm, low.min(axis=1).astype(np.float64), unit, float(p_norm.max())):
            if not len(which):
                continue
            s = _products(q[who], p[which], exact)
            fits = (label[which][None, :] == asked[who][:, None]) == same
            fits &= rows[which][None, :] != own[who][:, None]
            for slot in range(width):
                ok = fits & (s >= low[who, slot][:, None]) & (s <= high[who, slot][:, None])
                if ok.any():
                    a, b = _best(np.where(ok, s, LOWEST), k)
                    out.append((own[who[a]], np.full(len(a), slot, np.int32), which[b], s[a, b].astype(np.int64)))
        if not out:
            return out_types.empty_table()
        own_, slot_, at, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.Table.from_arrays([pa.array(own_), pa.array(slot_), vectors.column("id").take(pa.array(at)), pa.array(score)], schema=out_types)

    return run


def search(asks: DataFrame, vectors: DataFrame, k: int, same: bool, seeds: bool, tile: int = TILE) -> DataFrame:
    """(row, slot, id, score): for each bound of each ask, the k best vectors within it, of the same label or of others.

    Asks are (row, label, d, norm, key, low, high) with a lower and an upper score for each slot.
    Vectors fall into length buckets and these into blocks of about ``tile``; an ask goes to the
    buckets whose longest vector can reach its lowest bound. Where labels are the same, buckets are
    kept by label. ``seeds`` looks into one block of the fullest bucket only. Each task has a block
    and a strip of about ``tile`` asks, so none grows with a label, a bucket or the number of asks.
    """
    part = F.col("label").cast("string") if same else F.lit("")
    v = vectors.select(part.alias("part"), bucket(F.col("norm")).alias("bucket"), "d", "row", "id", "label", "norm", "key")
    buckets = v.groupBy("part", "d", "bucket").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("blocks"), F.max("norm").alias("longest"))
    wanted = asks.select(part.alias("part"), "d", "row", "label", "norm", "key", "low", "high")
    strips = wanted.groupBy("part", "d").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("strips"))
    layout = buckets.join(strips, ["part", "d"])
    if seeds:
        layout = layout.groupBy("part", "d", "strips").agg(F.max_by(F.struct("bucket", "blocks", "longest"), F.struct("blocks", "longest")).alias("b")).select("part", "d", "strips", "b.*")
    layout = cut(layout, "negative_blocks")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    placed = v.join(layout, ["part", "d", "bucket"]).withColumn("block", block)
    placed = (placed.where("block = 0") if seeds else placed).withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    least = F.array_min("low")
    can = (least <= 0) | (F.col("norm") * F.col("longest") * (1 + 1e-9) >= least)
    sent = wanted.join(layout, ["part", "d"]).where(can).withColumn("strip", F.pmod(F.xxhash64("row"), F.col("strips")).cast("int"))
    sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(0) if seeds else F.col("blocks") - 1)))
    keys = ["part", "d", "bucket", "block", "strip"]
    kind = vectors.schema["id"].dataType
    types = pa.schema([("row", pa.int64()), ("slot", pa.int32()), ("id", to_arrow_type(kind)), ("score", pa.int64())])
    left = placed.select(*keys, "row", "id", "label", "norm", "key").groupBy(*keys)
    right = sent.select(*keys, "row", "label", "norm", "key", "low", "high").groupBy(*keys)
    found = left.cogroup(right).applyInArrow(_found(k, same, types), f"row long, slot int, id {kind.simpleString()}, score long")
    order = Window.partitionBy("row", "slot").orderBy(F.col("score").desc(), F.col("id").asc())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def best_within(asks: DataFrame, vectors: DataFrame, k: int, same: bool, tile: int = TILE) -> DataFrame:
    """``search`` over all blocks, with lower bounds raised first to the k-th best score of one block.

    No score below that can be among the k best of all, so the first look decides none.
    """
    first = search(asks, vectors, k, same, True, tile).where(F.col("place") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("known"))
    seen = asks.join(first.withColumnRenamed("row", "_r"), F.col("row") == F.col("_r"), "left")
    known = lambda i: F.coalesce(F.try_element_at("known", i), F.lit(LOWEST))
    raised = F.transform("low", lambda x, i: F.greatest(x, known(i)))
    return search(cut(seen.withColumn("low", raised).drop("_r", "known"), "negative_asks"), vectors, k, same, False, tile)


def hard_negatives(
    df: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", tile: int = TILE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of floor(scale * x), exact in integers; higher come first, ties go to
    the smaller id. Anchors are the rows for which ``anchor`` holds, an expression over ``id_col``.
    Of each, the first ``positives`` other rows of its label are its positives; for each of these the
    first ``negatives`` rows of other labels follow whose score is ``low_pct`` to ``high_pct`` per
    cent of the positive's. A positive with a negative score has none.

    Both searches are exact, and their work is the anchors times the vectors at worst: coordinates
    and lengths leave out what can't reach a bound, which helps where bounds are near the product of
    the lengths, and less the lower they are.

    Rows with a null id, label or vector, with a null, NaN or infinite component, or of a length of
    2^31 or more as integers, whose scores wouldn't fit, take no part. Vectors meet only those of as
    many components; empty and zero vectors score 0. A repeated row is another row, so it may be its
    twin's positive. Other columns are not read. An empty table gives an empty one, and so does one
    without anchors.
    """
    rows = cut(quantised(df, id_col, label_col, vec_col, scale), "negative_rows")
    own = rows.withColumn(id_col, F.col("id")).where(anchor).drop(*([id_col] if id_col != "id" else []))
    asks = cut(own.withColumns({"low": F.array(F.lit(LOWEST).cast("long")), "high": F.array(F.lit(HIGHEST).cast("long"))}), "negative_anchors")
    best = cut(best_within(asks.drop("id"), rows, positives, True, tile).select("row", F.col("place").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    s = F.col("positive_score")
    hundreds, rest = F.expr("positive_score div 100"), F.pmod(s, F.lit(100))
    low = (hundreds * low_pct + F.ceil(rest * low_pct / 100)).cast("long")
    high = (hundreds * high_pct + F.floor(rest * high_pct / 100)).cast("long")
    bands = best.where(s >= 0).select("row", F.struct("nth", low.alias("low"), high.alias("high")).alias("b")).groupBy("row").agg(F.sort_array(F.collect_list("b")).alias("b"))
    wanted = asks.drop("low", "high", "id").join(bands.withColumnRenamed("row", "_r"), F.col("row") == F.col("_r"))
    wanted = cut(wanted.select("row", "label", "d", "norm", "key", F.col("b.low").alias("low"), F.col("b.high").alias("high")), "negative_bands")
    found = best_within(wanted, rows, negatives, False, tile).select(F.col("row").alias("f_row"), (F.col("slot") + 1).alias("f_nth"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(asks.select(F.col("row").alias("a_row"), F.col("id").alias("anchor_id")), F.col("row") == F.col("a_row"))
    joined = named.join(found, (F.col("row") == F.col("f_row")) & (F.col("nth") == F.col("f_nth")))
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """All anchors against all rows."""
    return """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
        FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.e) = len(b.e)),
    p AS (SELECT anchor, id AS positive, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
    n AS (SELECT anchor, positive, ps, id, score, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, id) AS rank
        FROM p JOIN s USING (anchor) WHERE NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps)
    SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE rank <= 3"""
