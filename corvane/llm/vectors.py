"""Near-duplicate vectors by cosine: a pigeonhole over subspaces, range joins, and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import connected_components
from corvane.plans.scratch import cut

#: Dimensions of a block; vectors shorter than two blocks are halved.
BLOCK = 16
#: Width of a cell of the range join, in radii of its block.
WIDE = 2
#: Vectors that meet as many others in one task; longer ones than 128 dimensions are fewer in proportion.
TILE = 4096
# Roles of a vector in a square of the grid of a cell: row strip, column strip, guest from the cell below.
ROW, COLUMN, GUEST = 0, 1, 2


def rotation(d: int, seed: int = 17) -> np.ndarray:
    """A fixed orthogonal matrix, so that no coordinate of the input has a block to itself."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def edges(d: int) -> list[int]:
    """Where the blocks of d dimensions begin, and d."""
    return [*range(0, d, min(BLOCK, -(-d // 2))), d]


def budgets(d: int, threshold: float) -> np.ndarray:
    """Squared distance that each block may have, in proportion to its dimensions.

    Unit vectors with cosine c are 2 (1 - c) apart, squared. Blocks' squared distances add up to
    that, so in one block at least they are within its part. A grain is added for rounding.
    """
    return 2 * (1 - threshold) * np.diff(edges(d)) / d + 1e-9


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def with_keys(df: DataFrame, id_col: str, label_col: str, vec_col: str) -> DataFrame:
    """(id, label, key): the bytes of each vector; null where it can't link."""
    kind = "<f8" if df.schema[vec_col].dataType.elementType.simpleString() == "double" else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for v in batch.column(2):
                x = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and len(v.values) else np.zeros(1, kind)
                keys.append(x.tobytes() if np.isfinite(x).all() and x.any() and np.isfinite((x.astype(float) ** 2).sum()) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["id", "label", "key"])

    types = [df.schema[c].dataType.simpleString() for c in (id_col, label_col)]
    return df.select(id_col, label_col, vec_col).mapInArrow(run, f"id {types[0]}, label {types[1]}, key binary")


def with_cells(groups: DataFrame, threshold: float, kind: str) -> DataFrame:
    """``groups`` with ``d`` and ``cells``: for each block (cell, reaches).

    A cell is a stretch of the block's first coordinate, ``WIDE`` radii long; a vector reaches the
    next cell if it lies within a radius of it. The radius has a grain more than the budget, so
    rounding parts no pair that is within it.
    """
    size = np.dtype(kind).itemsize
    place = pa.struct([("cell", pa.int64()), ("reaches", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("key").to_pylist()
            dims = np.array([len(r) // size for r in raw], np.int64)
            cells: list = [None] * len(raw)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = unit([raw[i] for i in at], kind) @ rotation(int(d))[:, edges(int(d))[:-1]]
                x /= WIDE * np.sqrt(budgets(int(d), threshold) + 1e-9)
                home = np.floor(x)
                reaches = x - home >= 1 - 1 / WIDE
                for i, c, r in zip(at, home.astype(int).tolist(), reaches.tolist(), strict=True):
                    cells[i] = [{"cell": p, "reaches": q} for p, q in zip(c, r, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int64()), pa.array(cells, pa.list_(place))], [*batch.schema.names, "d", "cells"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(run, f"{ddl}, d long, cells array<struct<cell: bigint, reaches: boolean>>")


def compare(a: np.ndarray, b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, block: int, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links of a, links of b, nodes, their roots) between two tiles of unit vectors in one block.

    Pairs within the block's budget are candidates; a candidate links if the cosine in double
    precision reaches the threshold, and counts only in the first block in which it is one. Nodes
    number a's vectors, then b's; each but the root of what links is named once.
    """
    from corvane.llm.simhash import _settle

    d = a.shape[1]
    limit, turn = budgets(d, threshold), rotation(d)
    starts = edges(d)
    ra, rb = a @ turn, b @ turn
    part = slice(starts[block], starts[block + 1])
    pa_, pb = ra[:, part], rb[:, part]
    na, nb = (pa_ * pa_).sum(1), (pb * pb).sum(1)
    gaps = lambda x, y, upto: np.add.reduceat((ra[x, : starts[upto]] - rb[y, : starts[upto]]) ** 2, starts[:upto], axis=1) <= limit[:upto]
    links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    off, label = (0 if same else len(a)), np.arange(len(a) if same else len(a) + len(b))
    for lo in range(0, len(a), 256):
        near = na[lo : lo + 256, None] + nb[None, :] - 2 * pa_[lo : lo + 256] @ pb.T <= limit[block] + 1e-9  # some more than the budget; ``gaps`` decides
        i, j = np.nonzero(near)
        i += lo
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            ok = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
            x, y = x[ok], y[ok]
            if len(x):
                fits = gaps(x, y, block + 1)  # one formula for this block and those before it
                ok = fits[:, block] & ~fits[:, :block].any(1)
                x, y = x[ok], y[ok]
            if len(x):
                links_a += np.bincount(x, weight_b[y], len(a)).astype(np.int64)
                (links_a if same else links_b)[:] += np.bincount(y, weight_a[x], len(b)).astype(np.int64)
                label = _settle(label, x, y + off)
    at = np.flatnonzero(label != np.arange(len(label)))
    return links_a, links_b, at, label[at]


def squares(cells: DataFrame, tile: int) -> DataFrame:
    """(label, d, block, cell, i, j, role, gid, n, key): the vectors of each square of work.

    Pairs to test in a cell are those of its own vectors, and of these with the guests that reach
    it from the cell below. Both are cut into strips of about ``tile`` vectors; the pairs of row
    strip i with column strip j, and of guest strip i with column strip j, are a square, so no
    task holds more than three strips however full a cell is. In a cell of one strip each vector
    is there once.
    """
    keys = ["label", "d", "block", "cell"]
    placed = cells.select("label", "d", "gid", "n", "key", F.posexplode("cells").alias("block", "at"))
    both = F.array(F.struct(F.col("at.cell").alias("cell"), F.lit(False).alias("guest")), F.struct((F.col("at.cell") + 1).alias("cell"), F.lit(True).alias("guest")))
    stays = F.slice(both, 1, F.when(F.col("at.reaches"), 2).otherwise(1))
    placed = placed.select("label", "d", "block", "gid", "n", "key", F.explode(stays).alias("at")).select("label", "d", "block", "gid", "n", "key", "at.cell", "at.guest")
    strips = lambda rows: F.ceil(rows * F.greatest(F.col("d"), F.lit(128)) / F.lit(128 * tile)).cast("int")
    sizes = placed.groupBy(*keys).agg(strips(F.count_if(~F.col("guest"))).alias("homes"), strips(F.count_if("guest")).alias("guests"))
    sizes = cut(sizes.where("homes > 0"), "cell_sizes")
    strip = F.pmod(F.xxhash64("gid"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    places = F.expr(f"""CASE WHEN guest THEN transform(sequence(0, homes - 1), j -> struct(strip AS i, j AS j, {GUEST} AS role))
        ELSE concat(transform(filter(sequence(0, homes - 1), j -> j > strip), j -> struct(strip AS i, j AS j, {ROW} AS role)),
                    transform(sequence(0, greatest(strip, guests - 1)), i -> struct(i AS i, strip AS j, {COLUMN} AS role))) END""")
    dealt = placed.join(sizes, keys).withColumn("strip", strip).select(*keys, "gid", "n", "key", F.explode(places).alias("to"))
    return dealt.select(*keys, "to.i", "to.j", "to.role", "gid", "n", "key")


def _found(kind: str, threshold: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block, i, j = (key[at].as_py() for at in (2, 4, 5))
        role, gid, n = (rows.column(c).to_numpy() for c in ("role", "gid", "n"))
        x = unit(rows.column("key").to_pylist(), kind)
        column = np.flatnonzero(role == COLUMN)
        work = [(np.flatnonzero(role == r), False) for r in (ROW, GUEST)] + ([(column, True)] if i == j else [])
        src, dst, links = [], [], []
        for at, same in work:
            if not len(at) or not len(column):
                continue
            la, lb, node, root = compare(x[at], x[column], n[at], n[column], block, same, threshold)
            gids, counts = (gid[at], la) if same else (np.concatenate([gid[at], gid[column]]), np.concatenate([la, lb]))
            hit = np.flatnonzero(counts)
            src += [gids[node], gids[hit]]
            dst += [gids[root], np.zeros(len(hit), np.int64)]
            links += [np.zeros(len(node), np.int64), counts[hit]]
        none = [np.zeros(0, np.int64)]
        return pa.table({name: np.concatenate(none + part) for name, part in (("src", src), ("dst", dst), ("links", links))})

    return run


def near_duplicates(df: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and the cosine of their vectors is ``threshold`` or more.
    Equal vectors of a label are one node with a weight, so copies of any number are never paired.
    Nodes are rotated and cut into blocks of ``BLOCK`` dimensions; in each block a range join on its
    first coordinate brings together what may be within the block's budget: a cell's own vectors,
    and those within a radius below it. Full cells are dealt to a grid of tasks (``squares``);
    tasks return counts and stars, never pairs.

    Null labels and vectors that are null, empty, zero or hold null, NaN or infinite components
    link with nothing: n_links 0, their own component. So do rows with a null id, whose component
    is null and kept false. Rows with one id are rows like others. Vectors of different lengths
    never link. An empty table gives an empty one; other columns are not read.
    """
    kind = "<f8" if df.schema[vec_col].dataType.elementType.simpleString() == "double" else "<f4"
    rows = cut(with_keys(df, id_col, label_col, vec_col), "vectors")
    able = F.col("label").isNotNull() & F.col("key").isNotNull() & F.col("id").isNotNull()
    groups = rows.where(able).groupBy("label", "key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.withColumn("gid", F.monotonically_increasing_id()), "vector_groups")
    work = squares(with_cells(groups.select("label", "gid", "n", "key"), threshold, kind), tile).groupBy("label", "d", "block", "cell", "i", "j")
    found = cut(work.applyInArrow(_found(kind, threshold), "src long, dst long, links long"), "vector_links")
    counts = found.where("links > 0").groupBy(F.col("src").alias("c_gid")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("links = 0").select("src", "dst"))
    linked = cut(groups.select("gid", "first").join(parts, F.col("gid") == F.col("node")).select("gid", "first", "component"), "vector_parts")
    least = cut(linked.groupBy("component").agg(F.min("first").alias("least")), "vector_least")
    named = linked.join(least, "component").select(F.col("gid").alias("n_gid"), "least")
    result = groups.join(counts, F.col("gid") == F.col("c_gid"), "left").join(named, F.col("gid") == F.col("n_gid"), "left").select(
        F.col("label").alias("r_label"), F.col("key").alias("r_key"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("least", "first").alias("component_id"),
    )
    result = cut(result, "vector_result")
    joined = rows.where(able).join(result, (F.col("label") == F.col("r_label")) & (F.col("key") == F.col("r_key"))).select("id", "n_links", "component_id")
    alone = rows.where(~able).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def oracle(threshold: float = 0.93) -> str:
    """All pairs of a label, and components by walking links; for small tables."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_count(e) = len(e)
           AND len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
              AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {threshold}),
    walk AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT w.x, l.y FROM walk w JOIN links l ON w.y = l.x)
    SELECT vec_id, coalesce(n, 0) AS n_links, least AS component_id, vec_id = least AS kept
    FROM (SELECT x AS vec_id, min(y) AS least FROM walk GROUP BY 1)
    LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1) USING (vec_id)"""
