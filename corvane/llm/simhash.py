"""SimHash near-duplicates by exact comparison of fingerprints, tile against tile."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.textbatch import pieces
from corvane.operators.graph import connected_components
from corvane.plans.scratch import cut

RADIUS = 3
#: Fingerprints of a tile; a tile with more is cut into chunks.
TILE = 4096
#: Shingles of a text that are hashed at once.
STRIP = 1 << 16
#: The three parts of a fingerprint whose population counts place it in a tile.
MASKS = (0x1FFFFF, 0x1FFFFF << 21, 0x3FFFFF << 42)


def fingerprint(raw: bytes, k: int = 3) -> int:
    """The 64-bit fingerprint of a text in UTF-8; words are runs of bytes other than blanks, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    text = b" ".join(raw.lower().split())
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(text)]
    if len(starts) <= k:
        starts, ends = [0], [len(text)] * k
    ends, total = ends[k - 1 :], np.zeros(64, np.int64)
    for at in range(0, len(ends), STRIP):
        hashes = [xxh64_intdigest(text[a:b], 42) for a, b in zip(starts[at : at + STRIP], ends[at : at + STRIP], strict=False)]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(ends), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long; null and empty texts have 0."""
    source = df.select(*keep, F.col(text_col).alias("_text"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in piece.column("_text").to_pylist()]
            fps = np.array([fingerprint(r) for r in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(names))], pa.array(fps)], [*names, "fp"])

    ddl = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{ddl}, fp long")


def steps(radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """Tile offsets within the radius, one of each pair of opposite ones: other tiles can't hold a link.

    The population counts of the three parts of two fingerprints differ, taken together, by no more
    than their bits do.
    """
    return [d for d in product(range(-radius, radius + 1), repeat=3) if sum(map(abs, d)) <= radius and d >= (0, 0, 0)]


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the nodes i and j: the smallest index of each group."""
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return label
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what links between two tiles connect: each linked fingerprint with the first of its group.

    Every pair is compared, in strips; strips' links are merged into groups at once, so a tile of
    near copies gives a star and not all its pairs.
    """
    nodes = a if same else np.concatenate([a, b])
    off, label = (0 if same else len(a)), np.arange(len(nodes))
    touched = np.zeros(len(nodes), bool)
    for lo in range(0, len(a), 128):
        near = np.bitwise_count(a[lo : lo + 128, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i += lo
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            touched[i], touched[j + off] = True, True
            label = _settle(label, i, j + off)
    at = np.flatnonzero(touched & (label != np.arange(len(nodes))))
    return nodes[at], nodes[label[at]]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst): pairs of different fingerprints that connect all that are within the radius.

    ``prints`` has different values in ``fp``. Tiles are keyed by the population counts of three
    parts of a fingerprint; a tile meets only those whose counts differ by the radius at most.
    """
    keyed = prints.select("fp", *[F.bit_count(F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))).cast("int").alias(f"p{i}") for i, m in enumerate(MASKS)])
    keys = ["p0", "p1", "p2"]
    sizes = keyed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("chunks"))  # 22 x 22 x 23 rows at most
    sizes = F.broadcast(cut(sizes, "tile_sizes"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    tiles = cut(keyed.join(sizes, keys).withColumn("chunk", chunk).groupBy(*keys, "chunk").agg(F.collect_list("fp").alias("fps")), "tiles")
    offsets = F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in steps(radius)])
    left = tiles.withColumn("d", F.explode(offsets)).select(
        *[(F.col(f"p{i}") + F.col(f"d.d{i}")).alias(f"p{i}") for i in range(3)], F.col("chunk").alias("left_chunk"), F.col("fps").alias("a"),
        ((F.col("d.d0") == 0) & (F.col("d.d1") == 0) & (F.col("d.d2") == 0)).alias("own"),
    )
    # A tile goes to each chunk that it meets, so the pairs of a full tile's chunks meet under as many keys as it has chunks.
    first = F.when(F.col("own"), F.col("left_chunk")).otherwise(0)
    left = left.join(sizes, keys).withColumn("chunk", F.explode(F.sequence(first, F.col("chunks") - 1))).drop("chunks")
    pairs = left.join(tiles.withColumnRenamed("fps", "b"), [*keys, "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                got = tile_links(*(x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (a, b)), same, radius)
                src.append(got[0])
                dst.append(got[1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], ["src", "dst"])

    return pairs.select("a", "b", (F.col("own") & (F.col("left_chunk") == F.col("chunk"))).alias("same")).mapInArrow(run, "src long, dst long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id_col, fp, component_id) for every row: the smallest id reachable over links of ``radius`` bits at most.

    Equal fingerprints are one node, so copies of any number add nothing to the comparison. Null
    and empty texts have fingerprint 0 and link like any other. Null ids are never a component's
    name unless it has no other. An empty table gives an empty one; other columns are not read,
    whatever their names. A text of any length is worked through in strips, with a few times its bytes.
    """
    prints = cut(with_fingerprints(df, [F.col(id_col).alias("_id")], text_col), "prints")
    nodes = cut(prints.groupBy("fp").agg(F.min("_id").alias("first")), "nodes")
    groups = connected_components(links(nodes, radius))
    linked = cut(nodes.join(groups, nodes["fp"] == groups["node"]).select("fp", "first", "component"), "linked")
    smallest = cut(linked.groupBy("component").agg(F.min("first").alias("least")), "least")
    named = linked.join(smallest, "component").select(F.col("fp").alias("_fp"), "least")
    classes = cut(nodes.join(named, nodes["fp"] == named["_fp"], "left").select(F.col("fp").alias("_fp"), F.coalesce("least", "first").alias("component_id")), "classes")
    return prints.join(classes, prints["fp"] == classes["_fp"]).select(F.col("_id").alias(id_col), "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df``, unchanged, without those whose group holds a smaller id; of rows with one id, all stay or go.

    Null and empty texts are copies of each other. All columns stay; an empty table stays empty.
    """
    classes = near_duplicates(df, id_col, text_col, radius)
    drop = classes.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_drop")).distinct()
    return df.join(drop, df[id_col] == drop["_drop"], "left_anti")
