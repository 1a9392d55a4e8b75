"""Test items inside documents: containment search with size-partitioned MinHash sketches, checked by exact shingles."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.textbatch import joined, mix, pieces, shingle_hashes, span_hashes, texts_of, word_edges

K = 5
THRESHOLD = 0.8
#: Words of the items that are broadcast at once, as texts and 16 bytes of hashes a word at most; more items take more passes.
BLOCK = 2_000_000

_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def shingles(text: str | None, k: int = K) -> set[str]:
    """Runs of k words of the lower-cased text; a text of fewer words is one shingle, an empty one none.

    Words are runs of a-z, digits and characters beyond ASCII.
    """
    words = _WORD.findall((text or "").lower())
    if len(words) <= k:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def hashed(texts: list[str], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts' numbers) of all shingles of the lower-cased texts, repeats included."""
    data, begins = joined([t.lower() for t in texts])
    starts, ends = word_edges(data, _APART)
    words = span_hashes(data, starts, ends)
    doc = np.searchsorted(begins, starts, "right") - 1
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    out, of = [], []
    for size in range(1, k + 1):  # a text of fewer than k words is one shingle
        runs = shingle_hashes(words, size)
        at = first[count == size] if size < k else np.flatnonzero(doc[: len(runs)] == doc[k - 1 :]) if len(runs) else first[:0]
        out.append(runs[at])
        of.append(doc[at])
    return np.concatenate(out), np.concatenate(of)


@dataclass
class Part:
    """Items of one size class: their sketches and all their shingles, each as sorted hashes with their items."""

    least: int  # shingles that a document must have to hold any of them
    sketch: np.ndarray
    sketch_item: np.ndarray
    shingle: np.ndarray
    shingle_item: np.ndarray


@dataclass
class Sketches:
    """Items of one block by size class; ``needs`` counts shingles, ``hash_needs`` different hashes."""

    ids: list
    copies: np.ndarray
    texts: list[str]
    sizes: np.ndarray
    needs: np.ndarray
    hash_needs: np.ndarray
    parts: list[Part]
    sets: dict[int, set[str]] = field(default_factory=dict)

    def gate(self) -> np.ndarray:
        """By their top 20 bits, in the sketches of which size classes hashes may be: a bit for each."""
        table = np.zeros(1 << 20, np.uint64)
        for n, part in enumerate(self.parts):
            np.bitwise_or.at(table, part.sketch >> np.uint64(44), np.uint64(1 << n))
        return table

    def shingles_of(self, item: int, k: int) -> set[str]:
        if item not in self.sets:
            self.sets[item] = shingles(self.texts[item], k)
        return self.sets[item]


def sketches(items: list[tuple], threshold: float = THRESHOLD, k: int = K) -> Sketches:
    """Items (id, text, copies) partitioned by size: class c has those of 2^(c - 1) to 2^c - 1 shingles.

    An item of q shingles must share need = ceil(threshold q) of them. Its sketch is the
    q - need + 1 smallest MinHash values of its set. Any document that contains enough of the item
    holds at least one of these, since it misses q - need shingles at most. The sketch length thus
    follows from the size, and no document is missed. Documents with fewer shingles than the least
    need of a class are not held against it.
    """
    ids, copies, texts, sizes, needs, hash_needs = [], [], [], [], [], []
    by_class: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for item, text, n in items:
        q = len(shingles(text, k))
        if not q:
            continue
        values = np.unique(hashed([text or ""], k)[0])
        need = max(1, math.ceil(threshold * q - 1e-9))
        by_class.setdefault(q.bit_length(), []).append((len(ids), values[np.argsort(mix(values))], q - need + 1))
        ids.append(item)
        copies.append(n)
        texts.append(text)
        sizes.append(q)
        needs.append(need)
        hash_needs.append(max(1, need - (q - len(values))))  # shingles that share a hash count once
    parts = []
    for _, group in sorted(by_class.items()):
        flat = []
        for cut in (lambda v, n: v[:n], lambda v, n: v):
            keys = np.concatenate([cut(v, n) for _, v, n in group])
            owners = np.concatenate([np.full(len(cut(v, n)), i) for i, v, n in group])
            order = np.argsort(keys, kind="stable")
            flat += [keys[order], owners[order]]
        parts.append(Part(min(hash_needs[i] for i, _, _ in group), *flat))
    return Sketches(ids, np.array(copies, int), texts, np.array(sizes, int), np.array(needs, int), np.array(hash_needs, int), parts)


def _expand(keys: np.ndarray, owners: np.ndarray, values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, owner) for every value that is among the sorted keys, once for each owner of the key."""
    lo, hi = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
    n = hi - lo
    hit = np.flatnonzero(n)
    reps = n[hit]
    at = np.repeat(lo[hit] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    return np.repeat(docs[hit], reps), owners[at]


def matches(texts: list[str], s: Sketches, gate: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of all texts that contain enough of an item, by exact comparison."""
    hashes, docs = hashed(texts, k)
    bits = gate[hashes >> np.uint64(44)]
    have = np.bincount(docs, minlength=len(texts))
    pairs = []
    for n, part in enumerate(s.parts):
        maybe = np.flatnonzero(bits >> np.uint64(n) & np.uint64(1))
        maybe = maybe[have[docs[maybe]] >= part.least]
        d, i = _expand(part.sketch, part.sketch_item, hashes[maybe], docs[maybe])
        if not len(d):
            continue
        wanted = np.unique(d * len(s.ids) + i)
        inside = np.isin(docs, d)
        both = np.unique(np.stack([docs[inside].astype(np.uint64), hashes[inside]], 1), axis=0)
        d, i = _expand(part.shingle, part.shingle_item, both[:, 1], both[:, 0].astype(np.int64))
        found, shared = np.unique(d * len(s.ids) + i, return_counts=True)
        pairs.append(found[(shared >= s.hash_needs[found % len(s.ids)]) & np.isin(found, wanted)])
    out, doc, held = [], -1, set()
    for pair in np.sort(np.concatenate(pairs)).tolist() if pairs else []:
        if pair // len(s.ids) != doc:
            doc = pair // len(s.ids)
            held = shingles(texts[doc], k)
        item = pair % len(s.ids)
        n = len(held & s.shingles_of(item, k))
        if n >= s.needs[item]:
            out.append((doc, item, n))
    return out


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = BLOCK) -> Iterator[list[tuple]]:
    """The different items (id, text, copies) in blocks of about ``block`` words at most, gathered one block at a time."""
    one = items.groupBy(F.col(id_col).alias("i"), F.col(text_col).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    total = one.agg(F.sum(F.regexp_count(F.coalesce("t", F.lit("")), F.lit(r"\S+")))).first()[0] or 0
    n = -(-total // block)
    for b in range(n):
        part = one if n == 1 else one.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is not None, r[0], r[1] or ""))


def contained(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, k: int = K, block: int = BLOCK) -> DataFrame:
    """(id_col, item_id, shared, item_shingles, containment) for every document and item with containment >= threshold.

    Whole texts are read once for each block of items; no text is shuffled. Ids may be of any type
    that can be compared. Null and empty texts and items match nothing. Texts and items of fewer
    than ``k`` words match only as a whole. Repeated documents or items give a row for each. No
    items, or no documents: an empty table. Other columns are not read, whatever their names. A text of any length is held once, with about 60 bytes
    for each of its words.
    """
    spark = df.sparkSession
    doc_type, item_type = df.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    ddl = f"`{id_col}` {doc_type}, `{item_id}` {item_type}, shared long, item_shingles long, containment double"
    arrow = to_arrow_type(items.schema[item_id].dataType)
    out = None
    source = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    for rows in blocks(items, item_id, item_text, block):
        part = source.mapInArrow(_search(spark.sparkContext.broadcast(sketches(rows, threshold, k)), k, [id_col, item_id, "shared", "item_shingles", "containment"], arrow), ddl)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], ddl) if out is None else out


def _search(shared, k: int, names: list[str], item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        gate = s.gate()
        for piece in pieces(batches, "_text"):
            found = np.array(matches(texts_of(piece, "_text"), s, gate, k), np.int64).reshape(-1, 3)
            doc, item, n = np.repeat(found, s.copies[found[:, 1]], axis=0).T
            sizes = s.sizes[item]
            ids = pa.array([s.ids[i] for i in item.tolist()], item_type)
            yield pa.RecordBatch.from_arrays([piece.column("_id").take(pa.array(doc)), ids, pa.array(n), pa.array(sizes), pa.array(n / sizes)], names)

    return run


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, k: int = K, block: int = BLOCK) -> DataFrame:
    """The rows of ``df``, unchanged, that contain no item; rows with a null id, null or empty texts stay if they contain none, and repeated rows have one fate."""
    out = df
    for rows in blocks(items, item_id, item_text, block):
        shared = df.sparkSession.sparkContext.broadcast(sketches(rows, threshold, k))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            gate = s.gate()
            for piece in pieces(batches, text_col):
                clean = np.ones(piece.num_rows, bool)
                clean[[f[0] for f in matches(texts_of(piece, text_col), s, gate, k)]] = False
                yield piece.filter(pa.array(clean))

        out = out.mapInArrow(run, df.schema)
    return out


def oracle() -> str:
    words = "regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    cut = f"CASE WHEN len(w) > {K} THEN list_transform(range(1, len(w) - {K - 2}), lambda i: array_to_string(w[i:i + {K - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    return f"""WITH d AS (SELECT DISTINCT doc_id, unnest({cut}) AS s FROM (SELECT doc_id, {words} AS w FROM documents)),
    i AS (SELECT DISTINCT item_id, unnest({cut}) AS s FROM (SELECT item_id, {words} AS w FROM benchmark)),
    n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY 1),
    c AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (s) GROUP BY 1, 2)
    SELECT doc_id, item_id, shared, item_shingles, CAST(shared AS DOUBLE) / item_shingles AS containment
    FROM c JOIN n USING (item_id) WHERE shared * 5 >= item_shingles * 4"""
