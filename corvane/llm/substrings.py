"""Long repeated word sequences, by compacting the de Bruijn graph of word windows.

Edges are windows of W consecutive words (between their first and last W - 1 words). A run of edges
that follow each other is compacted into a path wherever the smallest hash of K consecutive words
in them, their anchor, is at one place: such cuts depend on the words alone, so equal sequences
compact into equal paths, except at their two ends. Spark joins then find

- anchors that occur more than once (no other path can hold a repeated edge),
- paths that occur more than once (all their edges are repeated),
- nonbranching pairs of these: every copy of the first is followed by the second, and both have as
  many copies, so nothing else leads into the second. Paths of such pairs are compacted into
  chains, the maximal nonbranching ones, and only a chain's first path is looked up from then on,
- paths that occur once though their anchor doesn't: these are opened again into edges, and so is
  one copy of each repeated path with such an anchor; edges that occur more than once are repeated.

Paths and edges are named by halves of 128-bit BLAKE2b digests of their words. Edges are alike if
both halves agree. Paths, the long spans, are grouped by one half and get the other from their
sources: the coordinates of a path's first and of its last place lead back to the words there. A
chain has the combined digests of its paths (``part_hash``). The first place counts only if its
words have the last one's digest, every other only if they have the first one's. Before a word
goes, the digests of the span around it are taken once more in its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.textbatch import BLANK, joined_column, mix, pieces, shingle_hashes, span_hashes, word_edges
from corvane.plans.scratch import cut

W = 35
K = 8
#: Bits of a sieve: a table of hashes that lets through all that are wanted and some more.
SIEVE_BITS = 27
#: Bytes of text whose windows are held at once: a digest for each of them takes about a hundred times as much.
PIECE = 1 << 19
#: Rows that go to Python at once while spans are found.
ROWS = 2000


class Words:
    """The words of several texts: bytes with one blank between words, where each word lies, and the document of each."""

    def __init__(self, data: np.ndarray, begins: np.ndarray):
        starts, ends = word_edges(data)
        self.doc = np.searchsorted(begins, starts, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(begins)))
        blank = BLANK[data]
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        self.data = np.where(blank, np.uint8(0x20), data)[keep]
        stops = np.cumsum(ends - starts + 1)
        self.starts, self.ends = stops - (ends - starts + 1), stops - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def digests(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A digest of n words from each word, as two integers."""
        raw = memoryview(self.data.tobytes())
        made = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(self.starts[word].tolist(), self.ends[word + n - 1].tolist(), strict=True)]
        return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


class Paths:
    """The paths of several texts: document, first word (in all texts and in its own), number of edges and anchor."""

    def __init__(self, words: Words, w: int = W, k: int = K):
        self.words, doc = words, words.doc
        hashes = words.hashes()
        n = max(0, len(doc) - w + 1)
        self.windows = at = np.flatnonzero(doc[:n] == doc[w - 1 :]) if n else np.zeros(0, np.int64)
        if not len(at):
            self.doc = self.pos = self.n = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            self.start = np.zeros(0, np.int64)
            return
        small = shingle_hashes(hashes, k)
        # the leftmost smallest of the w - k + 1 hashes in each window: high bits of the hash, then the place
        key = (small >> np.uint64(24) << np.uint64(24)) | (np.arange(len(small), dtype=np.uint64) & np.uint64(0xFFFFFF))
        span, width = 1, w - k + 1
        while span * 2 <= width:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        key = np.minimum(key[: len(key) - (width - span)], key[width - span :])[at]
        place = at + ((key & np.uint64(0xFFFFFF)).astype(np.int64) - at & 0xFFFFFF)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (np.diff(at) > 1)
        head = np.flatnonzero(new)
        self.n = np.diff(np.append(head, len(at)))
        self.start = at[head]
        self.doc = doc[self.start]
        self.pos = self.start - words.first[self.doc]
        self.anchor = small[place[head]]


def sieve(values: DataFrame, column: str) -> np.ndarray:
    """The table of a column of hashes: 2^SIEVE_BITS bits, whatever the input.

    Spark ors them by words of 64 bits and puts 4096 words at most into a row, so the driver gets
    the table itself and no rows for hashes.
    """
    place = F.shiftrightunsigned(column, 64 - SIEVE_BITS)
    words = values.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int")).alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    pages = words.groupBy(F.shiftright("w", 12).alias("page")).agg(F.collect_list(F.struct(F.pmod("w", F.lit(4096)).alias("at"), "b")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                page = np.zeros(4096, np.int64)
                page[x.values.field("at").to_numpy()] = x.values.field("b").to_numpy()
                rows.append(page.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["page", "bits"])

    table = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for r in pages.mapInArrow(run, "page long, bits binary").collect():
        table[r["page"] * 4096 : (r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.int64)
    return table


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - SIEVE_BITS)
    return (table.view(np.uint64)[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def occurrence(key: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of a place: the key of a document, a word of it, and how many edges begin there."""
    return mix(key.view(np.uint64) ^ mix(pos.astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, text): rows alike in id and text share a key, and whatever is removed from one is from all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))


def paths_of(piece: pa.RecordBatch, w: int, k: int) -> Paths:
    return Paths(Words(*joined_column(piece.column("text"))), w, k)


def anchors(docs: DataFrame, w: int, k: int) -> DataFrame:
    """(anchor, n): all anchors and how many paths have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=PIECE):
            values, n = np.unique(paths_of(piece, w, k).anchor, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(values), pa.array(n)], ["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def paths(docs: DataFrame, table, w: int, k: int) -> DataFrame:
    """(key, pos, n, anchor, name, next_anchor, next_name) of all paths whose anchor passes the sieve; next is the path
    that follows in the text, null at the text's end and before a path that doesn't pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=PIECE):
            p = paths_of(piece, w, k)
            on = passes(table.value, p.anchor)
            key = piece.column("key").to_numpy()[p.doc[on]]
            names, anchor = p.words.digests(p.start[on], p.n[on] + w - 1)[:, 0], p.anchor[on].view(np.int64)
            at = np.flatnonzero(on)
            last = np.ones(len(at), bool)
            last[:-1] = (np.diff(at) > 1) | (np.diff(p.doc[on]) > 0)
            follows = [pa.array(np.roll(x, -1), mask=last) for x in (anchor, names)]
            columns = [pa.array(key), pa.array(p.pos[on].astype(np.int32)), pa.array(p.n[on].astype(np.int32)), pa.array(anchor), pa.array(names), *follows]
            yield pa.RecordBatch.from_arrays(columns, ["key", "pos", "n", "anchor", "name", "next_anchor", "next_name"])

    return docs.select("key", "text").mapInArrow(run, "key long, pos int, n int, anchor long, name long, next_anchor long, next_name long")


def edges(docs: DataFrame, table, w: int, k: int) -> DataFrame:
    """(key, pos, names, checks): the edges of all paths whose place passes the sieve, with both halves of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=PIECE):
            p = paths_of(piece, w, k)
            key = piece.column("key").to_numpy()[p.doc] if len(p.doc) else np.zeros(0, np.int64)
            on = np.flatnonzero(passes(table.value, occurrence(key, p.pos, p.n)))
            n = p.n[on]
            ends = np.cumsum(n)
            at = np.repeat(p.start[on] - (ends - n), n) + np.arange(n.sum())
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            names, checks = (pa.ListArray.from_arrays(offsets, pa.array(half)) for half in p.words.digests(at, np.full(len(at), w)).T)
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(p.pos[on].astype(np.int32)), names, checks], ["key", "pos", "names", "checks"])

    return docs.select("key", "text").mapInArrow(run, "key long, pos int, names array<bigint>, checks array<bigint>")


def with_places(rows: DataFrame) -> DataFrame:
    """(place) of rows with key, pos and n, as ``occurrence`` has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_signed(occurrence(*(b.column(i).to_numpy().astype(np.int64) for i in range(3))))], ["place"])

    return rows.select("key", "pos", "n").mapInArrow(run, "place long")


def proofs(docs: DataFrame, table, w: int, k: int) -> DataFrame:
    """(key, pos, check): the second half of the digest of every path whose place passes the sieve, read from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, size=PIECE):
            p = paths_of(piece, w, k)
            key = piece.column("key").to_numpy()[p.doc] if len(p.doc) else np.zeros(0, np.int64)
            on = np.flatnonzero(passes(table.value, occurrence(key, p.pos, p.n)))
            checks = p.words.digests(p.start[on], p.n[on] + w - 1)[:, 1]
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(p.pos[on].astype(np.int32)), pa.array(checks)], ["key", "pos", "check"])

    # rows alike in id and text have the same places
    return docs.select("key", "text").mapInArrow(run, "key long, pos int, check long").groupBy("key", "pos").agg(F.min("check").alias("check"))


def part_hash(at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """One half of a path's digest, bound to the word of its chain at which the path begins; a chain has the exclusive or over its paths."""
    return mix(half.view(np.uint64) ^ mix(at.astype(np.uint64) + np.uint64(1)))


def path_kinds(found: DataFrame) -> DataFrame:
    """(anchor, name, n, copies, from, to, next_anchor, next_name) of all different paths: their first and last place and
    the path that follows all of their copies, null if not all have the same; of paths with one copy only the first place."""
    place = F.struct("key", "pos")
    following = [f(c).alias(f"{g}_{c}") for c in ("next_anchor", "next_name") for f, g in ((F.min, "low"), (F.max, "high"))]
    kinds = found.groupBy("anchor", "name").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"), F.count("next_name").alias("followed"), F.min(place).alias("from"), F.max(place).alias("to"), *following)
    one = (F.col("copies") > 1) & (F.col("followed") == F.col("copies")) & (F.col("low_next_anchor") == F.col("high_next_anchor")) & (F.col("low_next_name") == F.col("high_next_name"))
    same = [F.when(one, F.col(f"low_{c}")).alias(c) for c in ("next_anchor", "next_name")]
    return kinds.select("anchor", "name", "n", "copies", "from", F.when(F.col("copies") > 1, F.col("to")).alias("to"), *same)


def chains(kinds: DataFrame) -> DataFrame:
    """(anchor, name, head_anchor, head_name, at) of all repeated paths: the first path of their chain and the word of it at which they begin.

    ``kinds`` has one row a path: anchor, name, n, copies, its first place ("from"), and the anchor and name that follow
    it in all of its copies, if that is so. All paths of a chain have their first places in one text, one after the other,
    as copies keep their order; so chains of any length are numbered there, without rounds.
    """
    repeated = kinds.where("copies > 1")
    before = repeated.where("next_name is not null").select(
        F.col("next_anchor").alias("anchor"), F.col("next_name").alias("name"), F.col("copies").alias("copies_before"), F.col("anchor").alias("before_anchor"), F.col("name").alias("before_name")
    )
    # as many copies on both sides: each copy of the second path is then one that follows the first
    linked = repeated.join(before.withColumnRenamed("copies_before", "copies"), ["anchor", "name", "copies"], "left")
    text = Window.partitionBy("from.key").orderBy("from.pos", "anchor", "name")
    follows = (F.lag("name").over(text) == F.col("before_name")) & (F.lag("anchor").over(text) == F.col("before_anchor")) & (F.lag(F.col("from.pos") + F.col("n")).over(text) == F.col("from.pos"))
    rows = linked.withColumn("head", ~F.coalesce(follows, F.lit(False)))
    first = F.last(F.when(F.col("head"), F.struct("anchor", "name", F.col("from.pos").alias("pos"))), ignorenulls=True)
    rows = rows.withColumn("first", first.over(text.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("anchor", "name", F.col("first.anchor").alias("head_anchor"), F.col("first.name").alias("head_name"), (F.col("from.pos") - F.col("first.pos")).alias("at"))


def combined(parts: DataFrame) -> DataFrame:
    """(anchor, name, from, n, parts, whole, first, last) of chains, by their first path, from the paths with their proofs:
    whole, first and last are the combined halves of the digests, by name, at the first place and at the last."""
    halves = ["name", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("at").to_numpy()
            made = [_signed(part_hash(at, b.column(c).to_numpy())) for c in halves]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("head_anchor", "head_name", "key", "pos", "n")], *made], ["anchor", "name", "key", "pos", "n", "whole", "first", "last"])

    rows = parts.select("head_anchor", "head_name", "from.key", "from.pos", "n", "at", *halves)
    rows = rows.mapInArrow(run, "anchor long, name long, key long, pos int, n int, whole long, first long, last long")
    sums = [F.bit_xor(c).alias(c) for c in ("whole", "first", "last")]
    out = rows.groupBy("anchor", "name").agg(F.min("key").alias("key"), F.min("pos").alias("pos"), F.sum("n").cast("int").alias("n"), F.count(F.lit(1)).cast("int").alias("parts"), *sums)
    return out.select("anchor", "name", F.struct("key", "pos").alias("from"), "n", "parts", "whole", "first", "last")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", w: int = W, k: int = K) -> DataFrame:
    """(key, pos, n, parts, name, check): runs of n windows from word ``pos`` that all occur elsewhere too, and the digest of the words at another of their places.

    A run is a chain of ``parts`` paths, or one window (``parts`` is 0). Keys are as in ``keyed``;
    places are ordered by key and word. Rows of a common anchor or name meet in joins of two plain
    shuffles, which adaptive execution can split.
    """
    spark = df.sparkSession
    docs = keyed(df, id_col, text_col)
    share = spark.sparkContext.broadcast
    wanted = anchors(docs, w, k).where("n > 1")
    found = cut(paths(docs, share(sieve(wanted, "anchor")), w, k), "paths")
    place = F.struct("key", "pos")
    kinds = cut(path_kinds(found), "path_kinds")
    mixed = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("anchor"), "mixed_anchors")
    open_ = cut(kinds.join(mixed, "anchor", "left_semi").select("from.key", "from.pos", "n"), "open_paths")
    opened = cut(edges(docs, share(sieve(with_places(open_), "place")), w, k), "edges")
    each = opened.select("key", F.col("pos").alias("at"), F.posexplode(F.arrays_zip("names", "checks")).alias("i", "d"))
    each = each.select("key", (F.col("at") + F.col("i")).alias("pos"), F.col("d.names").alias("name"), F.col("d.checks").alias("check"))
    again = cut(each.groupBy("name", "check").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "repeated_edges")
    ends = kinds.where("copies > 1").select("anchor", "name", "n", F.explode(F.array("from", "to")).alias("end")).select("anchor", "name", "n", "end.key", "end.pos")
    proved = proofs(docs, share(sieve(with_places(ends), "place")), w, k)
    sources = ends.join(proved, ["key", "pos"]).groupBy("anchor", "name").agg(F.min("n").alias("n"), F.min(place).alias("from"), F.min_by("check", place).alias("first"), F.max_by("check", place).alias("last"))
    sources = cut(combined(sources.join(chains(kinds), ["anchor", "name"])), "chains")
    check = F.when(place == F.col("from"), F.col("last")).otherwise(F.col("first")).alias("check")
    long = found.select("key", "pos", "anchor", "name").join(sources, ["anchor", "name"]).select("key", "pos", "n", "parts", F.col("whole").alias("name"), check)
    short = each.join(again, ["name", "check"]).select("key", "pos", F.lit(1).alias("n"), F.lit(0).alias("parts"), "name", "check")
    return long.unionByName(short)


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ROWS rows at most, as whole texts lie in them on both sides; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = int(spark.conf.get(key))
    spark.conf.set(key, min(own, ROWS) if own > 0 else ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, own)


def remove_repeats(df: DataFrame, keep: list[str | Column], id_col: str = "doc_id", text_col: str = "text", w: int = W, k: int = K, with_text: bool = False) -> DataFrame:
    """``keep``, n_words, n_removed and kept_sha256 (and kept_text if asked for) of every row.

    Words are runs of characters other than blanks. Each word in a window of ``w`` words that starts
    at another place too, in any document, is removed; the windows of the input count. The words
    kept are joined by single spaces. Texts of fewer than ``w`` words, null ones (no words) among
    them, lose nothing. Rows that repeat whole lose everything, from ``w`` words on. Null ids are
    ids like others. An empty table gives an empty one. One text is held with about 40 bytes for
    each of its words and its bytes three times over; nothing grows with the number of its copies. Columns besides ``keep`` are not read, whatever their names.
    Texts that can't have a repeated span, as a sieve of the keys with spans tells, stay where they are.
    """
    with short_batches(df.sparkSession):
        spans = repeated_spans(df, id_col, text_col, w, k)
        # as a set, so that rows alike in id and text, which share a key, add nothing: at most two spans for each word of one text
        packed = spans.groupBy("key").agg(F.collect_set(F.struct("pos", "n", "parts", "name", "check")).alias("spans"))
        packed = cut(packed.select(F.col("key").alias("_spans_key"), "spans"), "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(*keep, text.alias("_text"), F.xxhash64(F.col(id_col), text).alias("_key"))
    names = source.columns[:-2]
    gate = df.sparkSession.sparkContext.broadcast(sieve(packed, "_spans_key"))
    schema = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in source.columns)

    def gated(batches: Iterator[pa.RecordBatch], on: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = passes(gate.value, batch.column("_key").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(at == on))

    # only texts that may have spans travel to them; a full sieve sends all
    met = source.mapInArrow(lambda batches: gated(batches, True), schema)
    met = met.join(packed, F.col("_key") == F.col("_spans_key"), "left").select(*names, "_text", "spans")
    extra = ", kept_text string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE):
            words = Words(*joined_column(piece.column("_text")))
            raw = words.data.tobytes()
            total, gone, sums, kept = [], [], [], []
            for i, mark in enumerate(removed(words, piece.column("spans"), w, k)):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                if mark is None or not mark.any():
                    left, body = hi - lo, raw[words.starts[lo] : words.ends[hi - 1]] if hi > lo else b""
                else:
                    stay = lo + np.flatnonzero(~mark)
                    left, body = len(stay), b" ".join([raw[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)])
                total.append(hi - lo)
                gone.append(hi - lo - left)
                sums.append(hashlib.sha256(body).hexdigest())
                kept.append(body.decode("utf-8", "surrogatepass") if with_text else None)
            columns = [*[piece.column(i) for i in range(len(names))], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept)] * with_text, [*names, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    ddl = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    result = f"{ddl}, n_words long, n_removed long, kept_sha256 string{extra}"
    alone = source.mapInArrow(lambda batches: run(b.append_column("spans", pa.nulls(b.num_rows)) for b in gated(batches, False)), result)
    return met.mapInArrow(run, result).unionByName(alone)


def removed(words: Words, spans: pa.Array, w: int, k: int = K) -> Iterator[np.ndarray | None]:
    """For each text which words go; None if no span is given. A span counts if the words there have the digest of its source's words."""
    p: Paths | None = None
    for i, s in enumerate(spans):
        if not s.is_valid or not len(s.values):
            yield None
            continue
        pos, n, parts, name, check = (s.values.field(f).to_numpy().astype(np.int64) for f in ("pos", "n", "parts", "name", "check"))
        size = int(words.first[i + 1] - words.first[i])
        at = words.first[i] + pos
        ok = (pos >= 0) & (pos + n + w - 1 <= size)
        one = np.flatnonzero(ok & (parts == 0))
        own = words.digests(at[one], n[one] + w - 1)
        ok[one] = (own[:, 0] == name[one]) & (own[:, 1] == check[one])
        run = np.flatnonzero(ok & (parts > 0))
        if len(run):
            p = p or Paths(words, w, k)
            ok[run] = proven_chains(p, at[run], n[run], parts[run], name[run], check[run], w)
        ok = np.flatnonzero(ok)
        steps = np.zeros(size + 1, np.int64)
        np.add.at(steps, pos[ok], 1)
        np.add.at(steps, pos[ok] + n[ok] + w - 1, -1)
        yield np.cumsum(steps[:-1]) > 0


def proven_chains(p: Paths, at: np.ndarray, n: np.ndarray, parts: np.ndarray, name: np.ndarray, check: np.ndarray, w: int) -> np.ndarray:
    """Which chains are the paths that begin at word ``at`` of the texts: as many, as long, and with the same combined digests."""
    head = np.searchsorted(p.start, at)
    ok = head + parts <= len(p.start)
    last = np.where(ok, head + parts - 1, 0)
    ok &= (p.start[np.where(ok, head, 0)] == at) & (p.start[last] + p.n[last] == at + n)
    some = np.flatnonzero(ok)
    if len(some):
        begins = np.cumsum(parts[some]) - parts[some]
        each = np.repeat(head[some] - begins, parts[some]) + np.arange(parts[some].sum())
        offset = p.start[each] - np.repeat(at[some], parts[some])
        own = p.words.digests(p.start[each], p.n[each] + w - 1)
        halves = [np.bitwise_xor.reduceat(part_hash(offset, np.ascontiguousarray(own[:, h])), begins).view(np.int64) for h in (0, 1)]
        ok[some] = (halves[0] == name[some]) & (halves[1] == check[some])
    return ok
