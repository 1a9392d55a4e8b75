"""Token ids in a compact binary form.

Each id is replaced by its rank in the corpus (0 for the most frequent), and ranks are stored in as
few whole bytes as they need, one to four. The lengths stand apart: two bits each, four to a
control byte. A block of the format holds whole documents:

- ``control``: control bytes of all ids of the block, the first id in the lowest two bits,
- ``data``: the bytes of all ranks, lowest byte first,
- ``doc_ids`` and ``ends``: the documents in order, and how many ids of the block end with each.

Blocks are rows of a Parquet table, so that any store which Spark reaches can hold them and a lost
task is written again as a whole. ``part`` and ``block`` order them. Beside the blocks lies
``ranks``, the id of every rank.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.textbatch import BLANK, Lanes, joined_column, mix, pieces
from corvane.plans.scratch import cut, scratch_path

#: Ids of a block, unless one document has more.
BLOCK = 1 << 18

# White space beyond ASCII, or on which regular expression engines disagree, in UTF-8; texts with it are encoded whole.
_ODD_TWO = (0xC285, 0xC2A0)
_ODD_THREE = (0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808C), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, 0xEFBBBF)

# Decoding tables: for each control byte the lengths of its four values and their sum.
_LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) for unsigned values below 2^32."""
    v = np.ascontiguousarray(values, np.dtype("<u4"))
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = extra
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of ``encode_values``, by table lookup on the control bytes."""
    if not n:
        return np.zeros(0, np.uint32)
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(raw, 4)[starts]
    return np.ascontiguousarray(words).view("<u4").reshape(-1) & _MASKS[lengths - 1]


_MAYBE_ODD = np.zeros(256, bool)  # first bytes of such white space
_MAYBE_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = ~_ALNUM[0x21:0x7F]


# ASCII letters and U+00C0 to U+00FF in UTF-8, without the two signs among these.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def chunks(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, documents) of the chunks of all texts, in order.

    They are what `` ?\\S+|\\s+(?!\\S)|\\s+`` finds, a word with the one space before it and the
    white space that is left, with words cut wherever an ASCII sign follows an ASCII letter or
    digit. The tokenizer's own rule splits at each of these borders.
    """
    between = np.zeros(len(data), bool)  # the blanks around the texts
    between[0] = between[begins[1:] - 1] = True
    blank = BLANK[data]
    word = ~blank
    word[1:] &= blank[:-1]
    at = np.flatnonzero(word)  # where words begin
    start = between | word
    start[1:] |= _ALNUM[data[:-1]] & _SIGN[data[1:]]
    start[1:] |= blank[1:] & (between[:-1] | ~blank[:-1])  # where white space begins
    start[at - 1] = True  # its last sign: with the word if it's a space, else alone
    start[at[(data[at - 1] == 0x20) & ~between[at - 1]]] = False
    s = np.flatnonzero(start)
    own = ~between[s]
    return s[own], np.append(s[1:], len(data))[own], (np.cumsum(~own) - 1)[own]


def odd_texts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The numbers of the texts with odd white space."""
    at = np.flatnonzero(_MAYBE_ODD[data[:-2]])
    if not len(at):
        return at
    code = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
    odd = (code < 0x200000) | np.isin(code >> 8, _ODD_TWO) | np.isin(code, _ODD_THREE)
    return np.unique(np.searchsorted(begins, at[odd], "right") - 1)


class Chunks:
    """Numbers of chunks that were met before, told apart by all their bytes.

    A chunk of up to 15 bytes is the pair of integers that its bytes and its length make; pairs are
    looked up in two tables of single places. Chunks that are longer, or that fit in neither table,
    are in a dictionary.
    """

    BITS = 20

    def __init__(self):
        self.n, self.rest = 0, {}
        places = 1 << self.BITS
        self.tables = [(np.uint64(shift), np.zeros(places, np.uint64), np.zeros(places, np.uint64), np.full(places, -1, np.int32)) for shift in (64 - self.BITS, 64 - 2 * self.BITS)]

    @staticmethod
    def _pairs(lanes: Lanes, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, tail = np.zeros(len(s), np.uint64), size.copy()
        full = np.flatnonzero(size >= 8)
        first[full] = lanes.take(s[full], size[full])
        tail[full] -= 8
        return first, lanes.take(s + (size - tail), tail) | size.astype(np.uint64) << np.uint64(56)

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """(number of each chunk, the new ones in the order of their numbers)."""
        out, size = np.full(len(s), -1, np.int32), e - s
        short = np.flatnonzero(size < 16)
        a, b = self._pairs(Lanes(data), s[short], size[short])
        spread, mask = mix(a + mix(b)), np.uint64((1 << self.BITS) - 1)
        left = np.arange(len(short))
        for shift, first, tail, number in self.tables:
            slot = (spread[left] >> shift & mask).astype(np.int64)
            hit = (first[slot] == a[left]) & (tail[slot] == b[left]) & (number[slot] >= 0)
            out[short[left[hit]]] = number[slot[hit]]
            left = left[~hit]
        miss = np.flatnonzero(out < 0)
        if not len(miss):
            return out, []
        raw, new, found = data.tobytes(), {}, []
        held, put = self.rest.get, new.setdefault
        for i, j in zip(s[miss].tolist(), e[miss].tolist(), strict=True):
            chunk = raw[i:j]
            k = held(chunk)
            found.append(put(chunk, self.n + len(new)) if k is None else k)
        out[miss] = found
        chunks = list(new)
        fresh = left[out[short[left]] >= self.n]
        placed = np.zeros(len(chunks), bool)
        for shift, first, tail, number in self.tables:
            slot = (spread[fresh] >> shift & mask).astype(np.int64)
            free = np.flatnonzero(number[slot] < 0)
            taken, which = np.unique(slot[free], return_index=True)
            one = fresh[free[which]]
            first[taken], tail[taken], number[taken] = a[one], b[one], out[short[one]]
            placed[out[short[one]] - self.n] = True
            fresh = fresh[~placed[out[short[fresh]] - self.n]]
        for i in np.flatnonzero(~placed).tolist():
            self.rest[chunks[i]] = self.n + i
        self.n += len(chunks)
        return out, chunks


class Encoder:
    """Ids of texts by the tokenizers library, which sees each chunk once as long as it is remembered.

    New chunks are encoded together, a line feed between them: the tokenizer's rule makes that a
    token of its own. Beyond ``keep`` chunks, or 16 times as many ids, all are forgotten.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        names = self.tokenizer.get_vocab()
        self.bytes_of = np.ones(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.bytes_of[i] = len(name)  # byte-level: one sign for each byte
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        # letters alone, with a space before them or not, are one word of the tokenizer's rule and need no rule
        self.letters = Tokenizer.from_file(path)
        self.letters.pre_tokenizer = Sequence([Split("\n", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        for t in (self.tokenizer, self.letters):
            t.model._resize_cache(0)  # chunks are remembered here
        self.part, self.feed = 1000, self._ids(["\n"])[0][0]
        self._forget()

    def _forget(self) -> None:
        self.chunks = Chunks()
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them belong to each word), encoded in parts with a line feed between words."""
        texts = [b"\n".join(words[i : i + self.part]).decode("utf-8", "surrogatepass") for i in range(0, len(words), self.part)]
        stops = np.cumsum([len(w) for w in words])
        if letters:
            got = np.concatenate([np.array(e.ids, np.int64) for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)])
        else:
            got = np.concatenate([np.array([*ids, self.feed], np.int64) for ids in self._ids(texts)])
            stops += np.arange(len(words))  # the line feeds before
        ends = np.cumsum(self.bytes_of[got])
        last = np.searchsorted(ends, stops)  # the token that ends with each word
        if not (ends[last] == stops).all():
            raise ValueError("the tokenizer joined chunks; it isn't byte-level with the usual rule")
        heads = np.concatenate([[0], last[:-1] + (1 if letters else 2)])
        n = last + 1 - heads
        return got[np.repeat(heads - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def _encode_new(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them belong to each chunk)."""
        letters = np.array([_LETTERS.fullmatch(r) is not None for r in raw], bool)
        blank = np.array([not r.strip() for r in raw], bool)
        sizes, order, parts = np.zeros(len(raw), np.int64), [], []
        for which in (letters, blank, ~letters & ~blank):
            at = np.flatnonzero(which)
            if not len(at):
                continue
            chosen = [raw[i] for i in at.tolist()]
            if which is blank:
                lists = self._ids([r.decode() for r in chosen])
                ids, n = np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists])
            else:
                ids, n = self._encode_words(chosen, which is letters)
            sizes[at] = n
            order.append(at)
            parts.append(ids)
        # ids stand in the order of the groups: bring them into that of the chunks
        at, ids = np.concatenate(order), np.concatenate(parts)
        starts = np.zeros(len(raw), np.int64)
        starts[at] = np.cumsum(sizes[at]) - sizes[at]
        return ids[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].astype(np.uint32), sizes

    def _places(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Which of the held chunks each one is."""
        if len(self.starts) > self.keep or len(self.pool) > 16 * self.keep:
            self._forget()
        place, new = self.chunks.find(data, s, e)
        if new:
            ids, sizes = self._encode_new(new)
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
        return place

    def _whole(self, data: np.ndarray, begins: np.ndarray) -> list[int]:
        """Texts that the library gets as they are: with odd white space, or with what is a token of its own wherever it stands."""
        out = set(odd_texts(data, begins).tolist())
        if self.added:
            found = [m.start() for m in self.added.finditer(data.tobytes())]
            out |= set((np.searchsorted(begins, found, "right") - 1).tolist())
        return sorted(i for i in out if 0 <= i < len(begins) - 1)

    def encode(self, data: np.ndarray, begins: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of ``joined``, each with ``end_id`` after it; how many of them end with each text)."""
        texts = {i: data[begins[i] : begins[i + 1] - 1].tobytes().decode("utf-8", "surrogatepass") for i in self._whole(data, begins)}
        whole = {i: np.array(ids, np.uint32) for i, ids in zip(texts, self._ids(list(texts.values())), strict=True)}
        if whole:
            data = data.copy()
            for i in whole:
                data[begins[i] : begins[i + 1] - 1] = 0x20
        s, e, doc = chunks(data, begins)
        if whole:
            plain = ~np.isin(doc, list(whole))
            s, e, doc = s[plain], e[plain], doc[plain]
        place = self._places(data, s, e) if len(s) else np.zeros(0, np.int64)
        sizes = self.sizes[place]
        lengths = np.bincount(doc, sizes, len(begins) - 1).astype(np.int64) + 1
        for i, ids in whole.items():
            lengths[i] += len(ids)
        ends = np.cumsum(lengths)
        out = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
        mine = np.ones(len(out), bool)
        mine[ends - 1] = False
        for i, ids in whole.items():
            place_of = slice(ends[i] - lengths[i], ends[i] - 1)
            out[place_of], mine[place_of] = ids, False
        stops = np.cumsum(sizes)
        out[mine] = self.pool[np.repeat(self.starts[place] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        return out, ends


_encoders: dict[str, Encoder] = {}


def id_type(vocabulary: str, end_id: int = 0) -> str:
    """The smallest of two unsigned integer types that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def tokenize(df: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kind: str = "<u4", counted: bool = False) -> DataFrame:
    """(id_col, ids): the ids of each whole text with ``end_id`` after them, as unsigned integers of the type ``kind``.

    With ``counted`` there is a third column, ``counts``, and a row more for each task, in which it
    alone is set: how often each id occurs in the rows of the task, as long integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, Encoder(vocabulary))
        total = np.zeros(0, np.int64)
        for piece in pieces(batches, "t"):
            ids, ends = encoder.encode(*joined_column(piece.column("t")), end_id)
            raw = ids.astype(kind)
            offsets = np.concatenate([[0], ends * raw.itemsize]).astype(np.int32)
            columns = [piece.column("i"), pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])]
            if counted:
                total = _added(total, np.bincount(ids))
                columns.append(pa.nulls(len(ends), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["i", "ids", "counts"][: len(columns)])
        if counted:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, to_arrow_type(id_type_)), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], ["i", "ids", "counts"])

    id_type_ = df.schema[id_col].dataType
    ddl = f"i {id_type_.simpleString()}, ids binary{', counts binary' * counted}"
    return df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, ddl).withColumnRenamed("i", id_col)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(max(len(a), len(b)), np.int64)
    out[: len(a)] += a
    out[: len(b)] += b
    return out


def rank_table(tokens: DataFrame) -> np.ndarray:
    """Ids of a counted table of ``tokenize`` from the most frequent to the rarest (ties: smaller id first), with all counts taken.

    What reaches the driver is one count for each id of the vocabulary.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = _added(total, np.frombuffer(raw, np.int64))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(add_up, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    rows.sort(key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], np.uint32)


def _blocks(ranks: np.ndarray, size: int, kind: str):
    rank_of = np.zeros(int(ranks.max()) + 1 if len(ranks) else 1, np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)

    def pack(part: int, block: int, before: int, ids: list, arrays: list[np.ndarray]) -> dict:
        control, data = encode_values(rank_of[np.concatenate(arrays)])
        ends = np.cumsum([len(a) for a in arrays]).tolist()
        return {"part": part, "block": block, "before": before, "doc_ids": ids, "ends": ends, "control": control, "data": data}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, before, held, ids, arrays = TaskContext.get().partitionId(), 0, 0, 0, [], []
        schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, kind)
                if arrays and held + len(values) > size:
                    yield pa.RecordBatch.from_pylist([pack(part, block, before, ids, arrays)], schema)
                    block, before, held, ids, arrays = block + 1, before + held, 0, [], []
                ids.append(doc)
                arrays.append(values)
                held += len(values)
        if arrays:
            yield pa.RecordBatch.from_pylist([pack(part, block, before, ids, arrays)], schema)

    return run


BLOCK_DDL = "part long, block long, before long, doc_ids array<bigint>, ends array<bigint>, control binary, data binary"


def write_tokens(df: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> None:
    """Encodes every whole text and writes the corpus under ``path``: ``blocks`` in ascending id order, and ``ranks``.

    Texts are encoded once; their ids go to the shared folder in a column of two-byte integers
    where the vocabulary allows. Rows are range-partitioned by id, so files follow each other in
    id order. Null and empty texts hold the end id alone; null ids come first; rows with one id
    follow each other in the order of a checksum of their ids. Ids must be whole numbers, or text
    that is one; other ids raise an error. An empty table gives an empty corpus. A text of any
    length is encoded whole, with about 60 bytes for each of its chunks.
    """
    spark = df.sparkSession
    kind = id_type(vocabulary, end_id)
    tokens = cut(tokenize(df, vocabulary, end_id, id_col, text_col, kind, counted=True), "ids", "zstd")
    ranks = rank_table(tokens)
    ordered = tokens.where("counts IS NULL").select(F.col(id_col).cast("long").alias("id"), "ids").orderBy(F.col("id").asc_nulls_first(), F.crc32("ids"))
    ordered.mapInArrow(_blocks(ranks, size, kind), BLOCK_DDL).write.parquet(f"{path}/blocks")
    rows = spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(ranks), dtype=np.int64)), "id": pa.array(ranks.astype(np.int64))}))
    rows.coalesce(1).write.parquet(f"{path}/ranks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document of a corpus, where it starts among all ids, and its ids as in ``tokenize``."""
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n")).collect()  # a number for each file
    bases, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        bases[r["part"]], at = at, at + r["n"]
    ranked = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = ranked[decode_values(row["control"], row["data"], row["ends"][-1])].astype("<u4")
                ends = np.array(row["ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                out = [ids[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
                first = begins + bases[row["part"]] + row["before"]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first), pa.array(out, pa.binary())], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")


def digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the rows of ``read_tokens``."""
    return tokens.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32")
    )


def roundtrip(df: DataFrame, vocabulary: str, **kwargs) -> DataFrame:
    """Writes the corpus to the shared folder and reads the digest back.

    Null and empty texts are the end id alone. Repeated rows are documents of their own, next to each
    other. A very long text is encoded in chunks and held as ids once. Other columns are not read,
    whatever their names. An empty table gives an empty one.
    """
    path = scratch_path(df.sparkSession, "tokens")
    write_tokens(df, path, vocabulary, **kwargs)
    return digest(read_tokens(df.sparkSession, path))

