"""Language of a text by unigram pieces, summed over all ways to cut its words into pieces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.textbatch import mix, pieces, span_hashes, texts_of
from corvane.plans import sampling

MARK = 0x2581  # begins a word in the vocabulary
#: Letters whose pieces are looked up at once; a longer word is walked through in strips of as many, with the same result.
STRIP = 1 << 16
#: Chance of a letter that no piece has.
UNKNOWN = 1e-7


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point, whether it is a letter, and its lower-case form where that is one letter."""
    import regex

    every = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
    letter = np.zeros(0x110000, bool)
    joined = "".join(every)
    for m in regex.finditer(r"\p{L}+", joined):
        letter[m.start() : m.end()] = True
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letter):
        low = every[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letter, lower


def chains(codes: np.ndarray, inside: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... ``longest`` letters: places with that many letters of their word up to them, and hashes of these letters, a new scramble for each.

    ``inside`` counts the letters before each in its word.
    """
    h = letters = mix(codes.astype(np.uint64) + np.uint64(1))
    at = np.arange(len(codes))
    yield at, h
    for d in range(1, longest):
        at = at[inside[at] >= d]
        h, before = np.zeros(len(codes), np.uint64), h
        h[at] = mix(before[at - 1] * np.uint64(3) + letters[at])
        yield at, h[at]


class Vocabulary:
    """The pieces of letters of a sentencepiece model, found by hash."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = {model.id_to_piece(i) for i in range(model.get_piece_size())}
        self.pieces = sorted(p for p in names if p.strip("▁").isalpha() and p == p.lower() and "▁" not in p[1:])
        self.longest = max(map(len, self.pieces))
        codes = np.concatenate([np.array([ord(c) for c in p], np.uint32) for p in self.pieces])
        sizes = np.array([len(p) for p in self.pieces])
        first, piece = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        hashes = np.zeros(len(sizes), np.uint64)
        for d, (at, h) in enumerate(chains(codes, np.arange(len(codes)) - first[piece], self.longest), 1):
            whole = at - first[piece[at]] == d - 1
            hashes[piece[at[whole]]] = h[whole]  # the last to come is the whole piece
        # two hash tables of single places; what fits in neither is in a short sorted list
        self.tables, left = [], np.arange(len(hashes))
        for shift in (44, 20):
            keys, ids = np.zeros(1 << 20, np.uint64), np.full(1 << 20, -1, np.int32)
            slot = (hashes[left] >> np.uint64(shift)) & np.uint64((1 << 20) - 1)
            _, first = np.unique(slot, return_index=True)
            keys[slot[first]], ids[slot[first]] = hashes[left[first]], left[first]
            self.tables.append((np.uint64(shift), keys, ids))
            left = np.delete(left, first)
        order = left[np.argsort(hashes[left])]
        self.rest = (hashes[order], order)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each piece, -1 for none."""
        out = np.full(len(hashes), -1, np.int32)
        for shift, keys, ids in self.tables:
            slot = (hashes >> shift) & np.uint64((1 << 20) - 1)
            hit = keys[slot] == hashes
            out[hit] = ids[slot[hit]]
        if len(self.rest[0]):
            at = np.minimum(np.searchsorted(self.rest[0], hashes), len(self.rest[0]) - 1)
            hit = self.rest[0][at] == hashes
            out[hit] = self.rest[1][at[hit]]
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letters, starts, ends, documents): all runs of letters, lower-cased."""
    letter, lower = _letters()
    lengths = np.array([len(t) + 1 for t in texts])
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate([[False], letter[codes]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turns[0::2], turns[1::2]
    return lower[codes], starts, ends, np.searchsorted(np.cumsum(lengths), starts, "right")


class Words:
    """Different words, longest first, each with its mark; letter x of ``flat`` is letter x - off[w] of word w."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary):
        self.vocab, n = vocab, len(starts)
        self.size = ends - starts + 1
        self.off = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(n), self.size)
        self.flat = np.full(len(self.word), MARK, np.uint32)
        letter = np.ones(len(self.flat), bool)
        letter[self.off] = False
        self.flat[letter] = codes[(np.arange(len(self.flat)) - self.off[self.word] - 1 + starts[self.word])[letter]]
        self.lo = self.hi = 0

    def _look_up(self, lo: int, hi: int) -> None:
        """Puts into ``table`` which piece the 1, 2, ... letters are that end with each letter from lo to hi: its number, V for none, V + 1 for a single letter without."""
        longest, none = self.vocab.longest, len(self.vocab.pieces)
        lead = max(0, lo - longest)
        inside = np.arange(lead, hi) - self.off[self.word[lead:hi]]
        table = np.full((hi - lo, longest), none, np.int32)
        for d, (at, h) in enumerate(chains(self.flat[lead:hi], inside, longest)):
            own = at >= lo - lead
            found = self.vocab.find(h[own])
            ok = found >= 0
            table[at[own][ok] - (lo - lead), d] = found[ok]
        table[table[:, 0] == none, 0] = none + 1
        self.lo, self.hi, self.table = lo, hi, table

    def _have(self, lo: int, hi: int) -> None:
        if lo < self.lo or hi > self.hi:
            whole = len(self.flat) <= STRIP
            self._look_up(0 if whole else max(0, lo - STRIP // 2), len(self.flat) if whole else min(len(self.flat), hi + STRIP // 2))

    def ending(self, x: np.ndarray) -> np.ndarray:
        """The pieces that end with each letter x, by length."""
        self._have(int(x.min()), int(x.max()) + 1)
        return self.table[x - self.lo]

    def beginning(self, x: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The pieces that begin with each letter x of a word that ends before ``end``."""
        steps = np.arange(self.vocab.longest)
        at = x[:, None] + steps
        self._have(int(x.min()), int(min(at.max() + 1, len(self.flat))))
        found = self.table[np.minimum(at, len(self.flat) - 1) - self.lo, steps]
        return np.where(at < end[:, None], found, len(self.vocab.pieces))

    def walk(self, chance: np.ndarray, backward: bool = False, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(log chance of each word, log chances up to every place or None), summed over all segmentations.

        What was summed up to the last ``longest`` letters is all that a step needs. Every
        ``longest`` steps it is divided by the newest sum, so words of any length stay within
        range. Places number off[w] + w + t after t letters of word w; backward, what follows the
        place is summed.
        """
        n, k, longest = len(self.size), chance.shape[1], self.vocab.longest
        rows = np.concatenate([chance, np.zeros((1, k)), np.full((1, k), UNKNOWN)])
        band, logs = np.zeros((longest + 1, n, k)), np.zeros((n, k))  # sums by t mod (longest + 1)
        band[0] = 1
        flat = band.reshape(-1, k)
        places = np.zeros((len(self.flat) + n, k)) if keep else None
        end = np.zeros((n, k))
        alive = np.searchsorted(-self.size, -np.arange(1, int(self.size[0]) + 1), "right")
        for t, m in enumerate(alive.tolist(), 1):
            off, size = self.off[:m], self.size[:m]
            piece = self.beginning(off + size - t, off + size) if backward else self.ending(off + t - 1)
            hit = np.flatnonzero(piece != len(chance))  # a single letter always counts, so no word is without
            w, d = np.divmod(hit, longest)
            parts = flat[(t - 1 - d) % (longest + 1) * n + w] * rows[piece.reshape(-1)[hit]]
            new = np.add.reduceat(parts, np.searchsorted(w, np.arange(m)))
            band[t % (longest + 1), :m] = new
            done = slice(int(alive[t]) if t < len(alive) else 0, m)  # words that end here
            end[done] = logs[done] + np.log(new[done])
            if places is not None:
                places[off + np.arange(m) + (size - t if backward else t)] = logs[:m] + np.log(new)
            if t % longest == 0:
                band[:, :m] /= new
                logs[:m] += np.log(new)
        return end, places


def different(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(an occurrence of each different word, longest first; the word of each occurrence)."""
    _, first, inverse = np.unique(span_hashes(np.ascontiguousarray(codes).view(np.uint8), 4 * starts, 4 * ends), return_index=True, return_inverse=True)
    order = np.argsort(starts[first] - ends[first], kind="stable")
    place = np.zeros(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[inverse]


def _groups(sizes: np.ndarray) -> list[np.ndarray]:
    """Words in groups of about STRIP letters at most; a longer word comes alone."""
    return np.split(np.arange(len(sizes)), np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // STRIP)) + 1) if len(sizes) else []


def log_chances(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary, chance: np.ndarray) -> np.ndarray:
    """The log chance of each word under each language; chance has a row for each piece."""
    first, inverse = different(codes, starts, ends)
    out = np.zeros((len(first), chance.shape[1]))
    for group in _groups((ends - starts)[first] + 1):
        out[group] = Words(codes, starts[first[group]], ends[first[group]], vocab).walk(chance)[0]
    return out[inverse]


def expected_counts(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary, chance: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, for each column of ``weights`` (words x languages); chance has one column."""
    first, inverse = different(codes, starts, ends)
    total = np.stack([np.bincount(inverse, weights[:, k], len(first)) for k in range(weights.shape[1])], 1)
    log_piece, out = np.log(chance[:, 0]), np.zeros((len(vocab.pieces), weights.shape[1]))
    for group in _groups((ends - starts)[first] + 1):
        words = Words(codes, starts[first[group]], ends[first[group]], vocab)
        whole, before = words.walk(chance, keep=True)
        _, after = words.walk(chance, backward=True, keep=True)
        for lo in range(0, len(words.flat), STRIP):
            x = np.arange(lo, min(lo + STRIP, len(words.flat)))
            pieces_, of = words.ending(x), words.word[x]
            for d in range(vocab.longest):
                hit = np.flatnonzero(pieces_[:, d] < len(vocab.pieces))
                piece, w, place = pieces_[hit, d], of[hit], x[hit] + of[hit] + 1
                share = np.exp(before[place - d - 1, 0] + log_piece[piece] + after[place, 0] - whole[w, 0])
                for k in range(weights.shape[1]):
                    out[:, k] += np.bincount(piece, share * total[group[w], k], len(vocab.pieces))
    return out


@dataclass
class Model:
    languages: list[str]
    path: str
    chance: np.ndarray  # pieces x languages


def learn(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 5_000, seed: int = 11) -> Model:
    """Piece chances of each language from the rows of ``df`` that have one.

    At most about ``sample`` documents of each language are read, those whose hashed id is below a
    threshold set from the count of the language; this is the stated bound on what is fitted. One
    step of expectation maximisation from equal chances gives expected piece counts, summed in
    Spark; what reaches the driver is one number for each piece and language.
    """
    known = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("g"))
    sizes = {r["g"]: r["n"] for r in known.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], path, np.zeros((0, 0)))
    share = F.create_map(*[x for g in languages for x in (F.lit(g), F.lit(sampling.threshold(sample, sizes[g])))])
    chosen = known.where(sampling.chosen(share[F.col("g")], F.coalesce(F.col("i").cast("string"), F.lit("")), seed=seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        even = np.full((len(vocab.pieces), 1), 1 / len(vocab.pieces))
        total = np.zeros((len(vocab.pieces), len(languages)))
        for piece in pieces(batches, "t", 1 << 20):
            codes, starts, ends, docs = words_of(texts_of(piece, "t"))
            lang = np.array([languages.index(g) for g in piece.column(1).to_pylist()])
            weights = (lang[docs][:, None] == np.arange(len(languages))).astype(float)
            total += expected_counts(codes, starts, ends, vocab, even, weights)
        p, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(g), pa.array(total[p, g])], ["p", "g", "n"])

    counts = chosen.select("t", "g").mapInArrow(run, "p long, g long, n double").groupBy("p", "g").agg(F.sum("n").alias("n"))
    table = counts.toPandas()
    total = np.full((len(vocabulary(path).pieces), len(languages)), 0.01)
    total[table["p"], table["g"]] += table["n"]
    return Model(languages, path, total / total.sum(0))


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, equal chances before, and how likely it is."""
    codes, starts, ends, docs = words_of(texts)
    n, k = len(texts), len(model.languages)
    found = np.zeros(n, bool)
    found[docs] = True
    if not k:
        return ["und"] * n, np.zeros(n)
    logs = log_chances(codes, starts, ends, vocabulary(model.path), model.chance)
    total = np.stack([np.bincount(docs, logs[:, g], n) for g in range(k)], 1)
    best = total.argmax(1)
    score = 1 / np.exp(np.maximum(total - total.max(1, keepdims=True), -700)).sum(1)
    return [model.languages[b] if f else "und" for b, f in zip(best, found, strict=True)], np.where(found, score, 0.0)


def identify(df: DataFrame, model: Model, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """``keep``, lang_pred and score of every row.

    Null texts and texts without a letter: ``und`` with score 0. Ties go to the language that sorts
    first. If nothing was learned, every text is ``und``. The whole text counts: texts go in pieces of
    about a megabyte, a longer one by itself, with about 100 bytes for each of its bytes. Repeated rows
    are rows like others; columns besides ``keep`` aren't read, whatever their names, and one of
    ``keep`` must not be called lang_pred or score. An empty table stays empty.
    """
    source = df.select(*keep, F.col(text_col).alias("_text"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", 1 << 20):
            langs, scores = predict(texts_of(piece, "_text"), model)
            yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(names))], pa.array(langs, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    ddl = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{ddl}, lang_pred string, score double")
