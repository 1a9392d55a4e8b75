"""Secrets by rule, and by a linear-chain conditional random field over the tokens of a text."""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.textbatch import joined, pieces, texts_of, word_edges
from corvane.plans import sampling
from corvane.plans.scratch import cut

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

Span = tuple[int, int, int]  # kind, start, end


def base_spans(text: str, with_hex: bool = True) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, where the secret itself starts) of all rule matches, ordered by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(0, m.start(), m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if with_hex:
        found += [(2, m.start(), m.end(), m.start()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], s[0]))


# Tokens are runs of letters, digits, + / _ - and bytes beyond ASCII; all else stands between them.
_APART = np.ones(256, bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-", *range(0x80, 0x100)]] = False
_NOT_HEX = np.ones(256, bool)
_NOT_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = False
_GROUP = np.full(256, 4, np.uint8)
_GROUP[0x30:0x3A] = 0
_GROUP[0x41:0x5B] = 1
_GROUP[0x61:0x7B] = 2
_GROUP[0x80:] = 3

_VOWEL, _SIGN, _DASH = (np.isin(np.arange(256), list(x)) for x in (b"aeiouyAEIOUY", b"/_-", b"-"))

#: Words that tend to stand before a secret.
HINTS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "auth", "credential", "credentials", "bearer", "access_key", "private_key")
#: First letters of tokens that well-known services issue.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "xoxb", "xoxp", "eyJh", "AIza", "glpa", "sk-l", "sk_l")


_PREFIX_KEYS = np.array(sorted(int.from_bytes(p.encode(), "little") for p in PREFIXES), np.uint32)


def _first(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each token as an integer, and a key of them in lower case with the length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    first = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[starts]).view("<u8").reshape(-1)
    shift = (np.uint64(8) * np.minimum(size, 8).astype(np.uint64)) & np.uint64(63)
    mask = np.where(size >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << shift) - np.uint64(1))
    return first, ((first | np.uint64(0x2020202020202020)) & mask) * np.uint64(31) + size.astype(np.uint64)


def _hint_keys() -> np.ndarray:
    data, begins = joined(list(HINTS))
    return np.sort(_first(data, begins[:-1], np.diff(begins) - 1)[1])


FEATURES = (
    "bias", "len_1", "len_4", "len_8", "len_16", "len_24", "len_40", "digit", "upper", "lower", "high", "digits_only", "hex_only", "digit_and_letter",
    "three_groups", "many_turns", "capital_word", "after_equals", "after_colon", "after_quote", "after_blank", "after_line", "glued", "before_quote",
    "is_hint", "hint_before", "hint_two_before", "hint_and_sign", "long_mixed", "prefix", "text_many_digits", "text_has_hint", "text_short", "next_mixed", "previous_mixed",
    "worded", "some_words", "vowels", "islands", "parts", "uuid",
)


@dataclass
class Tokens:
    """Tokens of several texts: their bytes, text numbers and feature bits."""

    data: np.ndarray
    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bits: np.ndarray  # one uint64 a token

    def places(self, doc: np.ndarray, points: np.ndarray) -> np.ndarray:
        """Where in the bytes the code points of texts lie."""
        at = np.flatnonzero((self.data & 0xC0) != 0x80)
        return at[np.searchsorted(at, self.begins[doc]) + points]

    def within(self, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first token, and the one after the last, that lie at least in part in each span of code points."""
        first = np.searchsorted(self.ends, self.places(doc, start), "right")
        return first, np.searchsorted(self.starts, self.places(doc, end), "left")


def tokens_of(texts: list[str]) -> Tokens:
    data, begins = joined(texts)
    starts, ends = word_edges(data, _APART)
    n = len(starts)
    doc = np.searchsorted(begins, starts, "right") - 1
    if not n:
        return Tokens(data, begins, starts, ends, doc, np.zeros(0, np.uint64))
    size = ends - starts
    groups = _GROUP[data]
    runs = [np.concatenate([[0], np.cumsum(groups == g, dtype=np.int32)]) for g in range(4)]
    n_digit, n_upper, n_lower, n_high = (r[ends] - r[starts] for r in runs)
    hexes = np.concatenate([[0], np.cumsum(~_NOT_HEX[data], dtype=np.int32)])
    n_hex = hexes[ends] - hexes[starts]
    turn = np.concatenate([[0, 0], np.cumsum(groups[1:] != groups[:-1], dtype=np.int32)])
    turns = turn[ends] - turn[starts + 1]
    # Bytes in runs of three small letters or more, as words and names made of words have them.
    edges = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]])
    in_word = np.repeat((np.diff(edges) >= 3) & (groups[edges[:-1]] == 2), np.diff(edges))
    words = np.concatenate([[0], np.cumsum(in_word, dtype=np.int32)])
    n_word = words[ends] - words[starts]
    island = np.concatenate([[0], np.cumsum((groups == 0) & np.concatenate([[True], groups[:-1] != 0]), dtype=np.int32)])
    n_vowel, n_sign, n_dash = (r[ends] - r[starts] for r in (np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)]) for table in (_VOWEL, _SIGN, _DASH)))
    first8, key = _first(data, starts, size)
    wanted = _hint_keys()
    hint = wanted[np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)] == key
    first4 = first8.astype(np.uint32)
    prefix = (_PREFIX_KEYS[np.minimum(np.searchsorted(_PREFIX_KEYS, first4), len(_PREFIX_KEYS) - 1)] == first4) & (size >= 12)
    new_text = np.ones(n, bool)
    new_text[1:] = doc[1:] != doc[:-1]

    def before(x: np.ndarray, k: int = 1) -> np.ndarray:
        out = np.zeros_like(x)
        out[k:] = x[:-k]
        for j in range(k):  # not over the border of a text
            out[j:][new_text[: n - j]] = 0
        return out

    gap_from = np.where(new_text, begins[doc], np.concatenate([[0], ends[:-1]]))
    last_text = np.ones(n, bool)
    last_text[:-1] = new_text[1:]
    gap_to = np.where(last_text, begins[doc + 1] - 1, np.concatenate([starts[1:], [0]]))

    def between(byte: bytes) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.isin(data, list(byte)), dtype=np.int32)])

    equals, colon, quote, blank, line = (between(b) for b in (b"=", b":", b"\"'`", b" \t", b"\n"))
    has = lambda r: r[starts] > r[gap_from]
    letters = n_upper + n_lower
    mixed = (n_digit > 0) & (letters > 0)
    n_docs = len(begins) - 1
    digits = np.bincount(doc, n_digit, n_docs)
    length = np.diff(begins).astype(float)
    any_hint = np.bincount(doc, hint, n_docs) > 0
    hint_before = before(hint)
    next_mixed = np.zeros(n, bool)
    next_mixed[:-1] = mixed[1:] & ~new_text[1:]
    columns = [
        np.ones(n, bool), size < 4, (size >= 4) & (size < 8), (size >= 8) & (size < 16), (size >= 16) & (size < 24), (size >= 24) & (size < 40), size >= 40,
        n_digit > 0, n_upper > 0, n_lower > 0, n_high > 0, n_digit == size, n_hex == size, mixed, (n_digit > 0) & (n_upper > 0) & (n_lower > 0),
        turns * 4 >= size, (n_upper == 1) & (n_lower == size - 1), has(equals), has(colon), has(quote), has(blank), has(line), (starts - gap_from == 1) & ~new_text & ~has(blank) & ~has(line),
        quote[gap_to] > quote[ends], hint, hint_before, before(hint, 2), hint_before & (has(equals) | has(colon)), mixed & (size >= 16), prefix,
        (digits / length)[doc] > 0.05, any_hint[doc], (length < 400)[doc], next_mixed, before(mixed),
        n_word * 2 >= size, n_word * 4 >= size, (n_vowel * 4 >= letters) & (letters >= 4), island[ends] - island[starts] >= 3, n_sign > 0, (size == 36) & (n_dash == 4) & (n_hex == 32),
    ]
    bits = np.zeros(n, np.uint64)
    for i, c in enumerate(columns):
        bits |= c.astype(np.uint64) << np.uint64(i)
    return Tokens(data, begins, starts, ends, doc, bits)


def matrix(bits: np.ndarray) -> np.ndarray:
    """Feature bits as an array of zeros and ones, a row for each feature."""
    return ((bits[None, :] >> np.arange(len(FEATURES), dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.float32)


O, B, I = 0, 1, 2  # noqa: E741


@dataclass
class Field:
    """Weights of a conditional random field: features x tags, and tag x next tag."""

    weights: np.ndarray
    steps: np.ndarray

    def slack(self) -> float:
        """If O leads a token's other tags by more than this, no neighbour can change it."""
        s = self.steps
        return float(max(s[p, a] + s[a, n] - s[p, O] - s[O, n] for p in range(3) for n in range(3) for a in (B, I)))


def _objective(x: np.ndarray, tags: np.ndarray, real: np.ndarray, weights: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean log likelihood: observed less expected counts, by forward-backward with sums scaled to one."""
    n, t, f = x.shape
    e = (x.reshape(-1, f) @ weights).reshape(n, t, 3)
    e = np.exp(e - e.max(2, keepdims=True))
    step = np.exp(steps - steps.max())
    one = lambda v: v / v.sum(-1, keepdims=True)
    alpha, beta = np.zeros((n, t, 3)), np.ones((n, t, 3))
    alpha[:, 0] = one(e[:, 0] * step[O])
    for j in range(1, t):
        alpha[:, j] = np.where(real[:, j, None], one(alpha[:, j - 1] @ step * e[:, j]), alpha[:, j - 1])
    for j in range(t - 2, -1, -1):
        beta[:, j] = np.where(real[:, j + 1, None], one((beta[:, j + 1] * e[:, j + 1]) @ step.T), beta[:, j + 1])
    p = one(alpha * beta) * real[:, :, None]
    seen = np.eye(3)[tags] * real[:, :, None]
    g_w = x.reshape(-1, f).T @ (seen - p).reshape(-1, 3) / n
    both = real[:, 1:]
    pair = alpha[:, :-1, :, None] * step * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair *= (both / pair.sum((2, 3)))[:, :, None, None]
    g_s = (np.einsum("nta,ntb->ab", seen[:, :-1] * both[:, :, None], seen[:, 1:]) - pair.sum((0, 1))) / n
    g_s[O] += (seen[:, 0] - p[:, 0]).sum(0) / n
    return g_w, g_s


def train(windows: list[tuple[list[int], list[int]]], steps: int = 200, penalty: float = 0.0002, seed: int = 5) -> Field:
    """Maximum likelihood with an L2 penalty, by Adam on all windows, of which ``learn`` gives no more than its bounds.

    Each window with a secret is used four times: as it is and with the secret in letters of both
    cases after a plain blank, so that the field knows more alphabets and signs than the rules'
    finds show, and both of these without hints, so that shape and place count by themselves. Every
    second one of the changed ones has a short secret, as its hint tells.
    """
    bit = {f: 1 << i for i, f in enumerate(FEATURES)}
    hints = sum(b for f, b in bit.items() if "hint" in f)
    clear = sum(bit[f] for f in ("hex_only", "after_equals", "after_quote", "before_quote", "hint_and_sign", "worded", "uuid"))
    put = sum(bit[f] for f in ("upper", "lower", "digit", "three_groups", "many_turns", "after_blank"))
    secret = [(bits, tags) for bits, tags in windows if any(tags)]
    sample = list(windows) + [([b & ~hints for b in bits], tags) for bits, tags in secret]
    sizes = sum(b for f, b in bit.items() if f.startswith("len_") or f == "long_mixed")
    mixed = [([b & ~clear | put if t else b for b, t in zip(bits, tags, strict=True)], tags) for bits, tags in secret]
    brief = [([b & ~sizes | bit["len_8"] if t else b for b, t in zip(bits, tags, strict=True)], tags) for bits, tags in mixed[::2]]
    sample += mixed[1::2] + brief + [([b & ~hints for b in bits], tags) for bits, tags in mixed]
    n, t = len(sample), max(len(b) for b, _ in sample)
    x, tags, real = np.zeros((n, t, len(FEATURES))), np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (bits, y) in enumerate(sample):
        x[i, : len(bits)] = matrix(np.array(bits, np.uint64)).T
        tags[i, : len(y)], real[i, : len(y)] = y, True
    rng = np.random.default_rng(seed)
    w, s = rng.normal(0, 0.01, (len(FEATURES), 3)), np.zeros((3, 3))
    s[O, I] = -4.0
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    for k in range(1, steps + 1):
        g_w, g_s = _objective(x, tags, real, w, s)
        for v, g, a, b in ((w, g_w - penalty * w, 0, 1), (s, g_s - penalty * s, 2, 3)):
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.99 * state[b] + 0.01 * g * g
            v += 0.1 * (state[a] / (1 - 0.9**k)) / (np.sqrt(state[b] / (1 - 0.99**k)) + 1e-8)
    return Field(w.astype(np.float32), s)


def viterbi(scores: np.ndarray, steps: np.ndarray) -> list[int]:
    """The best tags of a run of tokens between two that are O."""
    best, back = scores[0] + steps[O], []
    for row in scores[1:]:
        paths = best[:, None] + steps
        back.append(paths.argmax(0))
        best = paths.max(0) + row
    tag = int((best + steps[:, O]).argmax())
    out = [tag]
    for choice in reversed(back):
        tag = int(choice[tag])
        out.append(tag)
    return out[::-1]


def decode(tokens: Tokens, field: Field) -> np.ndarray:
    """The best tag of every token; runs are decoded between tokens that are O in any case."""
    scores = (field.weights.T @ matrix(tokens.bits)).T.astype(float)
    tags = np.zeros(len(scores), np.int8)
    open_ = scores[:, O] - scores[:, 1:].max(1) <= field.slack()
    at = np.flatnonzero(open_)
    if len(at):
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(tokens.doc[at]) > 0)) + 1
        for run in np.split(at, cut):
            tags[run] = viterbi(scores[run[0] : run[-1] + 1], field.steps)
    return tags


def weak_tags(tokens: Tokens, spans: list[list[tuple[int, int, int, int]]]) -> np.ndarray:
    """Tags of all tokens: begin and inside where a rule found a secret."""
    tags = np.zeros(len(tokens.starts), np.int8)
    flat = np.array([(doc, secret, end) for doc, found in enumerate(spans) for _, _, end, secret in found], np.int64).reshape(-1, 3)
    for a, b in zip(*(x.tolist() for x in tokens.within(*flat.T)), strict=True):
        free = a + np.flatnonzero(tags[a:b] == O)
        tags[free] = I
        tags[free[:1]] = B
    return tags


#: Words that names in code, addresses and products are made of here.
NAME_WORDS = (
    "get set is parse build make load save open close read write find sort user account order item page list table index query value result handler manager service factory client server request response "
    "config option default custom global local main test data file path name type class model view event stream batch report docs guide start image video music photo ultra smart phone drive cloud home office"
).split()


def generated(n: int = 300, width: int = 24, seed: int = 9) -> list[tuple[list[int], list[int]]]:
    """Windows of generated lines of code, addresses, product names, versions and ids: ``n`` without a secret, and half as many with random letters in like places."""
    r = random.Random(seed)
    word, cap = lambda: r.choice(NAME_WORDS), lambda: r.choice(NAME_WORDS).capitalize()
    number, letter = lambda k=4: str(r.randrange(10 ** r.randrange(1, k + 1))), lambda: r.choice(string.ascii_uppercase)
    pick = lambda pool, k: "".join(r.choices(pool, k=k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    camel = lambda: word() + "".join(cap() for _ in range(r.randrange(1, 5))) + r.choice(["", number(3), f"V{number(1)}", f"By{cap()}{number(2)}"])
    pascal = lambda: "".join(r.choice([cap, cap, lambda: pick(string.ascii_uppercase, 3)])() for _ in range(r.randrange(2, 5))) + r.choice(["", number(3), f"_{cap()}{number(2)}", f"V{number(1)}"])
    snake = lambda: "_".join(word() for _ in range(r.randrange(2, 5))) + r.choice(["", f"_{number(3)}", f"_v{number(1)}"])
    shout = lambda: "_".join(word().upper() for _ in range(r.randrange(2, 4))) + r.choice(["", f"_{number(3)}"])
    product = lambda: r.choice([f"{cap()}{letter()}{number(2)}{cap()}{number(1)}{letter()}", f"{letter()}{letter()}-{number(4)}{letter()}", f"{cap()}-{number(4)}{cap()}", f"{cap()}{number(2)}Pro{cap()}", f"{word()}{cap()}{number(2)}Pro{cap()}{number(3)}{letter()}B", f"{pick(string.ascii_uppercase, 3)}{number(4)}{cap()[:2]}", f"{cap()[:3]}{cap()}{number(2)}V{number(1)}{cap()}{cap()}{number(1)}K"])
    part = lambda: r.choice([word, cap, snake, lambda: f"{cap()}-{cap()}_v{number(1)}", lambda: f"{shout()}", lambda: f"{cap()}_{cap()}", number])()
    stretch = lambda: "/".join(part() for _ in range(r.randrange(2, 6)))
    uuid = lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
    stamp = lambda: r.choice([f"20{number(2):0>2}-0{r.randrange(1, 10)}-1{r.randrange(10)}T1{r.randrange(10)}:30:00Z", f"IMG_20{r.randrange(10, 30)}0{r.randrange(1, 10)}1{r.randrange(10)}_{r.randrange(10**6):06d}", f"v{number(1)}.{number(2)}.{number(2)}-beta{number(1)}", pick(hexes, 7), "0x" + pick(hexes, r.randrange(4, 13)), f"{word()}-{pick(hexes, r.randrange(5, 11))}", "-".join(number(4) for _ in range(r.randrange(2, 6)))])
    name = lambda: r.choice([camel, pascal, snake, shout, product, stretch, uuid, stamp])()
    secret = lambda: r.choice([lambda: pick(alnum, r.randrange(18, 44)), lambda: pick(string.ascii_lowercase + string.digits, r.randrange(20, 36)), lambda: pick(alnum + "-_", r.randrange(24, 44)), lambda: r.choice(PREFIXES) + pick(alnum, r.randrange(16, 40))])()
    frames = ("{} = {}({}, {})", "return {}.{}[{}]", "see https://www.{}.com/{}?{}={}", "the {} and the {} of {} for {}", "import {} from \"{}\"", "{}: {}", "call('{}', {})", "<a href=\"/{}\">{}</a>", "{} {} {} {}", "id={} name={}")
    out = []
    for i in range(n + n // 2):
        frame = r.choice(frames)
        held = [name() for _ in range(frame.count("{}"))]
        planted = secret() if i >= n else None
        if planted:
            held[r.randrange(len(held))] = planted
        lead, tail = (" ".join(word() for _ in range(r.randrange(0, 9))) for _ in range(2))
        text = f"{lead} {frame.format(*held)} {tail}"
        tokens = tokens_of([text])
        at = text.index(planted) if planted else 0
        tags = weak_tags(tokens, [[(0, at, at + len(planted), at)] if planted else []])
        out.append((tokens.bits[:width].astype(np.int64).tolist(), tags[:width].tolist()))
    return out


def learn(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, windows: int = 1_500, plain: int = 1_000, per_text: int = 8, width: int = 24, seed: int = 3
) -> Field | None:
    """A field from the rules' own finds, on about ``sample`` documents at most (chosen by hashed id and text).

    From each chosen document come at most ``per_text`` stretches of ``width`` tokens around rule
    matches, and one from anywhere in a document without. Of all different stretches, ``windows``
    with a secret and ``plain`` ones without are taken at most, by a hash of their features; these
    are the only rows that reach the driver, about 300 bytes each. Generated windows of code,
    addresses and product names are added, so that names made of words are told from random letters.
    None if no secret was found; then only the rules work.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    chosen = df.where(sampling.chosen(sampling.threshold(sample, df.count()), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.crc32(text), seed=seed)).select(text.alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            texts = texts_of(piece, "t")
            tokens = tokens_of(texts)
            tags = weak_tags(tokens, [base_spans(t) for t in texts])
            edges = np.searchsorted(tokens.doc, np.arange(len(texts) + 1)).tolist()
            rows = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                hits = lo + np.flatnonzero(tags[lo:hi] == B)
                if len(hits):
                    starts = np.maximum(hits - width // 2, lo).tolist()
                elif hi > lo:
                    starts = [lo + int(tokens.bits[lo:hi].sum() % np.uint64(max(1, hi - lo - width)))]
                else:
                    starts = []
                found = []
                for a in starts:
                    bits, y = tokens.bits[a : min(a + width, hi)], tags[a : min(a + width, hi)]
                    digest = hashlib.blake2b(bits.tobytes() + y.tobytes(), digest_size=8).digest()
                    found.append((int.from_bytes(digest, "little", signed=True), bool(len(hits)), bits.astype(np.int64).tolist(), y.tolist()))
                rows += sorted(found)[:per_text]
            h, secret, bits, y = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(secret, pa.bool_()), pa.array(bits, pa.list_(pa.int64())), pa.array(y, pa.list_(pa.int64()))], ["h", "secret", "bits", "tags"])

    made = chosen.select("t").mapInArrow(run, "h long, secret boolean, bits array<bigint>, tags array<bigint>")
    made = cut(made.dropDuplicates(["secret", "h"]), "windows")
    rows = [r for kind, n in (("secret", windows), ("NOT secret", plain)) for r in made.where(kind).orderBy("h").limit(n).collect()]
    return train([(list(r["bits"]), list(r["tags"])) for r in rows] + generated(width=width)) if any(r["secret"] for r in rows) else None


def find(texts: list[str], field: Field | None) -> list[list[Span]]:
    """All spans (kind, start, end) of each text in code points, by start and kind.

    Of what the field tags, tokens that a rule's span touches belong to the rule; the rest of a run
    makes spans of its own.
    """
    tokens = tokens_of(texts)
    hs, he = word_edges(tokens.data, _NOT_HEX)
    with_hex = set((np.searchsorted(tokens.begins, hs[he - hs >= 24], "right") - 1).tolist())
    out: list[list[Span]] = [[s[:3] for s in base_spans(t, i in with_hex)] for i, t in enumerate(texts)]
    if field is None or not len(tokens.starts):
        return out
    tags = decode(tokens, field)
    flat = np.array([(doc, start, end) for doc, spans in enumerate(out) for _, start, end in spans], np.int64).reshape(-1, 3)
    for a, b in zip(*(x.tolist() for x in tokens.within(*flat.T)), strict=True):
        tags[a:b] = O
    at = np.flatnonzero(tags)
    if not len(at):
        return out
    points = np.concatenate([[0], np.cumsum((tokens.data & 0xC0) != 0x80)])
    begins = (tags[at] == B) | np.concatenate([[True], (np.diff(at) > 1) | (np.diff(tokens.doc[at]) > 0)])
    first, last = at[begins], at[np.append(np.flatnonzero(begins)[1:], len(at)) - 1]
    doc, zero = tokens.doc[first], points[tokens.begins[tokens.doc[first]]]
    for d, start, end in zip(doc.tolist(), (points[tokens.starts[first]] - zero).tolist(), (points[tokens.ends[last]] - zero).tolist(), strict=True):
        out[d].append((3, start, end))
    for d in set(doc.tolist()):
        out[d].sort(key=lambda s: (s[1], s[0]))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scan(df: DataFrame, field: Field | None, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """``keep``, n_assign, n_access, n_hex, base_sha256 and spans of every row; null and empty texts have no spans.

    A text of any length is worked on whole, with about 100 bytes for each of its bytes. Repeated
    rows are rows like others; columns besides ``keep`` aren't read, whatever their names. An empty
    table stays empty.
    """
    source = df.select(*keep, F.col(text_col).alias("_text"))
    names = source.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text"):
            found = find(texts_of(piece, "_text"), field)
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in range(3)]
            sums = [hashlib.sha256(listed([s for s in spans if s[0] < 3]).encode()).hexdigest() for spans in found]
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(i) for i in range(len(names))], *counts, pa.array(sums), pa.array([listed(s) for s in found])],
                [*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    ddl = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names)
    return source.mapInArrow(run, f"{ddl}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, field: Field | None, text_col: str = "text", length_col: str | None = None, tag: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with every span, overlapping ones as one, replaced by ``tag``; ``length_col`` then gets the new length. Null texts stay null, all other columns as they are; an empty table stays empty."""

    def clean(text: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for _, start, end in spans:
            if start >= at:
                parts += [text[at:start], tag]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text_col):
            texts = texts_of(piece, text_col)
            found = find(texts, field)
            given = piece.column(text_col).to_pylist()
            new = [None if g is None else clean(t, s) for g, t, s in zip(given, texts, found, strict=True)]
            at = piece.schema.get_field_index(text_col)
            piece = piece.set_column(at, piece.schema.field(at), pa.array(new, piece.schema.field(at).type))
            if length_col:
                at = piece.schema.get_field_index(length_col)
                was = piece.column(length_col).to_pylist()
                sizes = [len(t) if s and t is not None else w for t, s, w in zip(new, found, was, strict=True)]
                piece = piece.set_column(at, piece.schema.field(at), pa.array(sizes, piece.schema.field(at).type))
            yield piece

    return df.mapInArrow(run, df.schema)
