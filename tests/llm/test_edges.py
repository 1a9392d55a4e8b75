"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import contamination, language, packing, quality, secrets, sharding, simhash, substrings, tokens, vectors
from corvane.llm.textbatch import joined

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven small birds sing on old walls".split()


def prose(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n), strict=True))


LONG = prose(30_000, 7)
BASE = prose(120, 1)
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "en", None, 3), (6, LONG, "en", "a", 1),
    (7, "x", "de", "a", 1), (None, "no id here", None, "a", 1), (8, "héllo wörld 日本 \U0001f600 end", "fr", "a", 1), (9, BASE + " tail", "en", "a", 1),
    (10, "y " + " ".join(LONG.split()[100:160]) + " z", "en", "a", 1), (11, "y " + " ".join(LONG.split()[100:130]) + " z", "en", "a", 1), (12, 'token = "abcdef0123456789abcdef01" AKIA' + "A" * 16, "en", "a", 1), (4, "", "en", "b", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = "score double, size int, key string, spans string, n_tokens int, fp int, bucket string, label int, component_id string, shard string, lang_pred string, held_out int, _text string, text_crc32 int, copies int, rank int, x string"
    names = [c.split()[0] for c in extra.split(", ")]
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit(None).cast(c.split()[1]).alias(n) for n, c in zip(names, extra.split(", "), strict=True)])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_sharding(docs, none):
    got = rows(sharding.place_rows(docs, 4))
    assert len(got) == len(ROWS) and Counter(r["shard"] for r in got).most_common()[0][1] - min(Counter(r["shard"] for r in got).values()) <= 1
    for shard in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sharding.place_rows(none, 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100])
def test_permutation_is_one(spark, n):
    got = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, "s").alias("p")).collect()]
    assert sorted(got) == list(range(n))


def test_permutation_by_hand(spark):
    import math

    def walk(x, n):
        a = math.isqrt(n - 1) + 1
        b = -(-n // a)
        mix = lambda r, v: int(hashlib.md5(f"7/{r}:{v}".encode()).hexdigest()[:8], 16)
        while True:
            left, right = divmod(x, b)
            for i in range(4):
                if i % 2 == 0:
                    left = (left + mix(i, right)) % a
                else:
                    right = (right + mix(i, left)) % b
            x = left * b + right
            if x < n:
                return x

    got = [r["p"] for r in spark.range(50).orderBy("id").select(sharding.permuted(F.col("id"), 50, "7").alias("p")).collect()]
    assert got == [walk(i, 50) for i in range(50)]


def test_write_shards(docs, spark, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(ROWS) and {"text", "slot", "shard"} <= set(back.columns)


def test_packing(docs, none):
    got = rows(packing.pack(docs, 3, 100))
    assert len(got) == len(ROWS) and all(r["n_tokens"] <= r["bucket_len"] and r["pad"] == r["bucket_len"] - r["n_tokens"] for r in got)
    for size in Counter((r["bucket"], r["batch"]) for r in got).items():
        length = next(r["bucket_len"] for r in got if (r["bucket"], r["batch"]) == size[0])
        assert size[1] <= max(1, 100 // length)
    assert packing.pack(none).count() == 0


def test_boundaries_are_best():
    from itertools import combinations

    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = sorted(rng.choice(60, 9, replace=False).tolist())
        counts = rng.integers(1, 20, 9).tolist()
        waste = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in zip(lengths, counts, strict=True))
        best = min(waste([*c, lengths[-1]]) for c in combinations(lengths[:-1], 2))
        assert waste(packing.best_boundaries(lengths, counts, 3)) == best


VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens(docs, none, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    got = sorted(rows(tokens.roundtrip(docs, VOCAB)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(r[0] for r in ROWS if r[0] is not None)
    want = Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, text, *_ in ROWS for ids in [[*t.encode(text or "", add_special_tokens=False).ids, 0]])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0
    assert tokens.roundtrip(none, VOCAB).count() == 0


def test_value_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
        assert (tokens.decode_values(*tokens.encode_values(v), n) == v).all()


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that every polynomial hash modulo 2^64 confuses, for n from 2048 on."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    library, e = Tokenizer.from_file(VOCAB), tokens.Encoder(VOCAB, keep=40)
    rng = np.random.default_rng(5)
    signs = [" ", "  ", "\n", "a", "b'll", "é", "9", "!", "\t", "Z", "日", "\u3000", "\x1c", "'s", "<|endoftext|>", "—", "supercalifragilistic", "\x00"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(600)]
    texts += [*thue_morse(2048), *thue_morse(4096), *thue_morse(16), " ".join(thue_morse(2048)), "x <|endoftext|> y"]
    for lo in range(0, len(texts), 100):
        part = texts[lo : lo + 100]
        ids, ends = e.encode(*joined(part), 0)
        begin = 0
        for text, end in zip(part, ends, strict=True):
            assert ids[begin:end].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], repr(text)
            begin = end


def test_quality(docs, none, spark):
    stats = quality.with_statistics(docs, ["doc_id"]).cache()
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(12)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.training_rows(stats, labels))
    got = rows(quality.with_scores(stats, model, ["doc_id"]))
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.fit(quality.training_rows(stats, labels.limit(0))).scores(np.zeros((2, len(quality.NAMES)))).tolist() == [0.5, 0.5]
    assert quality.with_statistics(none, ["doc_id"]).count() == 0
    assert set(quality.keep_good(docs, model).columns) == set(docs.columns)


def test_quality_scores_by_plain_formula():
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (200, 20)), rng.normal(0.5, 1.3, (300, 20))
    sums = {k: np.concatenate([np.ones((len(x), 1)), x], 1).T @ np.concatenate([np.ones((len(x), 1)), x], 1) for k, x in ((0, a), (1, b))}
    from unittest import mock

    frame = mock.MagicMock()
    with mock.patch.object(quality, "moments", lambda *_: sums), mock.patch.object(quality, "F"):
        m = quality.fit(frame)
    x = rng.normal(0, 1, (5, 20))
    z = (x - m.centre) / m.scale
    logs = []
    for k in (0, 1):
        cov = np.linalg.inv(m.factors[k].T @ m.factors[k])
        d = z - m.means[k]
        logs.append(np.log([200, 300][k] / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_language(docs, none, spark):
    model = language.learn(docs, PIECES)
    got = {r["doc_id"]: r for r in rows(language.identify(docs, model, ["doc_id"]))}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[5]["lang_pred"] == "und" and got[1]["lang_pred"] == "en"
    assert language.identify(docs, language.learn(none, PIECES), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert language.identify(none, model, ["doc_id"]).count() == 0


def test_forward_sums_all_segmentations():
    vocab = language.vocabulary(PIECES)
    rng = np.random.default_rng(1)
    chance = rng.random((len(vocab.pieces), 2)) / len(vocab.pieces)
    place = {p: i for i, p in enumerate(vocab.pieces)}

    def total(word: str, k: int) -> float:
        alpha = [1.0] + [0.0] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(j):
                p = place.get(word[i:j])
                alpha[j] += alpha[i] * (chance[p, k] if p is not None else language.UNKNOWN if j == i + 1 else 0.0)
        return alpha[-1]

    codes, starts, ends, _ = language.words_of(["The zebra, über 日x THE"])
    logs = language.log_chances(codes, starts, ends, vocab, chance)
    words = ["the", "zebra", "über", "日x", "the"]
    assert np.allclose(logs, [[np.log(total("▁" + w, k)) for k in (0, 1)] for w in words])


def test_secrets(docs, none):
    field = secrets.learn(docs)
    got = {(r["doc_id"]): r for r in rows(secrets.scan(docs, field, ["doc_id"]))}
    assert (got[12]["n_assign"], got[12]["n_access"], got[12]["n_hex"]) == (1, 1, 1) and got[3]["spans"] == got[4]["spans"] == ""
    base = "assign:0:33,hex:9:33,access:35:55"
    assert got[12]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    clean = {r["doc_id"]: r for r in rows(secrets.redact(docs, field, length_col="n_chars"))}
    assert "abcdef" not in clean[12]["text"] and "AKIA" not in clean[12]["text"] and clean[12]["n_chars"] == len(clean[12]["text"]) and clean[1]["text"] == BASE and clean[3]["text"] is None
    assert secrets.learn(none) is None and secrets.scan(none, None, ["doc_id"]).count() == 0


def test_base_rules():
    assert [s[:3] for s in secrets.base_spans("secret=token: abcdef")] == []
    assert [s[:3] for s in secrets.base_spans('API_KEY" : "abc.def=1')] == [(0, 0, 21)]
    assert [s[:3] for s in secrets.base_spans("é" + "a" * 23 + "g" + "0" * 24)] == [(2, 25, 49)]


def test_viterbi_runs_equal_whole_chain():
    rng = np.random.default_rng(4)
    field = secrets.Field(rng.normal(0, 1, (len(secrets.FEATURES), 3)).astype(np.float32), rng.normal(0, 0.5, (3, 3)))
    t = secrets.tokens_of([BASE, "", 'key = "Ab3dEf6hIj" done', BASE[:50]])
    scores = (field.weights.T @ secrets.matrix(t.bits)).T.astype(float)
    want = np.concatenate([secrets.viterbi(scores[t.doc == d], field.steps) for d in np.unique(t.doc)])
    assert (secrets.decode(t, field) == want).all()


def test_simhash(docs, none):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in rows(simhash.near_duplicates(docs))]
    fps = {i: plain(t) for i, t, *_ in ROWS}
    assert Counter((i, f) for i, f, _ in got) == Counter((i, plain(t)) for i, t, *_ in ROWS)
    for i, _, c in got:
        if i is not None:
            group, grown = {i}, True
            while grown:
                more = {k for k in fps if k is not None and any((fps[k] ^ fps[g]).bit_count() <= 3 for g in group)}
                grown, group = more != group, more
            assert c == min(group)
    assert simhash.near_duplicates(none).count() == 0
    kept = sorted(r["doc_id"] for r in rows(simhash.keep_first(docs)) if r["doc_id"] is not None)
    assert kept == sorted(i for i, _, c in got if i is not None and c == i)


@pytest.mark.parametrize("tile", [8, 1])  # 1: every tile is cut into chunks
def test_tiles_find_all_links(spark, tile):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))) for b in np.repeat(base, 4)], np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = {(r["src"], r["dst"]) for r in simhash.links(df, tile=tile).collect()}
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def root(p, x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        parent[root(parent, a)] = root(parent, b)
    true = {int(x): int(x) for x in fps.view(np.int64)}
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3), strict=True):
        true[root(true, int(fps.view(np.int64)[i]))] = root(true, int(fps.view(np.int64)[j]))
    sets = lambda p: {frozenset(x for x in p if root(p, x) == r) for r in {root(p, x) for x in p}}
    assert sets(parent) == sets(true)


def test_substrings(docs, none):
    words = {n: re.findall(r"[^\x20\x09-\x0D]+", t or "") for n, (_, t, *_) in enumerate(ROWS)}
    seen = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = Counter()
    for n, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[ROWS[n][0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()] += 1
    got = rows(substrings.remove_repeats(docs, ["doc_id"]))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert any(r["n_removed"] for r in got) and substrings.remove_repeats(none, ["doc_id"]).count() == 0


def test_substrings_periodic(spark):
    texts = ["a b c " * 60, "q " * 34, "q " * 35, prose(40, 2) + " m " + prose(40, 2), prose(80, 3)[:-3] + " w"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = {}
    for n, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want[n] = sum(gone)
    assert {r["doc_id"]: r["n_removed"] for r in rows(substrings.remove_repeats(df, ["doc_id"]))} == want


def test_contamination(docs, none, spark):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[200:230])), (2, None), (3, ""), (4, "X"), (5, BASE), (5, BASE), (None, "no id here"), (6, "not there at all my friend")], "item_id long, text string")
    got = rows(contamination.contained(docs, items, block=60))
    want = Counter()
    for i, t, *_ in ROWS:
        for r in items.collect():
            s = contamination.shingles(r["text"])
            n = len(s & contamination.shingles(t))
            if s and n >= 0.8 * len(s) - 1e-9:
                want[i, r["item_id"], n, len(s)] += 1
    assert Counter((r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in got) == want and len(want) >= 6
    clean = [r["doc_id"] for r in rows(contamination.drop_contaminated(docs, items))]
    assert Counter(clean) == Counter(i for i, *_ in ROWS if i not in {k[0] for k in want})
    assert contamination.contained(none, items).count() == 0 and contamination.contained(docs, items.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 20))
    near = base[rng.integers(0, 12, 60)] + rng.normal(0, 0.09, (60, 20))
    data = [(i, [float(v) for v in x], int(i % 2)) for i, x in enumerate(np.concatenate([base, near, near[:5]]))]
    odd = [(100, None, 1), (101, [0.0] * 20, 1), (102, [float("nan")] + [1.0] * 19, 1), (103, [1.0, None], 1), (104, [1.0] * 20, None), (None, [1.0] * 20, 1), (105, [], 0), (106, [1.0, 2.0], 0), (107, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(i, v, y, None) for i, v, y in data + odd], "vec_id long, embedding array<float>, label int, n_links string")
    got = {r["vec_id"]: r for r in rows(vectors.near_duplicates(df, tile=8))}
    good = [(i, np.array(v, np.float32).astype(float), y) for i, v, y in data] + [(106, np.array([1.0, 2.0]), 0), (107, np.array([2.0, 4.0]), 0)]
    link = {(i, j) for i, v, y in good for j, w, z in good if i != j and y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93}
    part = {i: i for i, *_ in good}
    for _ in range(len(good)):
        for i, j in link:
            part[i] = part[j] = min(part[i], part[j])
    for i, *_ in good:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (sum(a == i for a, _ in link), part[i], part[i] == i)
    assert len(link) > 50
    for i in (100, 101, 102, 103, 104, 105):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_full_cell_is_dealt_to_many_squares(spark):
    """A cell with many vectors: no square holds more than three strips, and each pair meets exactly once."""
    rows_ = [(0, 4, g, 1, b"", [(5, g % 2 == 0)]) for g in range(60)] + [(0, 4, g, 1, b"", [(6, False)]) for g in range(60, 100)]
    cells = spark.createDataFrame(rows_, "label int, d long, gid long, n long, key binary, cells array<struct<cell: bigint, reaches: boolean>>")
    met, work = Counter(), {}
    for r in vectors.squares(cells, 8).collect():
        work.setdefault((r["cell"], r["i"], r["j"]), {0: [], 1: [], 2: []})[r["role"]].append(r["gid"])
    for (_cell, i, j), has in work.items():
        assert max(map(len, has.values())) < 24
        met.update(tuple(sorted((x, y))) for x in has[0] + has[2] for y in has[1])
        met.update((x, y) for x in has[1] for y in has[1] if i == j and x < y)
    home = lambda g: 5 if g < 60 else 6
    assert met == Counter((x, y) for x in range(100) for y in range(x + 1, 100) if home(x) == home(y) or x % 2 == 0)
    assert len(work) > 20


_ = T
