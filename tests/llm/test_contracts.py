"""The registered queries and the pipeline on a small corpus, held against plain versions; and what only crafted input shows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import resource
import string
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import contamination, language, packing, queries, quality, secrets, simhash, substrings, vectors
from corvane.llm.textbatch import joined_column
from tests.llm.test_edges import BASE, PIECES, WORDS, prose, rows, thue_morse

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return BLANKS.findall(text or "")


def fold(i: int, modulus: int) -> int:
    return zlib.crc32(str(i).encode()) % modulus


# --- a small corpus with what the queries look for ---

GERMAN = "der schnelle braune fuchs springt über den faulen hund während sieben kleine vögel auf alten mauern singen und nicht schweigen".split()


def tables() -> dict[str, list[tuple]]:
    r = random.Random(11)
    text = lambda pool, n: " ".join(r.choices(pool, k=n)).capitalize() + "."
    docs: list[tuple] = []
    for _ in range(70):
        docs.append((text([w + str(r.randrange(9)) for w in WORDS] + WORDS, r.randrange(30, 160)), "en"))
    for _ in range(40):
        docs.append((text(GERMAN, r.randrange(30, 120)), "de"))
    for _ in range(40):
        docs.append(("".join(r.choices(string.punctuation + "  XQ09", k=r.randrange(40, 300))), "en"))
    passage, item = " ".join(f"p{i}" for i in range(60)), " ".join(f"t{i}" for i in range(25))
    docs[3] = (docs[3][0] + " " + passage, "en")
    docs[9] = (passage + " " + docs[9][0], "en")
    docs[12] = (docs[12][0] + " " + item.upper() + " " + docs[13][0], "en")
    docs[15], docs[16] = (docs[14][0], "en"), (docs[14][0].lower(), "en")
    docs[17] = (docs[17][0] + ' password = "Tr0ub4dor!xyz9Kq1" and AKIA' + "Z" * 17, "en")
    docs += [(None, "en"), ("", None), (" \n", None), ("é" * 3, None)]
    rows_ = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, (t, lang) in enumerate(docs)]
    labels = [(i, int(not 110 <= i < 150), 0) for i in range(150) if i % 5]
    vec = [[r.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    vec += [[x + r.gauss(0, 0.1) for x in vec[i % 30]] for i in range(60)]
    return {
        "documents": (rows_, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item), (2, "never to be found in any text of this corpus at all"), (3, None)], "item_id long, text string"),
        "embeddings": ([(i, v, i % 2) for i, v in enumerate(vec)], "vec_id long, embedding array<float>, label int"),
    }


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    for name, (data, schema) in tables().items():
        spark.createDataFrame(data, schema).coalesce(2).write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCS = {r[0]: r for r in tables()["documents"][0]}
TEXTS = {i: r[1] for i, r in DOCS.items()}


def run(spark, corpus, name):
    got = rows(queries.queries()[name](spark, corpus))
    return {r.get("doc_id", r.get("vec_id")): r for r in got} if name != "op3_contamination" else got


def plain_fingerprint(text: str | None) -> int:
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(nodes: list[int], linked) -> dict[int, int]:
    part = {i: i for i in nodes}
    pairs = [(i, j) for i, j in itertools.combinations(nodes, 2) if linked(i, j)]
    for _ in nodes:
        for i, j in pairs:
            part[i] = part[j] = min(part[i], part[j])
    return part


def plain_statistics(text: str | None) -> list[float]:
    text = text or ""
    raw, words = text.encode(), text.encode().split()
    share = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    of = lambda chars: sum(raw.count(bytes([c])) for c in set(chars))
    size, n = len(raw), len(words)
    lower, upper, digit, blank = of(string.ascii_lowercase.encode()), of(string.ascii_uppercase.encode()), of(b"0123456789"), of(b" \t\r\x0b\x0c")
    stop, sign, high = of(b".,;:?'\"()-"), of(b"#$%&*|!<>=@^~\\{}[]_+/"), sum(b >= 0x80 for b in raw)
    newline = of(b"\n")
    lengths = [len(w) for w in words]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean**2, 0))
    letters = lambda w: sum(chr(b).isascii() and chr(b).isalpha() or b >= 0x80 for b in w)
    ups, lows = lambda w: sum(65 <= b < 91 for b in w), lambda w: sum(97 <= b < 123 for b in w)
    pairs = list(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x]
    p = [raw.count(bytes([c])) / max(size, 1) for c in set(raw)]
    return [
        math.log1p(n), math.log((size + 1) / (n + 1)), math.log1p(spread), *[share(k, size) for k in (lower, upper, digit, newline, stop, sign, high, size - lower - upper - digit - blank - newline - stop - sign - high)],
        share(sum(x <= 3 for x in lengths), n), share(sum(any(b in b"#$%&*|!<>=@^~\\{}[]_+/" for b in w) for w in words), n), share(sum(ups(w) > 1 and not lows(w) for w in words), n),
        share(sum(letters(w) == 0 for w in words), n), share(len(set(words)), n), share(len(pairs) - len(set(pairs)), len(pairs)), share(len(lines) - len(set(lines)), len(lines)),
        math.log((n + 1) / (raw.count(b".") + raw.count(b"?") + 1)), -sum(x * math.log2(x) for x in p),
    ]


def test_op1(spark, corpus):
    got = run(spark, corpus, "op1_quality")
    assert sorted(got) == sorted(DOCS) and all(r["held_out"] == (fold(i, 3) == 1) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    x = {i: np.array(plain_statistics(t)) for i, t in TEXTS.items()}
    stats = {r["doc_id"]: r["x"] for r in rows(quality.with_statistics(spark.read.parquet(f"{corpus}/documents.parquet"), ["doc_id"]))}
    assert all(np.allclose(stats[i], x[i], atol=1e-9) for i in x)
    learned = [(i, y) for i, y, _ in tables()["labels"][0] if fold(i, 3) != 1]
    group = {k: np.array([x[i] for i, y in learned if y == k]) for k in (0, 1)}
    n = {k: len(g) for k, g in group.items()}
    cov = {k: np.cov(g.T, bias=True) for k, g in group.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    target = 0.75 * pooled + 0.25 * np.diag(np.diag(pooled))
    norm = np.outer(scale, scale)
    logs = []
    for k in (0, 1):
        c = 0.5 * cov[k] / norm + 0.5 * (target / norm + 1e-6 * np.eye(len(scale)))
        d = {i: (v - group[k].mean(0)) / scale for i, v in x.items()}
        logs.append({i: math.log(n[k] / len(learned)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * v @ np.linalg.solve(c, v) for i, v in d.items()})
    want = {i: 1 / (1 + math.exp(min(500, max(-500, logs[0][i] - logs[1][i])))) for i in x}
    assert all(abs(got[i]["score"] - want[i]) < 1e-6 for i in want)
    held = [(i, y) for i, y, _ in tables()["labels"][0] if fold(i, 3) == 1]
    assert sum(got[i]["predicted"] == y for i, y in held) >= 0.9 * len(held)


def test_op2(spark, corpus):
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = run(spark, corpus, "op2_tokens")
    for i in sorted(DOCS):
        ids = [*t.encode(TEXTS[i] or "", add_special_tokens=False).ids, 0]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def contaminated(text: str | None, item: str | None) -> bool:
    a, b = contamination.shingles(item), contamination.shingles(text)
    return bool(a) and len(a & b) >= 0.8 * len(a) - 1e-9


def test_op3(spark, corpus):
    items = tables()["benchmark"][0]
    want = {(i, k) for i, t in TEXTS.items() for k, item in items if contaminated(t, item)}
    assert {(r["doc_id"], r["item_id"]) for r in run(spark, corpus, "op3_contamination")} == want == {(12, 1)}


@pytest.mark.parametrize("kind", ["int", "string", "date"])
def test_item_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(1, BASE)], "doc_id long, text string")
    items = spark.createDataFrame([("2024-01-02" if kind == "date" else "7", " ".join(BASE.split()[5:40]))], "i string, text string").selectExpr(f"cast(i as {kind}) AS item_id", "text")
    got = contamination.contained(docs, items)
    assert got.schema["item_id"].dataType.simpleString() == kind and got.count() == 1


def test_size_classes():
    items = [(i, prose(n, i), 1) for i, n in enumerate((1, 4, 5, 6, 9, 20, 21, 70, 300))]
    s = contamination.sketches(items)
    assert [p.least for p in s.parts] == sorted(p.least for p in s.parts) and len(s.parts) > 4
    texts = [prose(40, 99) + " " + " ".join(t.split()[: max(1, round(share * len(t.split())))]) + " " + prose(30, 98) for _, t, _ in items for share in (1, 0.9, 0.8, 0.6)]
    got = {(d, i) for d, i, _ in contamination.matches(texts, s, s.gate())}
    assert got == {(d, i) for d, t in enumerate(texts) for i, item, _ in items if contaminated(t, item)} and len(got) >= 12


def plain_chance(word: str, place: dict[str, int], longest: int, chance: np.ndarray, k: int) -> float:
    logs = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        parts = []
        for i in range(max(0, j - longest), j):
            p = place.get(word[i:j])
            c = chance[p, k] if p is not None else language.UNKNOWN if j == i + 1 else 0.0
            parts += [logs[i] + math.log(c)] if c else []
        logs[j] = max(parts) + math.log(sum(math.exp(x - max(parts)) for x in parts))
    return logs[-1]


@pytest.mark.parametrize("strip", [1 << 16, 32])
def test_words_of_any_length(monkeypatch, strip):
    monkeypatch.setattr(language, "STRIP", strip)
    vocab = language.vocabulary(PIECES)
    chance = np.random.default_rng(1).random((len(vocab.pieces), 2)) / len(vocab.pieces)
    long = "".join(random.Random(2).choices("abcdefghijklmnop", k=200))
    texts = ["the", "Zebra", long, "中文分词是一个很难的问题因为没有空格" * 5, long[:-1] + "q", "a"]
    codes, starts, ends, _ = language.words_of([" ".join(texts)])
    place = {p: i for i, p in enumerate(vocab.pieces)}
    want = [[plain_chance("▁" + w.lower(), place, vocab.longest, chance, k) for k in (0, 1)] for w in texts]
    assert np.allclose(language.log_chances(codes, starts, ends, vocab, chance), want, atol=1e-9)


@pytest.mark.parametrize("strip", [1 << 16, 4])
def test_expected_counts_by_listing_segmentations(monkeypatch, strip):
    monkeypatch.setattr(language, "STRIP", strip)
    vocab = language.vocabulary(PIECES)
    place = {p: i for i, p in enumerate(vocab.pieces)}
    chance = np.random.default_rng(4).random((len(vocab.pieces), 1)) / len(vocab.pieces)

    def cuts(word):
        if not word:
            yield []
        for n in range(1, min(len(word), vocab.longest) + 1):
            if n == 1 or word[:n] in place:
                for rest in cuts(word[n:]):
                    yield [word[:n], *rest]

    words, want = ["the", "zebra", "über", "abab", "the"], Counter()
    for w in words:
        ways = list(cuts("▁" + w))
        odds = [math.prod(chance[place[p], 0] if p in place else language.UNKNOWN for p in way) for way in ways]
        for way, x in zip(ways, odds, strict=True):
            for p in way:
                want[p] += x / sum(odds) if p in place else 0
    codes, starts, ends, _ = language.words_of([" ".join(words)])
    got = language.expected_counts(codes, starts, ends, vocab, chance, np.ones((len(words), 1)))[:, 0]
    assert all(abs(got[place[p]] - x) < 1e-9 for p, x in want.items() if x) and abs(got.sum() - sum(want.values())) < 1e-9


def test_predict_is_bayes():
    vocab = language.vocabulary(PIECES)
    place = {p: i for i, p in enumerate(vocab.pieces)}
    model = language.Model(["a", "b", "c"], PIECES, np.random.default_rng(3).random((len(vocab.pieces), 3)) / len(vocab.pieces))
    texts = ["The zebra", "x", "", "12 ?", "über alles"]
    langs, scores = language.predict(texts, model)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        found = re.findall(r"[^\W\d_]+", text.lower())
        total = [sum(plain_chance("▁" + w, place, vocab.longest, model.chance, k) for w in found) for k in range(3)]
        odds = [math.exp(t - max(total)) for t in total]
        assert (lang, score) == (("und", 0) if not found else (model.languages[int(np.argmax(total))], pytest.approx(max(odds) / sum(odds))))


def test_op4(spark, corpus):
    got = run(spark, corpus, "op4_language")
    assert sorted(got) == sorted(DOCS) and all(r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", TEXTS[i] or "")) for i, r in got.items())
    prose_ = [i for i in range(110) if got[i]["held_out"]]
    assert all(got[i]["lang_pred"] == DOCS[i][2] for i in prose_) and len(prose_) > 10


def plain_repeats(texts: dict[int, str | None], w: int = 35) -> dict[int, tuple[int, int, str]]:
    words = {i: words_of(t) for i, t in texts.items()}
    seen = Counter(tuple(x[i : i + w]) for x in words.values() for i in range(len(x) - w + 1))
    out = {}
    for n, x in words.items():
        gone = [False] * len(x)
        for i in range(len(x) - w + 1):
            if seen[tuple(x[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out[n] = (len(x), sum(gone), hashlib.sha256(" ".join(v for v, g in zip(x, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_op5(spark, corpus):
    got = {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in run(spark, corpus, "op5_substrings").items()}
    assert got == plain_repeats(TEXTS) and sum(r[1] > 0 for r in got.values()) >= 4


def test_repeats_of_words_that_linear_hashes_confuse(spark):
    texts = {}
    for n in (2048, 4096):
        fill = [f"{n}f{i}" for i in range(34)]
        for word in thue_morse(n):
            texts[len(texts)] = " ".join(fill[:17]) + "\t" + word + "  " + "\n".join(fill[17:])
    r = random.Random(1)
    pool = [" ".join(r.choices([f"w{i}" for i in range(30)], k=r.randrange(0, 200))) for _ in range(25)]
    for _ in range(40):
        x = r.choice(pool).split()
        a, b = sorted(r.choices(range(len(x) + 1), k=2))
        texts[len(texts)] = r.choice([" ", "  ", "\n"]).join([*r.choices("uvxyz", k=r.randrange(30)), *x[a:b], *r.choices("uvxyz", k=r.randrange(30))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(substrings.remove_repeats(df, ["doc_id"]))}
    assert got == plain_repeats(texts) and all(got[i][1] == 0 for i in range(4))


def test_paths_compact_into_maximal_nonbranching_chains(spark):
    r = random.Random(3)
    pool = [[f"p{k}w{r.randrange(4000)}" for _ in range(400)] for k in range(3)]
    texts = {0: [*pool[0], "x"], 1: ["y", *pool[0]], 2: [*pool[1], *pool[2]], 3: [*pool[1], "z"], 4: [*pool[1][:250], *pool[2]], 5: [*pool[2], *pool[2]]}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in texts.items()], "doc_id long, text string")
    docs = substrings.keyed(df, "doc_id", "text")
    everything = SimpleNamespace(value=np.full(1 << (substrings.SIEVE_BITS - 6), -1, np.int64))
    found = substrings.paths(docs, everything, substrings.W, substrings.K)
    places = {(x["key"], x["pos"]): x for x in rows(found)}
    name = lambda x: (x["anchor"], x["name"])
    copies = Counter(name(x) for x in places.values())
    after = defaultdict(set)
    for (key, pos), x in places.items():
        nxt = places.get((key, pos + x["n"]))
        after[name(x)].add(nxt and name(nxt))
        assert (x["next_anchor"], x["next_name"]) == (name(nxt) if nxt else (None, None))
    links = {}
    for u, to in after.items():
        if len(to) == 1 and None not in to and 1 < copies[u] == copies[next(iter(to))]:
            links[next(iter(to))] = u
    size = {name(x): x["n"] for x in places.values()}

    def head(v):
        at = 0
        while v in links:
            v = links[v]
            at += size[v]
        return (*v, at)

    got = {name(x): (x["head_anchor"], x["head_name"], x["at"]) for x in rows(substrings.chains(substrings.path_kinds(found)))}
    assert got == {v: head(v) for v, c in copies.items() if c > 1}
    assert max(Counter(v[:2] for v in got.values()).values()) > 5 and len({v[:2] for v in got.values()}) < len(got) / 3
    # a passage that two texts share is one span of each, but for the paths at its ends
    keys = {x["doc_id"]: x["key"] for x in df.select("doc_id", "text").join(docs, "text").collect()}
    spans = [x for x in rows(substrings.repeated_spans(df)) if x["key"] in (keys[0], keys[1]) and x["parts"]]
    assert len(spans) == 2 and spans[0]["parts"] == spans[1]["parts"] > 5 and spans[0]["n"] == spans[1]["n"] > 300
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in rows(substrings.remove_repeats(df, ["doc_id"]))}
    assert got == plain_repeats({i: " ".join(x) for i, x in texts.items()})


def test_a_chain_counts_only_where_its_words_are(spark):
    """A name that lies about its words removes nothing."""
    text = " ".join(f"k{i}" for i in range(300))
    words = substrings.Words(*joined_column(pa.array([text])))
    p = substrings.Paths(words)
    own = words.digests(p.start, p.n + substrings.W - 1)
    name, check = (np.bitwise_xor.reduce(substrings.part_hash(p.start, np.ascontiguousarray(own[:, h]))).view(np.int64) for h in (0, 1))
    one = lambda x: np.array([x], np.int64)
    proven = lambda at, n, parts, name, check: bool(substrings.proven_chains(p, one(at), one(n), one(parts), one(name), one(check), substrings.W)[0])
    n, parts = int(p.n.sum()), len(p.n)
    assert proven(0, n, parts, name, check)
    assert not proven(0, n, parts, name, check ^ 1) and not proven(0, n, parts, name ^ 1, check)
    assert not proven(1, n - 1, parts, name, check) and not proven(0, n - 1, parts, name, check) and not proven(0, n, parts - 1, name, check) and not proven(0, n, parts + 1, name, check)


def test_rows_alike_in_id_and_text(spark):
    text = " ".join(f"z{i % 1700}" for i in range(2000))
    df = spark.createDataFrame([(7, text)] * 3000 + [(8, "z3 " * 20)], "doc_id long, text string").repartition(8)
    spans = substrings.repeated_spans(df).groupBy("key").agg(F.collect_set(F.struct("pos", "n", "check")).alias("s")).select(F.size("s").alias("n")).collect()
    assert len(spans) == 1 and spans[0]["n"] <= 2 * 2000
    assert Counter(r["n_removed"] for r in rows(substrings.remove_repeats(df, ["doc_id"]))) == {2000: 3000, 0: 1}


def plain_base(text: str | None) -> list[tuple[int, int, int]]:
    text = text or ""
    rules = (
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    )
    return sorted(((k, m.start(), m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m)), key=lambda s: (s[1], s[0]))


def test_op6(spark, corpus):
    got = run(spark, corpus, "op6_secrets")
    for i, t in TEXTS.items():
        base = plain_base(t)
        assert tuple(got[i][n] for n in ("n_assign", "n_access", "n_hex")) == tuple(sum(s[0] == k for s in base) for k in range(3))
        listed = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for k, a, b in base]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(got[i]["spans"].split(",")) | {""}


def test_base_rules_on_odd_texts():
    r = random.Random(8)
    bits = ["password", "PassWd", "ſecret", "secret", "toKen", "api_key", "APIkey", "apI", '"', "'", " ", "  ", ":", "=", "abc", "x9_", "AKIA", "Z" * 17, "0f" * 13, "é", "\n", "日", "Key", "."]
    texts = ["".join(r.choices(bits, k=r.randrange(1, 14))) for _ in range(3000)]
    found = secrets.find(texts, None)
    assert [[tuple(s) for s in spans] for spans in found] == [plain_base(t) for t in texts] and sum(map(len, found)) > 300


def test_gradient_of_the_field():
    rng = np.random.default_rng(6)
    n, t, f = 3, 5, len(secrets.FEATURES)
    x, tags, real = rng.integers(0, 2, (n, t, f)).astype(float), rng.integers(0, 3, (n, t)), np.ones((n, t), bool)
    real[1, 3:] = False
    w, s = rng.normal(0, 0.3, (f, 3)), rng.normal(0, 0.5, (3, 3))

    def score(w, s, i, y):
        size = int(real[i].sum())
        return sum(x[i, j] @ w[:, y[j]] for j in range(size)) + s[0, y[0]] + sum(s[y[j - 1], y[j]] for j in range(1, size))

    def value(w, s):
        total = 0.0
        for i in range(n):
            size = int(real[i].sum())
            total += score(w, s, i, tags[i]) - math.log(sum(math.exp(score(w, s, i, y)) for y in itertools.product(range(3), repeat=size)))
        return total / n

    g_w, g_s = secrets._objective(x, tags, real, w, s)
    for a, g in ((w, g_w), (s, g_s)):
        for at in [(0, 0), (1, 2), (2, 1)]:
            had = a[at]
            a[at] = had + 1e-5
            up = value(w, s)
            a[at] = had - 1e-5
            down = value(w, s)
            a[at] = had
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def field(spark):
    r = random.Random(21)
    make = lambda n, pool=string.ascii_letters + string.digits: "".join(r.choices(pool, k=n))
    texts = []
    for _ in range(400):
        text = [prose(r.randrange(20, 60), r.randrange(10**6)).replace("0", "") for _ in range(2)]
        what = r.choice([f'password = "{make(18)}"', f"api_key={make(32)}", "AKIA" + make(16, string.ascii_uppercase + string.digits), make(40, "0123456789abcdef"), f"token: {make(24)}", "", "Call 555 1234 or see item 42-B.", "On 2024-01-02 at 10:30 v1.2.3 of ABC came."])
        texts.append(f"{text[0]} {what} {text[1]}")
    return secrets.learn(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_secrets_that_no_rule_finds(field):
    """Other prefixes, alphabets and no hint words: precision and recall of what the field adds, by tokens' characters."""
    r = random.Random(22)
    make = lambda n, pool=string.ascii_letters + string.digits: "".join(r.choices(pool, k=n))
    hit = planted = false = 0
    for i in range(300):
        secret = [lambda: "ghp_" + make(36), lambda: "xoxb-" + make(11, string.digits) + "-" + make(24), lambda: make(30) + "7", lambda: "AIza" + make(35)][i % 4]()
        lead = ["", "pwd ", "Bearer ", "credential: "][r.randrange(4)]
        before = " ".join(r.choices(WORDS, k=25)) + f" on 2024-03-{10 + i % 19} page {i} "
        text = before + lead + secret + " " + " ".join(r.choices(WORDS, k=25)) + "."
        assert not plain_base(text)
        a, b = len(before + lead), len(before + lead + secret)
        spans = [s[1:] for s in secrets.find([text], field)[0]]
        planted += 1
        hit += sum(max(0, min(b, e) - max(a, s)) for s, e in spans) >= 0.9 * (b - a)
        false += sum(e <= a or s >= b for s, e in spans)
    assert hit >= 0.9 * planted and hit >= 0.9 * (hit + false)


def test_run_that_a_rule_cuts_keeps_its_rest():
    field = secrets.Field(np.zeros((len(secrets.FEATURES), 3), np.float32), np.zeros((3, 3)))
    field.weights[secrets.FEATURES.index("digit_and_letter"), secrets.I] = 5.0
    text = "so password=Tr0ub4dor!xyz9Kq1 end"
    assert secrets.find([text], field) == [[(0, 3, 21), (3, 22, 29)]]


def test_driver_memory_on_texts_full_of_secrets(spark):
    r = random.Random(5)
    make = lambda: "".join(r.choices(string.ascii_letters + string.digits, k=16))
    df = spark.createDataFrame([(i, " ".join(f'{w} password = "{make()}"' for w in r.choices(WORDS, k=8))) for i in range(2000)], "doc_id long, text string")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert secrets.learn(df) is not None
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # kilobytes


def test_op7(spark, corpus):
    fps = {i: plain_fingerprint(t) for i, t in TEXTS.items()}
    part = components(sorted(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    got = run(spark, corpus, "op7_simhash")
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", part[i]) for i in fps}


def test_fingerprint_in_strips(monkeypatch):
    monkeypatch.setattr(simhash, "STRIP", 7)
    assert all(simhash.fingerprint(prose(n, n).encode()) == plain_fingerprint(prose(n, n)) for n in (1, 2, 3, 8, 9, 40))


def test_op8(spark, corpus):
    got = run(spark, corpus, "op8_sharding")
    for i, t in TEXTS.items():
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
    slots = [sorted(r["slot"] for r in got.values() if r["shard"] == s) for s in range(24)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1 and sum(map(len, slots)) == len(DOCS)


def test_op9(spark, corpus):
    data = {i: (np.array(v, np.float32).astype(float), y) for i, v, y in tables()["embeddings"][0]}
    cos = lambda a, b: a @ b / math.sqrt((a @ a) * (b @ b))
    linked = lambda i, j: data[i][1] == data[j][1] and cos(data[i][0], data[j][0]) >= 0.93
    part = components(sorted(data), linked)
    got = run(spark, corpus, "op9_vectors")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (sum(i != j and linked(i, j) for j in data), part[i], part[i] == i) for i in data}
    assert sum(r["n_links"] for r in got.values()) > 20


def test_every_pair_has_one_first_block():
    """Pairs whose distance in a block is on its budget are counted once."""
    rng = np.random.default_rng(12)
    d = 16
    turn, limit = vectors.rotation(d), vectors.budgets(d, 0.93)
    a = rng.normal(size=(40, d))
    a[:, 0] = 0
    a = vectors.unit([x.tobytes() for x in a], "<f8")
    b = a.copy()
    b[:, 0] = np.sqrt(limit[0]) * (1 + np.arange(-20, 20) * 1e-16)
    one = np.ones(40, int)
    counts = sum(vectors.compare(a @ turn.T, b @ turn.T, one, one, block, False, 0.93)[0] for block in (0, 1))
    assert (counts == 1).all()


def test_op10(spark, corpus):
    lengths = {i: len(words_of(t)) + 1 for i, t in TEXTS.items()}
    sizes = sorted(Counter(lengths.values()).items())
    bounds = packing.best_boundaries([s for s, _ in sizes], [n for _, n in sizes], 8)
    got, want = run(spark, corpus, "op10_packing"), {}
    for bucket, top in enumerate(bounds):
        inside = sorted((n, i) for i, n in lengths.items() if n <= top and (not bucket or n > bounds[bucket - 1]))
        room = max(1, 16_384 // top)
        want |= {i: (n, bucket, top, k // room, k % room, top - n) for k, (n, i) in enumerate(inside)}
    assert {i: tuple(r[c] for c in ("n_tokens", "bucket", "bucket_len", "batch", "slot", "pad")) for i, r in got.items()} == want


def test_pipeline(spark, corpus):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]
    docs, held = spark.read.parquet(f"{corpus}/documents.parquet"), {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = spark.createDataFrame(stage(spark, current, corpus).collect(), docs.schema)
        assert current.columns == docs.columns
        held[name] = {r["doc_id"]: r for r in rows(current)}
    score = {i: r["score"] for i, r in run(spark, corpus, "op1_quality").items()}
    good = [i for i in DOCS if score[i] >= 0.5]
    assert sorted(held["quality"]) == good and len(good) < len(DOCS)
    fps = {i: plain_fingerprint(TEXTS[i]) for i in good}
    part = components(good, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    first = [i for i in good if part[i] == i]
    assert sorted(held["near_duplicates"]) == first
    items = tables()["benchmark"][0]
    clean = [i for i in first if not any(contaminated(TEXTS[i], item) for _, item in items)]
    assert sorted(held["decontamination"]) == clean
    tagged = held["secrets"]
    assert sorted(tagged) == clean
    for i in clean:
        base = plain_base(TEXTS[i])
        assert all(TEXTS[i][a:b] not in tagged[i]["text"] for _, a, b in base)
        if not base and "[SECRET]" not in (tagged[i]["text"] or ""):
            assert tagged[i]["text"] == TEXTS[i] and tagged[i]["n_chars"] == DOCS[i][4]
        assert tagged[i]["text"] is None or tagged[i]["n_chars"] == len(tagged[i]["text"])
    assert all(tagged[i][c] == DOCS[i][k] for i in clean for k, c in ((2, "lang"), (3, "source")))
    lengths = {i: len(words_of(tagged[i]["text"])) + 1 for i in clean}
    whole = {r["doc_id"]: r for r in rows(corpus_pipeline.run(spark, corpus))}
    assert {i: r["n_tokens"] for i, r in whole.items()} == lengths and all(r["pad"] == r["bucket_len"] - r["n_tokens"] for r in whole.values())


NAMES = """getElementById123 parseHTTPResponseV2 MyClass_Handler42 camelCaseIdentifierWithNumber42 GalaxyS24Ultra5G
org/docs/Getting-Started_v2/API_Reference https://github.com/apache/spark/blob/v3.5.1/core/src/main/scala/org/apache/spark/SparkContext.scala#L2512
550e8400-e29b-41d4-a716-446655440000 const httpsProxyAgent2 = createHttpsProxyAgent(options.proxyUrl8080) iPhone15ProMax256GB and RTX4090Ti vs. RX7900XTX
public static final int MAX_RETRY_COUNT_3 = 5; see PROJ-12345 and CVE-2021-44228 in RFC2616 Kernel 5.15.0-91-generic x86_64-linux-gnu
file:///usr/lib/python3.11/site-packages/numpy/core/_multiarray_umath.cpython-311-x86_64-linux-gnu.so IMG_20240102_103055.jpg 1920x1080 H264
assertThatThrownBy(() -> service.findUserByIdAndTenant2(user1Id)) commit 9fceb02 merged into release/2024-06-01
com.example.project2.service.impl.UserAccountServiceImplV3Test __init__ self.layer_norm1 = nn.LayerNorm(hidden_size768)
ISBN 978-3-16-148410-0 call +49 30 1234567 Boeing737MAX8 AirbusA320neo Model3Performance2021 test_should_return_404_when_user_not_found_v2
utm_source=newsletter&utm_campaign=Spring2024Sale&ref=HomePageBanner3 s3://data-lake-prod2/events/year=2024/month=06/part-00000.snappy.parquet
kubectl -n kube-system get pods coredns-5dd5756b68 0x7ffeefbff5c8 and 0xDEADBEEF WindowsServer2019DatacenterEdition AbstractSingletonProxyFactoryBean2
application/vnd.openxmlformats-officedocument.spreadsheetml.sheet Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36""".split("\n")


def test_names_are_no_secrets(field):
    """Code, addresses, product names and ids beside secrets in like places: precision and recall of 0.9 each."""
    r = random.Random(23)
    make = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    forms = ('client = ApiClient("{}", timeout=30)', 'curl -H "X-Auth: {}" https://api.example.com/v2/users', "export FOO_BAR={}", "see {} for parseHTTPResponseV2")
    false = sum(len(secrets.find([line], field)[0]) for line in NAMES for _ in range(4))
    hit = 0
    for i in range(200):
        secret = make(r.randrange(24, 41))
        text = forms[i % 4].format(secret)
        a, spans = text.index(secret), secrets.find([text], field)[0]
        hit += sum(max(0, min(a + len(secret), e) - max(a, s)) for _, s, e in spans) >= 0.9 * len(secret)
        false += sum(e <= a or s >= a + len(secret) for _, s, e in spans)
    assert hit >= 180 and hit >= 0.9 * (hit + false)


def test_samples_hold_at_any_size(spark, monkeypatch):
    """What is fitted doesn't become nothing where a table has more rows than a step of the threshold."""
    from corvane.plans import sampling

    monkeypatch.setattr(sampling, "threshold", lambda wanted, total, f=sampling.threshold: max(f(wanted, 10**11), f(wanted, total)))
    df = spark.createDataFrame([(i, f'word{i} password = "Abc123def456{i}"', "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    assert secrets.learn(df) is not None
    assert language.learn(df, PIECES).languages == ["de", "en"] and sampling.threshold(20_000, 10**11) > 0


def test_pipeline_on_empty_tables(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{corpus}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).count() == docs.count() == corpus_pipeline.drop_test_items(spark, docs, str(tmp_path)).count()
