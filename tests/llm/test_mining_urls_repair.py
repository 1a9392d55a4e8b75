"""Hard negatives, URL rules and conversation repair against plain versions, and on nulls, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import conversations, negatives, urls
from tests.llm.test_edges import rows

# --- hard negatives ---

VECTORS = "vec_id long, label string, embedding array<double>, score double, row int, d int, block int, id string, key string"


def plain_negatives(data: list[tuple], anchors: set[int], positives: int = 5, negatives_: int = 3) -> list[tuple]:
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in data if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (a, label, v) in enumerate(ok):
        if a not in anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), i, own == label) for m, (i, own, w) in enumerate(ok) if m != n and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fits = sorted((t, i) for t, i, same in scored if not same and -50 * s <= -100 * t <= -95 * s)
            out += [(a, p, rank, i, -s, -t) for rank, (t, i) in enumerate(fits[:negatives_], 1)]
    return sorted(out)


def vector_rows() -> list[tuple]:
    r = random.Random(5)
    out: list[tuple] = []
    for i in range(240):
        length = r.choice([0.2, 1, 1, 1, 9])
        centre = [math.sin(3.7 * (i % 8) + k) for k in range(6)]
        out.append((i, "hot" if i % 3 == 0 else f"l{i % 4}", [length * (c + r.gauss(0, 0.4)) for c in centre]))
    out += [(240, "hot", out[0][2]), (241, "hot", out[0][2]), (0, "hot", out[0][2]), (242, "l1", out[0][2]), (243, "l1", out[0][2])]
    out += [(250, None, [1.0] * 6), (None, "hot", [1.0] * 6), (251, "hot", None), (252, "hot", [1.0, None, 1.0, 1.0, 1.0, 1.0]), (253, "hot", [math.nan] * 6), (254, "hot", [math.inf] * 6)]
    out += [(260, "hot", [0.0] * 6), (261, "l1", [0.0] * 6), (262, "l2", [0.0] * 6), (270, "hot", []), (271, "l1", []), (280, "l1", [5.0, 1.0]), (281, "hot", [4.0, 1.0]), (290, "l1", [5.0, 2.0]), (291, "l1", [9.0, 1.0]), (292, "hot", [4.0, 0.5])]
    return out


@pytest.mark.parametrize("tile", [2048, 16])
def test_negatives_equal_brute_force(spark, tile):
    data = vector_rows()
    df = spark.createDataFrame([(*x, *[None] * 6) for x in data], VECTORS)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, tile=tile)
    want = plain_negatives(data, {i for i, *_ in data if i is not None and i % 10 == 0})
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and len(want) > 50
    assert sorted(tuple(r.values()) for r in rows(got)) == want


def test_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame([(1, "a", [1.0], *[None] * 6)], VECTORS)
    assert negatives.hard_negatives(one, F.col("vec_id") % 50 == 0).collect() == []


def test_long_integer_scores_are_exact(spark):
    big = 3_000_001.0
    data = [(0, "a", [big, big]), (1, "a", [big, big + 1 / 256]), (2, "b", [big * 0.9, big * 0.9]), (3, "b", [big * 0.9, big * 0.9 + 1 / 256]), (4, "b", [1e300, 0.0])]
    df = spark.createDataFrame([(*x, *[None] * 6) for x in data], VECTORS)
    got = sorted(tuple(r.values()) for r in rows(negatives.hard_negatives(df, F.col("vec_id") == 0)))
    assert got == plain_negatives(data[:4], {0}) and got[0][4] > 2**53


@pytest.mark.parametrize(("group", "share"), [(negatives.GROUP, 0.6), (1, 0.2)])
def test_candidates_lose_none_and_prune(monkeypatch, group, share):
    monkeypatch.setattr(negatives, "GROUP", group)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    p = centres[rng.integers(0, 20, 1500)] + 0.15 * rng.normal(size=(1500, 16))
    p = np.round(1000 * p / np.linalg.norm(p, axis=1, keepdims=True))
    norms = np.linalg.norm(p, axis=1)
    q = p[:60]
    s = q @ p.T
    least = np.sort(s, axis=1)[:, -5]
    seen = np.zeros(60, int)
    for who, which in negatives.candidates(q, norms[:60], least, p / norms[:, None], float(norms.max())):
        for i in who:
            seen[i] = len(which)
            assert set(np.flatnonzero(s[i] >= least[i])) <= set(which)
    assert (seen > 0).all() and seen.mean() < share * len(p)
    weak = [which for _, which in negatives.candidates(q, norms[:60], np.zeros(60), p / norms[:, None], float(norms.max()))]
    assert all(len(which) == len(p) for which in weak)


# --- URL rules ---


def plain_judge(url: str | None, rules: list[tuple]) -> tuple:
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = m.groups() if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in ((h.lower(), p or "", v or "block") for h, p, v in rules if h) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, 0, None, "allow"))
    return host, path, best[3], best[4]


URLS = [
    "http://a.example.net/en/1", "HTTP://A.EXAMPLE.NET/EN/1", "https://example.net/en/", "https://example.net/en", "https://net/x", "https://internet/x", "http://example.net", "http://example.net?/en/", "http://www.example.com/de/1#x",
    "http://example.org/fr/?q=http://b.net/", "http://org./fr/", "x://..net/", "no scheme", "", None, "://net/", "http:///net/", "http://a.net/en/://b.org/", "http://é.net/ü", "http://user@net:80/", "http://net:80/", "ftp://b.c.d.e.f.net/" + "p/" * 3000, "http://" + "a." * 3000 + "net/x",
    "http://long.net/deep/er/page", "http://long.net/deep/er/pag", "http://long.net/deep/ER/page", "http://tie.net/aa", "http://sub.tie.net/aa", "two\nlines://example.net/en/\nx", "http://example.net/en/1", "http://example.net/en/1",
]
MORE = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("Long.NET", "/deep/er/pa", "allow"), ("long.net", "/deep/er/page", "block"), ("tie.net", "/aa", "allow"), ("tie.net", "/aa", "block"), (None, "/", "block"), ("", "/", "allow"), ("b.org", None, None), ("net:80", "", "allow")]


@pytest.mark.parametrize("sent", [urls.SENT_RULES, 0])
def test_urls_equal_brute_force(spark, sent):
    df = spark.createDataFrame([(None if i == 3 else i, u, 1, 2, 3) for i, u in enumerate(URLS)], "page_id long, url string, host int, rule int, digest int")
    rules = spark.createDataFrame(MORE, "host string, path string, verdict string")
    got = urls.judge(df, rules, sent=sent)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda x: tuple(str(y) for y in x)
    assert sorted((tuple(r.values()) for r in rows(got)), key=key) == sorted(((None if i == 3 else i, *plain_judge(u, MORE)) for i, u in enumerate(URLS)), key=key)
    assert rows(urls.judge(df, rules.limit(0)))[0]["verdict"] == "allow" and urls.judge(df.limit(0), rules).count() == 0
    kept = urls.keep_allowed(df, rules)
    assert kept.columns == df.columns and sorted(r["url"] or "" for r in rows(kept)) == sorted(u or "" for u in URLS if plain_judge(u, MORE)[3] != "block")


def test_urls_run_without_python(spark, sf):
    plan = urls.judge(spark.read.parquet(f"{sf}/pages.parquet"), urls.rule_table(spark, urls.RULES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "html" not in plan.partition("== Physical Plan ==")[2]


# --- conversations ---

sys.setrecursionlimit(20_000)  # for best() below
CONTENT = re.compile(r"[^\x20\x09-\x0D]")


def plain_damage(data: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in data:
        word = lambda x: " " if x is None else str(x)
        code, role, text = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20, word(role), word(text)
        if code:
            text, role = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text), "user" if code == 4 else role
            out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def plain_repair(turns: list[tuple]) -> tuple:
    """By the definition: the least (cost, audit) over all edits of rows (turn, role, text)."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    faults, seen = [], set()
    for _, role, text in turns:
        solid = CONTENT.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = lambda state, initial: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @functools.cache
    def best(i: int, state: str, inserted: int) -> tuple[int, str, tuple]:
        options = [(0, "", ())] if i == len(turns) and state in ("", "a") else []

        def add(cost: int, letter: str, row: tuple, to: tuple) -> None:
            c, audit, made = best(*to)
            options.append((c + cost, letter + audit, row + made))

        for role in ("user", "assistant"):
            if legal(state, role[0]):
                if inserted < 3:
                    add(3, "I", (f"{role}:",), (i, role[0], inserted + 1))
                if i < len(turns) and faults[i] not in ("blank", "duplicate"):
                    add(3 + 3 * (faults[i] == "truncated"), "R", (f"{role}:{turns[i][2]}",), (i + 1, role[0], 0))
        if i < len(turns):
            add(4, "D", (), (i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate") and (to := legal(state, turns[i][1][:1])):
                add(3 * (faults[i] == "truncated"), "K", (f"{turns[i][1]}:{turns[i][2]}",), (i + 1, to, 0))
        return min(options, default=(10**9, "", ()))

    cost, audit, made = best(0, "", 0)
    initials = [role[:1] for _, role, _ in turns]
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


CONVERSATIONS = "conv_id long, turn long, role string, text string, cost int, chunk int, nth int, audit string"


def conversation_rows() -> list[tuple]:
    r = random.Random(2)
    roles, texts = ["user", "assistant", "system", "umpire", "", " ", "tool", "User", None], ["Hi.", "Ok", "yes!", "why?", "", " \t", "end.  \n", "last\x1f", "Hé…", "日本。", None, "a", "b.", "c.", "d?"]
    out: list[tuple] = []
    for conv in range(60):
        weights = r.choice([[9, 9, 1, 0, 0, 0, 0, 0, 0], [1] * 9, [1, 0, 0, 0, 0, 0, 0, 0, 0], [0, 0, 3, 0, 0, 0, 1, 0, 0], [2, 1, 0, 0, 0, 0, 0, 0, 0]])
        for turn in range(r.randrange(0, 40)):
            word = r.choices(texts, [2] * 9 + [2, 1, 9, 9, 9, 9])[0]
            out.append((conv, None if r.random() < 0.03 else turn + r.choice([0, 0, 0, 1, 5]), r.choices(roles, weights)[0], f"{turn}{word}" if word and r.random() < 0.8 else word))
    out += [(None, t, "user", f"n{t}.") for t in range(5)] + [(None, None, "assistant", "x."), (100, None, None, None), (101, None, "user", "a."), (101, None, "assistant", "b.")]
    dropped = next(t for t in range(1000) if zlib.crc32(f"102:{t}".encode()) % 20 == 0)
    return [*out, (102, dropped, "user", "gone."), *out[:3]]


@pytest.mark.parametrize("chunk", [256, 3, 1])
def test_conversations_equal_brute_force(spark, chunk):
    data = conversation_rows()
    df = spark.createDataFrame([(*x, None, None, None, None) for x in data], CONVERSATIONS)
    want = {}
    for conv, *turn in plain_damage(data):
        want.setdefault(conv, []).append(tuple(turn))
    want = {conv: plain_repair(want.get(conv, [])) for conv in {x[0] for x in data}}
    got = conversations.repair(conversations.damaged(df), df, chunk=chunk)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    listed = [tuple(r.values()) for r in rows(got)]
    assert len(listed) == len(want) and {x[0]: x[1:] for x in listed} == want
    assert want[102] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_chains_that_never_converge_take_few_passes(spark, monkeypatch):
    passes = []
    monkeypatch.setattr(conversations, "_relaxed", lambda state, f=conversations._relaxed: passes.append(1) or f(state))
    data = [(7, t, "system", f"s{t}.") for t in range(301)] + [(8, t, "ua"[t % 2] + "x", f"t{t}.") for t in range(300)]
    df = spark.createDataFrame([(*x, None, None, None, None) for x in data], CONVERSATIONS)
    got = {r["conv_id"]: tuple(r.values())[1:] for r in rows(conversations.repair(df, df, chunk=2))}
    assert got == {conv: plain_repair([x[1:] for x in data if x[0] == conv]) for conv in (7, 8)}
    assert 2 <= len(passes) <= 10


def test_conversations_of_nothing(spark):
    df = spark.createDataFrame([], CONVERSATIONS)
    assert conversations.repair(conversations.damaged(df), df).collect() == []


def test_queries_equal_plain_versions(spark, sf):
    from corvane.llm import queries

    data = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows(spark.read.parquet(f"{sf}/conversations.parquet"))]
    want = {}
    for conv, *turn in plain_damage(data):
        want.setdefault(conv, []).append(tuple(turn))
    got = {r["conv_id"]: tuple(r.values())[1:] for r in rows(queries.op13_conversations(spark, sf))}
    assert got == {conv: plain_repair(want.get(conv, [])) for conv in {x[0] for x in data}}
    vecs = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in rows(spark.read.parquet(f"{sf}/embeddings.parquet"))]
    assert sorted(tuple(r.values()) for r in rows(queries.op11_negatives(spark, sf))) == plain_negatives(vecs, {i for i, *_ in vecs if i % 50 == 0})
    pages = [(r["page_id"], r["url"]) for r in rows(spark.read.parquet(f"{sf}/pages.parquet"))]
    assert sorted(map(str, (tuple(r.values()) for r in rows(queries.op12_urls(spark, sf))))) == sorted(str((i, *plain_judge(u, urls.RULES))) for i, u in pages)
