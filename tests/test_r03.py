"""Findings of the third round, each on a small input."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F


def test_store_writes_no_shingle_sets(spark, tmp_path):
    from corvane.operators.history import SignatureStore

    r = random.Random(5)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(4)]
    store = SignatureStore(spark, str(tmp_path), slots=2)
    rows = [*enumerate(texts), (4, texts[1][:-1])]
    assert sorted(x["doc_id"] for x in store.admit(spark.createDataFrame(rows, "doc_id long, text string"), 0).collect()) == [0, 1, 2, 3]
    written = sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(f"{store.path}/sets") for x in names)
    assert written < 2 * sum(map(len, texts))  # sets of 64-bit hashes take eight times a text


def test_quick_signatures_estimate_similarity(spark):
    from corvane.operators import dedup as D

    r = random.Random(6)
    one = "".join(r.choices("abcdefgh ", k=3000))
    texts = [one, one[300:] + "".join(r.choices("abcdefgh ", k=300)), "".join(r.choices("abcdefgh ", k=3000))]
    rows = D.signed_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digests=False).orderBy("doc_id").collect()
    sets = [set(x["shingles"]) for x in rows]
    for i, j in ((0, 1), (0, 2)):
        share = sum(a == b for a, b in zip(rows[i]["signature"], rows[j]["signature"], strict=True)) / 128
        assert abs(share - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 0.15
    low = [v & 3 for x in rows for v in x["signature"]]
    assert min(low.count(v) for v in range(4)) > 0.15 * len(low)  # sketches need even bits


def test_seeds_by_classes(spark):
    """Pairs are right whatever the cells, and come out of them without being shuffled or made distinct."""
    from corvane.operators import graph as G

    r = random.Random(7)
    words = ["gold", "old", "cold", "ring", "ringer", "bolt"]
    names = [" ".join(r.choices(words, k=2)) for _ in range(60)] + ["", "xx"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    want = sorted((q, n) for q, a in enumerate(names) for n, b in enumerate(names) if any(len(w) > 2 and w in b for w in a.split()))
    for cell in (3, 4096):
        got = G.seeds(df.selectExpr("id AS query_id", "name AS query"), df, cell=cell)
        assert sorted((x["query_id"], x["node"]) for x in got.collect()) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan.split("Repartition")[0]


def test_see_also_in_blocks(spark):
    """Blocks smaller than the table, of a key that all articles share and of ties, against brute force; no pair is a row of a join."""
    from corvane.operators import graph as G

    r = random.Random(8)
    sets = [{"all"} | set(r.choices([f"w{i}" for i in range(12)], k=r.randint(0, 6))) for _ in range(70)]
    df = spark.createDataFrame([(a, w) for a, s in enumerate(sets) for w in s], "article long, keyword string")
    for least, block in ((1, 16), (2, 16), (2, 8192)):
        want = []
        for a, s in enumerate(sets):
            best = sorted((-len(s & t), b) for b, t in enumerate(sets) if a != b and len(s & t) >= least)[:4]
            want += [(a, b, -c, i + 1) for i, (c, b) in enumerate(best)]
        got = G.see_also(df, least, 4, block=block)
        assert sorted((x["a"], x["b"], x["common"], x["place"]) for x in got.collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ppr_of_more_queries_than_a_row_holds(spark):
    from corvane.operators import graph as G

    r = random.Random(9)
    edges = {(r.randrange(12), r.randrange(12)) for _ in range(20)} | {(20, 21)}
    seeds = [(q, r.randrange(12)) for q in range(5) for _ in range(2)] + [(7, 20), (8, 99)]
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for q in {q for q, _ in seeds}:
        own = {n for x, n in seeds if x == q}
        s = {n: 1 / len(own) for n in own}
        for _ in range(6):
            t = {n: 0.15 / len(own) for n in own}
            for n, v in s.items():
                for m in near.get(n, ()):
                    t[m] = t.get(m, 0) + 0.85 * v / len(near[n])
            s = t
        want |= {(q, n): round(v, 9) for n, v in s.items()}
    got = G.ppr(spark.createDataFrame(list(edges), "src long, dst long"), spark.createDataFrame(seeds, "query_id long, node long"), rounds=6, wide=2)
    assert {(x["query_id"], x["node"]): round(x["score"], 9) for x in got.collect()} == want
