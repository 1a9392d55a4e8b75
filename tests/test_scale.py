"""Operators that split hot keys, carry values over partitions or search an index, against plain versions."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import cells, chunk, dedup, graph, joins, metrics, windows
from corvane.operators.retrieve import knn
from corvane.plans import sampling
from corvane.plans.ranking import running
from corvane.streaming import jobs


def tuples(df):
    return [tuple(r) for r in df.collect()]


def test_samples_never_become_empty(spark):
    for total in (10**11, 10**14):
        assert 0 < sampling.threshold(5_000, total) == (5_000 << 63) // total
    assert sampling.threshold(5, 5) == sampling.threshold(5, 0) == 2**63 - 1
    most = sampling.threshold(10_000, 100_000)
    n = spark.range(100_000).where(sampling.chosen(most, "id", seed=3)).count()
    assert 9_500 < n < 10_500 and spark.range(100).where(sampling.chosen(2**63 - 1, "id")).count() == 100


def test_exact_mean_of_a_tie(spark):
    values = [0.43] * 60 + [0.5, 0.5, 0.59, 0.59]  # 27.98 / 64 = 0.4371875
    for order in (values, values[::-1]):
        df = spark.createDataFrame([(v,) for v in order], "v double").repartition(7)
        assert df.agg(metrics.exact_mean("v")).first()[0] == 0.437188
    assert df.limit(0).agg(metrics.exact_mean("v")).first()[0] is None


@pytest.mark.parametrize("before", [False, True])
def test_running_values(spark, before):
    r = random.Random(1)
    data = [(i, r.choice(["hot", "hot", "hot", "a", None]), r.randrange(30), r.choice([None, *range(-5, 40)])) for i in range(400)]
    got = {x["i"]: (x["best"], x["sum"], x["n"]) for x in running(spark.createDataFrame(data, "i long, k string, t long, v long"), [F.col("t"), F.col("i")], ["k"], {"best": ("max", "v"), "sum": ("sum", "v"), "n": ("count", "v")}, before).collect()}
    for i, k, t, _ in data:
        seen = [v for j, kk, tt, v in data if kk == k and (tt, j) < (t, i) + ((1,) if not before else ()) and v is not None]
        first = not any(kk == k and (tt, j) < (t, i) + ((1,) if not before else ()) for j, kk, tt, _ in data)
        assert got[i] == (max(seen, default=None), sum(seen) if seen else None, None if first else len(seen)) or (not seen and got[i][:2] == (None, None) and not got[i][2])
    assert running(spark.createDataFrame([], "i long, k string, t long, v long"), [F.col("t")], ["k"], {"s": ("sum", "v")}).count() == 0


def test_running_mean_rounds_once(spark):
    df = spark.createDataFrame([(i, "k", i, v) for i, v in enumerate([0.43] * 60 + [0.5, 0.5, 0.59, 0.59])], "id long, k string, ts long, v double")
    assert windows.running_mean(df, "k", "v").where("id = 63").first()["running_mean"] == 0.437188


# --- trails ---

START = datetime.datetime(2024, 1, 1)


def deposits(n, seed=2, hours=30):
    r = random.Random(seed)
    return [(r.choice(["c1", "c1", "c2"]), r.choice(["q", "p"]), START + datetime.timedelta(seconds=r.randrange(hours * 3600)), r.random() < 0.6) for _ in range(n)]


def plain_trails(rows):
    out = {}
    for c, q, t, s in sorted(rows, key=lambda x: (x[2], x[3])):
        had = out.get((c, q), (None, None))
        out[c, q] = jobs.walk_trail(*had, [(t.replace(tzinfo=datetime.UTC).timestamp(), s)])
    return out


@pytest.mark.parametrize("stretch", [65_536, 7, 1])
def test_trails_by_composed_steps(spark, stretch):
    rows = deposits(300)
    got = {(r["chunk_id"], r["query_type"]): (r["strength"], r["last"]) for r in jobs.batch_trails(spark.createDataFrame(rows, "chunk_id string, query_type string, ts timestamp, success boolean"), stretch).collect()}
    want = plain_trails(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_faded_trails_leave_the_state(spark, tmp_path):
    schema = "chunk_id string, query_type string, ts timestamp, success boolean"
    late = START + datetime.timedelta(days=30)
    for rows in ([("a", "q", START, True), ("b", "q", START, True)], [("b", "q", late, True)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        got = jobs.drain(jobs.stream_trails(stream), str(tmp_path / "s"), "update", ("chunk_id", "query_type"))
    strengths = {r["chunk_id"]: r["strength"] for r in got.collect()}
    assert strengths["a"] == 0.0 and strengths["b"] == pytest.approx(1.0, abs=0.01)
    assert jobs.fades_at(1.0, 0.0) == pytest.approx(3600 * math.log(0.01) / math.log(0.95)) and jobs.fades_at(0.0, 5.0) == 5.0


# --- vectors ---


def clustered(n, seed=4, d=16, groups=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    return centres[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, d))


def test_cells_find_nine_in_ten_with_a_tenth_of_the_cells(spark):
    x = clustered(4000)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "chunk_id long, embedding array<double>")
    index = cells.build_cells(vectors)
    assert 40 <= index.size <= 90 and index.table.count() == 4000
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(4000)[::40])] + [(-1, None)], "query_id long, embedding array<double>")
    exact = {(r["query_id"], r["chunk_id"]) for r in knn(queries, vectors, 10).collect()}
    few = {(r["query_id"], r["chunk_id"]) for r in index.search(queries, 10, index.size // 10).collect()}
    assert len(few & exact) >= 0.9 * len(exact)
    assert index.probes_for(10, 0.9) <= index.size // 10
    all_ = {(r["query_id"], r["chunk_id"], r["rank"]) for r in index.search(queries, 10, index.size, tile=16).collect()}
    assert all_ == {(r["query_id"], r["chunk_id"], r["rank"]) for r in knn(queries, vectors, 10).collect()}
    read = index.table.where("cell = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(cell), EqualTo(cell,3)]" in read


def test_cells_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert cells.knn_cells(asked, none).count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0])], "chunk_id long, embedding array<double>")
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in cells.knn_cells(asked, one).collect()] == [(1, 5, 1.0)]


def test_block_pairs_and_first_kept_by_brute_force(spark):
    x = [v.tolist() for v in clustered(120, groups=12)]
    x += [x[3], x[3], [0.0] * 16, [0.0] * 16]
    cos = lambda a, b: float(np.dot(a, b) / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-300))
    like = {(i, j) for j in range(len(x)) for i in range(j) if cos(x[i], x[j]) > 0.95}
    df = spark.createDataFrame([*enumerate(x), (900, None)], "id long, embedding array<double>")
    assert set(tuples(cells.block_pairs(df, 0.95, tile=7))) == like
    kept = []
    for i in range(len(x)):
        if not any((j, i) in like for j in kept):
            kept.append(i)
    got = {r["id"]: r["kept"] for r in dedup.dedup_cosine(df, 0.95).collect()}
    assert sorted(i for i, k in got.items() if k) == kept and len(got) == len(x)
    assert dedup.dedup_cosine(df.limit(0)).count() == 0


# --- phrases, pairs of a key, rings ---


@pytest.mark.parametrize("block", [joins.PHRASE_BLOCK, 12])
def test_containing_by_brute_force(spark, block):
    r = random.Random(6)
    make = lambda n: "".join(r.choices("ab é日", k=n))
    docs = [(i, make(r.randrange(0, 60))) for i in range(60)] + [(60, None), (61, "")]
    phrases = [(i, make(r.randrange(1, 5))) for i in range(40)] + [(40, ""), (41, None), (42, "a"), (43, "a")]
    d, p = spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(phrases, "p long, text string")
    got = joins.containing(d, p, "d", "p", block=block)
    assert sorted(tuples(got)) == sorted((i, j) for i, t in docs for j, q in phrases if t and q and q in t)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert joins.containing(d.limit(0), p, "d", "p").count() == joins.containing(d, p.limit(0), "d", "p").count() == 0


@pytest.mark.parametrize("cell", [1024, 3])
def test_met_pairs_by_brute_force(spark, cell):
    r = random.Random(7)
    rows = {(r.choice(["hot"] * 3 + list("abcdef")), i) for i in range(80) for _ in range(2)}
    met = joins.met_pairs(spark.createDataFrame(sorted(rows), "k string, id long"), ["k"], cell)
    got = tuples(met.select("k", "x.id", F.col("y.id").alias("other")))
    assert sorted(got) == sorted((k, i, j) for k, i in rows for m, j in rows if k == m and i < j)


def test_see_also_and_related_by_brute_force(spark):
    r = random.Random(8)
    words = {i: set(r.choices(["the", "of", *"abcdefghijkl"], [20, 15] + [2] * 12, k=r.randrange(1, 9))) for i in range(50)}
    df = spark.createDataFrame([(i, w) for i, ws in words.items() for w in ws for _ in range(2)], "article long, keyword string")
    for least in (1, 2, 3):
        want = []
        for a in words:
            near = sorted((-len(words[a] & words[b]), b) for b in words if a != b and len(words[a] & words[b]) >= least)
            want += [(a, b, -c, i) for i, (c, b) in enumerate(near[:4], 1)]
        assert sorted(tuples(graph.see_also(df, least, 4))) == sorted(want)
    common = {(a, b): len(words[a] & words[b]) for a in words for b in words if a < b and words[a] & words[b]}
    got = graph.related(df.withColumnsRenamed({"article": "site", "keyword": "file"}))
    assert {(a, b): n for a, b, n in tuples(got)} == common


@pytest.mark.parametrize("width", [0.25, 3.0])
def test_nearest_niche_by_brute_force(spark, width):
    r = random.Random(9)
    archive = [(f"n{i:02}", round(r.uniform(-1, 1), 3), round(r.uniform(0, 1), 3)) for i in range(12)] + [("twin", 0.5, 0.5), ("also", 0.5, 0.5)]
    queries = [(i, round(r.uniform(-3, 3), 2), round(r.uniform(-1, 2), 2)) for i in range(60)] + [(60, 0.5, 0.5), (61, 0.5, 0.5)]
    got = joins.nearest_niche(spark.createDataFrame(queries, "query_id long, x double, y double"), spark.createDataFrame(archive, "niche string, x double, y double"), ["x", "y"], width)
    want = {q: min((round((x - a) ** 2 + (y - b) ** 2, 9), n) for n, a, b in archive) for q, x, y in queries}
    assert {q: n for q, n, _ in tuples(got)} == {q: n for q, (_, n) in want.items()}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([], "niche string, x double, y double")
    assert joins.nearest_niche(spark.createDataFrame(queries, "query_id long, x double, y double"), empty, ["x", "y"]).count() == 0


# --- packing and graphs ---


def plain_batches(tokens, budget, most, least):
    out, i, n = [], 0, 0
    while i < len(tokens):
        end, left = i, budget
        while end < len(tokens) and end - i < most:
            if left - tokens[end] < 0 and end - i >= least:
                break
            left, end = left - tokens[end], end + 1
        if end - i < least and end < len(tokens):
            end = min(len(tokens), i + least)
        out += [n] * (end - i)
        i, n = end, n + 1
    return out


@pytest.mark.parametrize(("budget", "most", "least", "stretch"), [(200, 16, 4, 65_536), (200, 16, 4, 20), (50, 5, 8, 9), (10_000, 7, 1, 1), (1, 6, 2, 11)])
def test_pack_batches_by_brute_force(spark, budget, most, least, stretch):
    r = random.Random(10)
    texts = [(i, r.choice([None, "", "x" * r.randrange(1, 900)])) for i in range(150)]
    want = plain_batches([max(1, len(t or "") // 4) for _, t in texts], budget, most, least)
    got = chunk.pack_batches(spark.createDataFrame(texts, "doc_id long, text string"), budget, most, least, stretch=stretch)
    assert [r["batch"] for r in got.orderBy("doc_id").collect()] == want
    assert chunk.pack_batches(spark.createDataFrame([], "doc_id long, text string"), 5, 5).count() == 0


def test_entities_have_docstrings(spark):
    code = 'def run(a,\n        b):\n    pass\n\nasync def load(x):\n    """Loads it.\n    All of it."""\n    return 1\nclass A(B):\n    """A class."""\n    def run(self):\n        """' + "y" * 500 + '"""\nfrom m import name\n'
    got = {(r["name"], r["kind"]): r["doc"] for r in graph.entities(spark.createDataFrame([("f.py", code), ("g.py", None)], "file string, content string")).collect()}
    assert got == {("run", "function"): "y" * 200, ("load", "function"): "Loads it.\n    All of it.", ("A", "class"): "A class.", ("name", "import"): ""}


def test_structural_context_by_brute_force(spark):
    r = random.Random(12)
    words = ["load", "parse", "reader", "write", "cache", "index"]
    nodes = [(i, "_".join(r.choices(words, k=2)), f"f{r.randrange(9)}", r.choice([None, "reads the cache", "Parse all"])) for i in range(60)]
    queries = [(i, " ".join(r.choices([*words, "the", "ca", "?"], k=3))) for i in range(25)]
    got = graph.structural_context(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(nodes, "id long, name string, file string, doc string"), 3)
    want = []
    for q, text in queries:
        least = {}
        for i, name, file, doc in nodes:
            if any(w in f"{name}\n{doc or ''}".lower() for w in text.split() if len(w) > 2):
                least[file] = min(least.get(file, 10**9), i)
        want += [(q, f, least[f], n) for n, f in enumerate(sorted(least)[:3], 1)]
    assert sorted(tuples(got.select("query_id", "file", "node", "place"))) == sorted(want)


def test_pagerank_by_hand_with_links_laid_out_once(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (2, 2), (1, 2), (9, 8)]
    both = {(a, b) for a, b in edges if a != b} | {(b, a) for a, b in edges if a != b}
    want = {}
    for q, seeds_ in ((0, [1, 4]), (1, [9]), (2, [77])):
        jump = {n: 1 / len(seeds_) for n in seeds_}
        score = dict(jump)
        for _ in range(20):
            new = {n: 0.15 * t for n, t in jump.items()}
            for a, b in both:
                if a in score:
                    new[b] = new.get(b, 0) + 0.85 * score[a] / sum(x == a for x, _ in both)
            score = new
        want |= {(q, n): s for n, s in score.items()}
    got = graph.ppr(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0, 1), (0, 4), (1, 9), (2, 77)], "query_id long, node long"))
    assert {(r["query_id"], r["node"]): r["score"] for r in got.collect()} == pytest.approx(want)


# --- operators without SQL ---


def test_scores_of_answers(spark):
    weights = {"has_code": 0.2, "has_correct_api": 0.3, "has_imports": 0.1, "is_runnable": 0.2, "cites_source": 0.2}
    answers = [("Use open.\n```python\nopen(x[1])\n```\nsee https://a.b", 1, 1.0, 0, 1, 1), ("```\nf((\n```", 1, 0.0, 0, 0, 0), ("open in core/io.py", 0, 1.0, 0, 0, 1), ("import os and open", 0, 1.0, 1, 0, 0), ("", 0, 0.0, 0, 0, 0)]
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(answers)], "i int, a string")
    got = [r["s"] for r in df.select("i", metrics.score_answer(F.col("a"), F.array(F.lit("open")), F.array(F.lit("os")), weights).alias("s")).orderBy("i").collect()]
    for s, (_, code, api, imports, runs, cites) in zip(got, answers, strict=True):
        assert (s["has_code"], s["has_correct_api"], s["has_imports"], s["is_runnable"], s["cites_source"]) == (code, api, imports, runs, cites)
        assert s["weighted_total"] == pytest.approx(0.2 * code + 0.3 * api + 0.1 * imports + 0.2 * runs + 0.2 * cites, abs=1e-4)


def test_surrogate_is_ridge(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3)) * [1, 5, 0.1] + [0, 2, -1]
    y = x @ [2.0, -0.5, 7.0] + 3 + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    weights, intercept, r2 = metrics.surrogate(df, ["a", "b", "c"], "y", 0.01)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    want = np.linalg.solve(z.T @ z / 200 + 0.01 * np.eye(3), z.T @ (y - y.mean()) / 200)
    assert weights == pytest.approx(want, rel=0.02) and intercept == pytest.approx(y.mean()) and r2 > 0.99


def test_code_chunks_begin_at_definitions(spark):
    code = "import os\n\n@wrap\ndef a():\n    def inner():\n        pass\nclass B:\n    x = 1\nasync def c():\n    pass\n"
    got = chunk.chunk_code(spark.createDataFrame([(1, code), (2, None), (3, "x = 1\n" * 900)], "doc_id long, text string")).orderBy("doc_id", "nth").collect()
    first = [r["content"] for r in got if r["doc_id"] == 1]
    assert "".join(first) == code and first[0] == "import os\n\n" and [c.split("\n")[0] for c in first[1:]] == ["@wrap", "def a():", "class B:", "async def c():"]
    assert all(len(r["content"]) <= 2000 for r in got) and "".join(r["content"] for r in got if r["doc_id"] == 3) == "x = 1\n" * 900


def test_embeddings_are_unit_vectors_of_term_counts(spark):
    from corvane.operators.retrieve import with_embedding

    df = spark.createDataFrame([(1, "red red blue"), (2, "blue red red"), (3, ""), (4, None), (5, "red")], "doc_id long, text string")
    v = {r["doc_id"]: np.array(r["embedding"]) for r in with_embedding(df, "text", 64).collect()}
    assert np.allclose(v[1], v[2]) and np.linalg.norm(v[1]) == pytest.approx(1, abs=1e-6) and not v[3].any() and not v[4].any()
    assert sorted(np.round(v[1][v[1] > 0] ** 2, 4)) == [0.2, 0.8] and v[1] @ v[5] == pytest.approx(2 / math.sqrt(5), abs=1e-6)


def test_corrective_adds_hits_of_variants_behind(spark):
    from corvane.operators.retrieve import bm25, build_index, corrective

    texts = ["install the red server", "configure blue client", "red client and blue server", "nothing here"]
    index = build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    asked = spark.createDataFrame([(1, "install red server and configure blue client", 0.1), (2, "red server", 0.9)], "query_id long, query string, confidence double")
    got = corrective(asked, index, 0.5, 1).orderBy("query_id", "position").collect()
    first = {r["query_id"]: r["chunk_id"] for r in bm25(asked, index, 1).collect()}
    assert [(r["query_id"], r["chunk_id"], r["origin"]) for r in got if r["position"] == 1] == [(q, first[q], "first") for q in (1, 2)]
    rest = [(r["query_id"], r["origin"]) for r in got if r["position"] > 1]
    assert rest and set(rest) == {(1, "added")} and len({(r["query_id"], r["chunk_id"]) for r in got}) == len(got)


def test_own_patterns_from_a_table(spark):
    from corvane.functions import pii

    rows = [("ticket", r"JIRA-\d+", "[TICKET]"), ("badge", r"\bB\d{4}\b", None), (None, "x", "y"), ("none", "", "z"), ("ticket", r"JIRA-\d+", "[TICKET]")]
    own = pii.custom_patterns(spark.createDataFrame(rows, "name string, pattern string, tag string"))
    assert own == [("badge", r"\bB\d{4}\b", pii.TAGS["api_key"]), ("ticket", r"JIRA-\d+", "[TICKET]")]
    df = spark.createDataFrame([(1, "see JIRA-12\nor B1234 and JIRA-7"), (2, None)], "doc_id long, text string")
    found = {(r["doc_id"], r["line"], r["pattern_name"]) for r in pii.findings(df, custom=own).collect()}
    assert found == {(1, 1, "custom_ticket"), (1, 2, "custom_badge"), (1, 2, "custom_ticket")}
    assert df.select(pii.redact(F.col("text"), own)).first()[0] == "see [TICKET]\nor [REDACTED_API_KEY] and [TICKET]"
    with pytest.raises(ValueError, match="patterns"):
        pii.custom_patterns(spark.range(3).selectExpr("concat('n', id) AS name", "'p' AS pattern", "'t' AS tag"), 2)


def test_redaction_keeps_what_stands_around(spark):
    from corvane.functions import pii

    text = "password = 'hunter2!' Authorization: Bearer abcdefghij0123456789.x api_key: \"0123456789abcdefXYZ\" http://u:p@h.io AKIA" + "A" * 16 + " hash = '" + "0f" * 16 + "'"
    got = spark.createDataFrame([(text,)], "t string").select(pii.redact(F.col("t"))).first()[0]
    assert got == "password = '[REDACTED_PASSWORD]' Authorization: Bearer [REDACTED_TOKEN] api_key: \"[REDACTED_API_KEY]\" [REDACTED_PASSWORD] [REDACTED_API_KEY] hash = '[REDACTED_API_KEY]'"


def test_latency_by_ranks(spark):
    r = random.Random(3)
    data = [(r.choice(["a", "a", "b", None]), r.choice([None, r.random()])) for _ in range(200)] + [("one", 2.5), ("none", None)]
    got = {x["k"]: (x["n"], x["p50"], x["p95"]) for x in metrics.latency(spark.createDataFrame(data, "k string, v double"), "k", "v").collect()}
    for k in {k for k, _ in data}:
        v = [x for kk, x in data if kk == k and x is not None]
        assert got[k][0] == sum(kk == k for kk, _ in data)
        assert got[k][1:] == (pytest.approx((np.quantile(v, 0.5), np.quantile(v, 0.95))) if v else (None, None))
