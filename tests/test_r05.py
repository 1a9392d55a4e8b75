from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import pii
from corvane.operators import graph
from corvane.streaming import jobs

START = datetime.datetime(2024, 1, 1)


def test_trails_of_a_group_share_a_state(spark, tmp_path):
    """Three runs of a stream: trails that go on, fade, come back and have null names, with as many states as groups."""
    schema = "chunk_id long, query_type string, ts timestamp, success boolean"
    hour = lambda n: START + datetime.timedelta(hours=n)
    first = [(i, "q", hour(i % 5), i % 3 != 0) for i in range(200)] + [(None, None, hour(1), True), (2**60 + 1, None, hour(2), True)]
    second = [(i, "q", hour(40), True) for i in range(0, 200, 2)]
    third = [(i, "q", hour(2000), True) for i in range(5)]
    plain, seen = {}, []
    for rows in (first, second, third):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.stream_trails(jobs.read_table(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), groups=7)
        assert stream.dtypes[:2] == [("chunk_id", "bigint"), ("query_type", "string")]
        out = jobs.drain(stream, str(tmp_path / "s"), "update", ("chunk_id", "query_type"))
        seen.append({(r["chunk_id"], r["query_type"]): r["strength"] for r in out.collect()})
        for c, q, t, s in sorted(rows, key=lambda x: (x[2], x[3])):
            plain[c, q] = jobs.walk_trail(*plain.get((c, q), (None, None)), [(t.replace(tzinfo=datetime.UTC).timestamp(), s)])
        mark = max(r[2] for r in rows).replace(tzinfo=datetime.UTC).timestamp() - 3600
        plain |= {k: (0.0, t) for k, (x, t) in plain.items() if jobs.fades_at(x, t) < mark}
        assert seen[-1].keys() == plain.keys() and all(seen[-1][k] == pytest.approx(plain[k][0], abs=0.011) for k in plain)
    states = spark.read.format("statestore").load(str(tmp_path / "s" / "check"))
    assert states.count() <= 5 and states.select(F.sum(F.size("value.groupState.chunk_id"))).first()[0] == 5
    assert sum(x > 0 for x in seen[-1].values()) == 5


def test_patterns_are_gated_by_what_they_begin_with(spark):
    """Heads of patterns, and findings with and without them: blanked signs, doubtful ends, several patterns of a name, a line with all of them."""
    heads = {r"\QAs a. (b\E": "As a. (b", r"ab?c": "a", r"ab+": "a", r"a\.b\d": "a.b", r"\bkey-\w+": "key-", r"ab|cd": "", r"(?i)ab": "", r"[ab]c": "", r"\Qab": "ab", r"\Qab\E*": "a", r"^x{2}": "", "ñú(b)?": "ñú", r"\b{g}a": "", "": ""}
    assert {p: pii.head(p) for p in heads} == heads
    patterns = [("a", r"\Qone two\E"), ("b", r"key-\d+"), ("b", r"nó.x"), ("c", r"x\^\]\-&&_ y"), ("d", "a")]
    texts = ["one two", "one#fff two\none #fff.two", "one  two\none#fff-two one two", "key-7 nó*x", "key- nóx", "x^]-&&_ y", "bcd", "ONE TWO", 'password=#fff"0123456789abcdef"', None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for doubtful in ([], [("e", "q|two")]):
        own = [(n, p, "[T]") for n, p in patterns + doubtful]
        got = {(r["doc_id"], r["line"], r["pattern_name"]) for r in pii.findings(docs, custom=own).collect()}
        want = set()
        for i, t in enumerate(texts):
            for k, line in enumerate((t or "").split("\n"), 1):
                blank = re.sub(r"#(?:[0-9a-fA-F]{3}){1,2}\b", " ", line)
                want |= {(i, k, f"custom_{n}") for n, p, _ in own if re.search(re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), p), blank)}
        assert got == want | {(8, 1, "generic_key"), (8, 1, "password_assign")} and (2, 2, "custom_a") in want
    assert {r["pattern_name"] for r in pii.findings(docs).where("doc_id = 8").collect()} == {"generic_key", "password_assign"}


def test_lines_meet_many_patterns_at_once(spark):
    """With patterns that all begin with literals, lines are dropped before any of them is applied."""
    docs = spark.range(1).selectExpr("id AS doc_id", "'text' AS text")
    plan = pii.findings(docs.repartition(2), custom=[(str(i), rf"\Qpassage {i} of it\E", "") for i in range(50)])._jdf.queryExecution().analyzed().toString()
    gate = next(x for x in plan.splitlines() if "Filter" in x and "RLIKE" in x)
    assert "(?=[p][a][s])" in gate.replace("\\", "") and "regexp_extract_all" not in gate


def test_equal_entities_meet_by_hash(spark):
    """Rows of repeated chunks aren't sorted before they are taken together, and the largest docstring stays."""
    text = 'def run():\n    """{}"""\nclass A:\n    pass\nfrom a import b\n'
    chunks = spark.createDataFrame([("f.py", text.format(d)) for d in ("one", "two", "") * 9] + [("g.py", text.format("")), (None, text.format("x")), ("h.py", None)], "file string, content string")
    found = graph.entities(chunks)
    plan = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in x]
    assert "HashAggregate" in plan[-1] and found.columns == ["id", "name", "kind", "file", "doc"]
    want = {(f, n, k, (d if n == "run" else "")) for f, d in (("f.py", "two"), ("g.py", ""), (None, "x")) for n, k in (("run", "function"), ("A", "class"), ("b", "import"))}
    rows = found.collect()
    assert len(rows) == 9 and {(r["file"], r["name"], r["kind"], r["doc"]) for r in rows} == want
    assert {r["id"] for r in rows if r["name"] == "run"} == {"f.py::run", "g.py::run", "run"}
