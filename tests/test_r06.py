from __future__ import annotations

import random
from collections import defaultdict

import pytest

from corvane.operators import graph


def walked(edges, seeds, damping, rounds):
    """Scores as the definition says, pair by pair."""
    around = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            around[a].add(b)
            around[b].add(a)
    out = {}
    for q in {q for q, _ in seeds}:
        mine = {n for p, n in seeds if p == q}
        now = {n: 1 / len(mine) for n in mine}
        for _ in range(rounds):
            step = defaultdict(float, {n: (1 - damping) / len(mine) for n in mine})
            for a, s in now.items():
                for b in around[a]:
                    step[b] += s * damping / len(around[a])
            now = step
        out |= {(q, n): s for n, s in now.items()}
    return out


@pytest.mark.parametrize(("linked", "damping", "rounds", "wide"), [(1 << 26, 0.85, 4, 32), (60, 0.85, 7, 2), (1, 0.5, 3, 1), (60, 0.85, 0, 3), (60, 0.0, 3, 3)])
def test_ppr_in_blocks_of_links(spark, linked, damping, rounds, wide):
    """Repeated, reversed, null and looped edges, a hub, seeds without edges and a null seed, by any number of blocks of targets."""
    draw = random.Random(5)
    edges = [(f"a{draw.randrange(40)}", f"b{draw.randrange(30)}") for _ in range(150)] + [("hub", f"a{i}") for i in range(40)] + [("a1", "a1"), ("a2", None), (None, "b3")]
    edges += [(b, a) for a, b in edges[:20]]
    seeds = [(1, "a3"), (1, "b4"), (1, "a3"), (2, "hub"), (3, "nowhere"), (4, "nowhere"), (4, "a7"), (5, None), (5, "b1")] + [(7, f"a{i}") for i in range(9)]
    got = graph.ppr(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "query_id int, node string"), damping, rounds, every=2, wide=wide, linked=linked).collect()
    want = walked(edges, seeds, damping, rounds)
    assert len(got) == len(want) and {(r["query_id"], r["node"]): r["score"] for r in got} == pytest.approx(want, abs=1e-12)


def test_ppr_of_nothing(spark):
    edges, seeds = spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([(1, 2)], "query_id long, node long")
    assert [tuple(r) for r in graph.ppr(edges, seeds).collect()] == [(1, 2, pytest.approx(0.15))]
    assert graph.ppr(spark.createDataFrame([(1, 2)], "src long, dst long"), seeds.limit(0)).collect() == []


def _shuffled(spark):
    """Rows that this session has shuffled so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_ppr_shuffles_no_edge_in_a_round(spark):
    edges = spark.range(0, 20000, numPartitions=4).selectExpr("xxhash64(id) % 300 AS src", "1000 + id % 700 AS dst")
    seeds = spark.createDataFrame([(i, i - 150) for i in range(300)], "query_id long, node long")
    shuffled = []
    for rounds in (1, 5):
        before = _shuffled(spark)
        graph.ppr(edges, seeds, rounds=rounds).count()
        shuffled.append(_shuffled(spark) - before)
    assert shuffled[1] - shuffled[0] < 2000


def test_ingest_keeps_each_sketch_once(spark, tmp_path):
    """Bands of kept texts have neither their ids nor their sketches; a stream of rows is taken as it is, and equal rows count once."""
    from corvane.streaming import jobs

    draw = random.Random(8)
    texts = ["".join(draw.choices("abcdefgh ", k=300)) for _ in range(60)]
    schema = "name string, text string"
    for i, rows in enumerate(([("/a" * 40 + str(n), t) for n, t in enumerate(texts)] * 2, [("/z1", texts[0] + "!"), ("/z2", texts[1]), ("/z3", "new text " * 9)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.ingest_stream(spark, spark.readStream.schema(schema).parquet(f"{tmp_path}/in").selectExpr("name AS path", "text"), str(tmp_path))
        assert spark.read.parquet(f"{tmp_path}/chunks").count() == 60 + i
    bands, sketches = (spark.read.parquet(f"{tmp_path}/signatures/*/{x}") for x in ("bands", "sketches"))
    assert (bands.count(), sketches.count()) == (61 * 32, 61) and not {"id", "sketch"} & set(bands.columns)
