"""Findings of the third round that are about memory, time and what is shuffled."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from corvane.llm import substrings


class _Handed:
    """Takes a function that a DataFrame would run over its batches."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        return run


class _Sent:
    def __init__(self, value):
        self.value = value


def test_substrings_opens_edges_in_bounded_memory():
    """op5_substrings: a batch of 4 MB of text, all of whose windows are wanted, is worked on in less than 32 MB besides what comes out."""
    rng = np.random.default_rng(3)
    words = np.array([f"w{i:05d}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, len(words), 600)]) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["key", "text"])
    run = substrings.edges(_Handed(), _Sent(np.full(1 << (substrings.SIEVE_BITS - 6), -1, np.int64)), substrings.W, substrings.K)
    tracemalloc.start()
    try:
        windows = sum(len(out.column(2).values) for out in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert windows == 1000 * (600 - substrings.W + 1)
    assert peak < 32


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_shuffles_no_scores(spark):
    """bm25_top10, r07_rrf, r08_dbsf, r11_rerank, r12_corrective, a09_retrieval_metrics: a task sends its best hits only, and they are those of all scores."""
    from corvane.operators import retrieve as R

    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{i}" for i in rng.zipf(1.5, 30) % 40) for _ in range(600)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "")], "chunk_id long, text string")
    asked = spark.createDataFrame([(i, f"t{i} t1 t1 t2") for i in range(30)], "query_id long, query string")
    index = R.build_index(docs.repartition(6))
    scores = R.bm25_scores(R.query_terms(asked), index)
    assert "Exchange" not in _plan(scores)
    few = R.bm25_scores(R.query_terms(asked), index, best=4)
    assert few.count() <= 30 * 4 * index.table.rdd.getNumPartitions() < scores.count()
    rows = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 6)) for r in df.collect())
    assert rows(R.top_hits(few, 4)) == rows(R.top_hits(scores, 4)) == rows(R.bm25(asked, index, 4))


def test_bm25_by_tasks_and_by_shuffle_agree(spark, monkeypatch):
    """bm25: more query terms than go to all tasks, repeated ids, string ids and an empty index."""
    from corvane.operators import retrieve as R

    docs = spark.createDataFrame([("a", "red green"), ("b", "green green blue"), ("b", "red"), ("c", "blue blue sky"), (None, "sky red")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "green red"), (2, "blue sky unheard"), (None, "red"), (3, None)], "query_id int, query string")
    rows = lambda df: sorted(((r["query_id"] or 0, r["chunk_id"] or "", round(r["score"], 9)) for r in df.collect()))
    for table in (docs, docs.where("text <> 'red'").where("chunk_id is not null"), docs.limit(0)):
        index = R.build_index(table)
        with monkeypatch.context() as m:
            here = rows(R.bm25_scores(R.query_terms(asked), index))
            m.setattr(R, "ASKED_ROWS", 0)
            assert here == rows(R.bm25_scores(R.query_terms(asked), index))
    assert R.bm25(asked, R.build_index(docs.limit(0))).count() == 0


def test_probed_copies_leave_in_bounded_batches():
    """r06_knn_cells: however many cells a query asks for, a batch holds a bounded number of copies of query vectors."""
    from corvane.operators import cells

    class Index(cells.CellIndex):
        def _sent(self):
            return _Sent(self.layers)

    class Queries(_Handed):
        schema = {"query_id": type("F", (), {"dataType": type("T", (), {"simpleString": staticmethod(lambda: "bigint")})})}

    low = np.random.default_rng(1).normal(size=(900, 4))
    index = Index(None, cells.Layers(low[:1], low, np.array([0, 900])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array([[float(i), 1.0, 2.0, 3.0] for i in range(1000)])], ["query_id", "v"])
    sizes = [b.num_rows for b in index.probed(Queries(), 450)(iter([batch]))]
    assert sum(sizes) == 450_000 and max(sizes) <= cells.COPIES


def test_block_pairs_sends_a_vector_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """d09_cosine_pairs, d09_dedup_cosine: with twice the vectors each of them is sent as often, in its own precision, and the pairs are all."""
    from corvane.operators import cells

    monkeypatch.setattr(cells, "TILE", 4)
    monkeypatch.setattr(cells, "BLOCKS", 8)
    monkeypatch.setattr(cells, "PRODUCTS", 50)
    x = np.random.default_rng(2).normal(size=(200, 5)).astype(np.float32)
    for n in (100, 200):
        df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, embedding array<float>").repartition(3)
        pairs = cells.block_pairs(df, 0.8)
        plan = pairs._jdf.queryExecution().analyzed().toString()
        assert "sequence(0, 7" in plan and "array<double>" not in plan
        unit = x[:n].astype(float) / np.linalg.norm(x[:n].astype(float), axis=1)[:, None]
        a, b = np.nonzero(np.triu(unit @ unit.T > 0.8, 1))
        assert sorted(map(tuple, pairs.collect())) == sorted(zip(a.tolist(), b.tolist(), strict=True))


def test_substrings_sends_short_batches(spark):
    """op5_substrings: while spans are found, batches of texts are short; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    with substrings.short_batches(spark):
        assert int(spark.conf.get(key)) == substrings.ROWS
    assert spark.conf.get(key) == own
