"""The driver's contract: names, oracles and the flagship query."""

from __future__ import annotations

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "chunk_id", "score"] and df.count() > 0
