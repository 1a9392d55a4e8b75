"""From raw documents to packed training batches, in five stages.

Each stage works on all that the one before it kept; between stages the documents are written as
Parquet and read again. All stages but the last return the columns of ``documents``, unchanged but
for redacted texts and their lengths, and any further columns, whatever their names.

Null and empty texts are documents like others in every stage: they are scored, are copies of each
other, contain no item and no secret, and have length 1. Repeated rows have one fate in the stages
that drop rows. A text of any length is worked on whole. Empty tables, of documents, labels or
items, give a defined result: without labels every score is one half, so all documents stay;
without items none is dropped; no documents give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import contamination, packing, quality, secrets, simhash
from corvane.llm.tables import table
from corvane.plans.scratch import cut


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on the labels outside the held-out fold, takes for good."""
    stats = cut(quality.with_statistics(docs, ["doc_id"]), "statistics")
    model = quality.fit(quality.training_rows(stats, table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return simhash.keep_first(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of ``benchmark``."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a tag in the place of every secret, and n_chars to match."""
    return secrets.redact(docs, secrets.learn(docs), length_col="n_chars")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The length bucket, batch and slot of every document."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_test_items),
    ("secrets", redact_secrets),
    ("packing", pack_batches),
]

#: SQL can't express the discriminant, the random field and the fingerprints; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
