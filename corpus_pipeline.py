"""A corpus pipeline of five operators: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; what it
returns is written as Parquet and read again as the next stage's ``docs``.  All but
the last return the columns of ``documents``.

1. quality_rules: documents that the policy rejects go.
2. jaccard_join: of each group of near copies (``NEAR_WORDS``-word shingles, similarity of
   ``NEAR_PERCENT`` % or more) the one with the smallest id stays.
3. decontamination: documents that hold a benchmark window go.
4. secret_scans: secrets are replaced by marks of their kind.
5. best_fit_packing: the rest is tokenized and packed.

Nulls, ties and odd tables: null and empty texts fail the quality rules and go.  Rows
with a null id are worked on like any others; in a group of near copies any id goes
before a null one, and of rows that tie (equal ids, or null ids only) one stays.
Repeated rows are copies of each other.  Texts of any length are read whole.  Empty
tables give empty tables, with the same columns; columns beside ``doc_id`` and
``text`` may be missing, null or have any names, and are carried along up to packing.

SQL can't state the tokenizer's ids, so there is no ``ORACLE_SQL``; the tests hold
``run`` against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import _store, decontaminate, jaccard_join, packing, quality_rules, secrets

ORACLE_SQL = None
#: Near copies of the corpus; the query op6 has limits of its own.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _store.pin(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
