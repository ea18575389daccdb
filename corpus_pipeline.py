"""A corpus pipeline of five stages: language, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  What a stage returns is written as Parquet and
read again as the next one's docs.

* language: rows without an identified language, or with a doubtful one, go.
* near_duplicates: one row of each group of near-copies stays, that of the smallest id.
* secrets: found secrets are masked in the text; the rows stay, n_chars follows.
* mixture: rows are repeated or left out so that the sources' words meet their targets.
* packing: every piece of every row with its place in a sequence.

Empty tables pass through every stage; nulls and repeated rows are treated as
each operator's module says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from splitbench.llm import langid, mixing, packing, secret_scan, simhash
from splitbench.llm.common import fewer_files, shared_folder
from splitbench.session import spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fewer_files(langid.keep_identified(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fewer_files(simhash.keep_one(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fewer_files(secret_scan.redact_secrets(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fewer_files(mixing.repeat_by_mix(docs))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fewer_files(packing.pack_documents(docs))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packing", best_fit),
]

#: SQL has no support vector machines and no subword tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
