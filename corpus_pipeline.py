"""From raw documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and is written as Parquet and read again before the next. All but the last
return the columns of documents:

1. quality: documents that the positive-unlabelled classifier scores below 0.5 go.
   It learns on the documents of the stage and the labels of the folder.
2. language: documents without a letter or with an ambiguous codeword go.
3. near_dedup: of each SimHash group the row of the smallest doc_id stays.
4. decontamination: documents that hold a benchmark window go.
5. packing: the pieces of the rest in sequences of 2048 tokens.

Null or empty texts, ties, repeated rows, empty tables and further columns: as
the operators' modules say; columns that a stage does not read stay as they are.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm import decontaminate, language, packing, quality, simhash
from cohortflow.llm.common import remainder, table
from cohortflow.session import ensure_checkpoint_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1, remainder(F.col("id"), 3) != 1)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known(docs, remainder(F.col("doc_id"), 5) != 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=3, bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers keep what earlier stages left in memory, so fewer words are kept than in a job of its own.
    return packing.pack_documents(docs, cache_words=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("language", known_language),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The stages learn models, hash words and tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what is between them is written to
    the shared folder that spark.checkpoint.dir names."""
    folder = posixpath.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(posixpath.join(folder, name))
        docs = spark.read.parquet(posixpath.join(folder, name))
    return STAGES[-1][1](spark, docs, sf_dir)
