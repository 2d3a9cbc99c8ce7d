"""From raw documents to packed training pieces, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
stored before the next one reads it.  All but the last return the columns of
``documents``.  Models are fitted on the labelled rows of the tables in
``sf_dir``, never on what a stage receives; a stage that
receives no row returns none.  Further columns of the documents are carried along up to the last
stage, which has its own.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import held_out, keep_rows
from millrace.llm.decontaminate import contaminated
from millrace.llm.language import SLICE, fit_languages
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.packing import pack, pieces
from millrace.llm.toxicity import fit_toxicity
from millrace.plans.registry import query
from millrace.session import materialize

LEAST_SHARE = 0.4  # of a text's letters, for the language with the most
TOXIC_FROM = 0.3

# None: models, similarity components and packing are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of which one language has a fair share; null texts and texts without a letter have a share of 0 and go."""
    model = fit_languages(_table(spark, sf_dir, "documents"), ~held_out("doc_id", 5, 0))

    return keep_rows(docs, lambda texts: np.array(model.predict(texts)[1]) >= LEAST_SHARE, size=SLICE)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that are not likely to be toxic."""
    labels = _table(spark, sf_dir, "labels")
    model = fit_toxicity(_table(spark, sf_dir, "documents"), labels, ~held_out("doc_id", 4, 2))
    return keep_rows(docs, lambda texts: model.scores(texts) < TOXIC_FROM, size=SLICE // 2)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, stored with a number of their own, as ids can be null or shared; and the number's column, new among theirs."""
    row = "_stage_row"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), f"numbered-{name}"), row


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near copies: five-word shingles, a similarity of 0.8.

    Rows are grouped by their texts alone, so rows that share an id or have none stay unless they are copies.
    A row without an id is kept of a group only if no other one has an id.
    """
    rows, row = _numbered(docs, "near-dedup")
    groups = near_duplicates(rows, words=5, percent=80, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", row)
    kept = groups.join(rows.select("doc_id", row), row).groupBy("component_id").agg(F.min(order)[row].alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a copy of a test item, edited ones included; others with their id, or without one, stay."""
    rows, row = _numbered(docs, "decontaminate")
    found = contaminated(rows, _table(spark, sf_dir, "benchmark"), id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(found, row, "left_anti").drop(row)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 1024 tokens."""
    return pack(materialize(pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces"))


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each on the stored table of the one before."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


@query(ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
