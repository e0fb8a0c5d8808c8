"""A corpus pipeline: documents in, a mix for training out.

Every stage works on what its predecessor kept, written as Parquet and read again, so a lost
executor costs one stage at most. The stages, each by one operator of pricelark.llm:

1. quality rules: documents that the base rules or the posterior reject go;
2. line dedup: lines that stood earlier, up to one word, go; a document left without words goes;
3. near-dedup: one document of each class of near copies stays;
4. decontamination: documents that a benchmark item leaks into go;
5. mixing: the documents taken, with how many copies of each (`copies`, instead of a column of that name).

Null texts are rejected by the first stage. An empty table gives empty stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelark.llm import decontaminate, line_dedup, mixing, near_copies, quality_rules
from pricelark.llm.text import documents
from pricelark.session import ensure_checkpoint_dir
from pricelark.sources.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(docs).filter("copies > 0")
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != "copies"], "copies")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", benchmark),
    ("mixing", mix),
]

#: Classes of near copies are connected components of a hashed search; SQL cannot say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages write stays in the checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
