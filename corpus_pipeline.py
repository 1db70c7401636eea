"""The corpus pipeline: each stage reads as Parquet what its predecessor has written.

Every stage is a function of (spark, docs, sf_dir) that gives the documents it keeps with the columns of `documents`;
the last gives the pieces of packed sequences. `docs` is always a stored table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.llm import decontaminate, linededup, packing, quality, simhash
from hotspan.llm.common import shared_folder, table
from hotspan.llm.queries import TOKENIZER

#: Documents scored under this go; lower than the classifier's own threshold, so that doubtful ones stay.
REJECT_UNDER = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with the columns of `documents` only; sets the Arrow limits that table() sets."""
    table(spark, sf_dir, "documents")
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, learnt from labels.quality of those not held out."""
    docs = bounded(spark, docs, sf_dir)
    model = quality.fit(quality.training_rows(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "quality"))
    judged = quality.score(docs.withColumn("kept", F.col("text")), model, REJECT_UNDER)
    return judged.where("predicted = 1").select("doc_id", F.col("kept").alias("text"), "lang", "source", "n_chars")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one closely; n_chars follows the text."""
    made = linededup.dedup_lines(bounded(spark, docs, sf_dir))
    return made.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(bounded(spark, docs, sf_dir))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    return decontaminate.clean(bounded(spark, docs, sf_dir), table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences."""
    return packing.pack(bounded(spark, docs, sf_dir).select("doc_id", "text"), TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]
#: SQL cannot express the classifier, SimHash and the tokenizer; tests/llm/test_pipeline.py holds run() against plain
#: Python, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
