"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpoint, components, shared_folder

__all__ = ["Steps", "checkpoint", "components", "held_out", "shared_folder", "stored", "table"]

#: Rows and bytes of one Arrow batch: bounds what a Python worker holds, however long the texts are.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, with Arrow batches bounded for the Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that no label may be learnt from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


#: Whether a query's shuffle files go as soon as it has ended, instead of when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage and is compressed, unlike a checkpoint."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables stored as by `stored`, whose shuffle files go once they are written, and which `clear` empties when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame) -> DataFrame:
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[made] = path
        return made

    def clear(self, *tables: DataFrame) -> None:
        for t in tables:
            self.spark.createDataFrame([], t.schema).write.mode("overwrite").parquet(self.paths.pop(t))
