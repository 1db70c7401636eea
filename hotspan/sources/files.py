"""Raw text files of detections, and JSON state that runs append to."""

from __future__ import annotations

import csv
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning
from .versions import Files

RAW_FILES = "firms_*.csv"
NAME = r"(firms_[^/]*\.csv)"
#: Bytes that hold a file's header, and how many files are looked into at once.
HEAD, AT_ONCE = 65536, 16


def file_name(path: Column | str) -> Column:
    """The name of a raw file; that of its folder where a job wrote it in parts."""
    return F.regexp_extract(path, NAME, 1)


def header(files: Files, path: str) -> tuple[str, ...]:
    """The column names in a file's first line that is not blank; none where the first HEAD bytes hold no whole line or names are blank or repeated."""
    got = files.head(path, HEAD)
    lines = got.decode("utf-8-sig", errors="replace").splitlines(keepends=True)
    first = next((x for x in lines if x.strip()), "")
    if not first.endswith(("\n", "\r")) and len(got) == HEAD:
        return ()
    names = tuple(c.strip() for c in next(csv.reader([first.strip("\r\n")]), []))
    return names if all(names) and len({c.lower() for c in names}) == len(names) else ()


def scan(spark: SparkSession, folder: str, required: tuple[str, ...] = cleaning.REQUIRED) -> tuple[DataFrame, list[str]]:
    """The rows of all raw files in `folder` as text columns, with source_file and source_satellite, and the names of files left out.

    A file is left out whose header, its first line that is not blank, cannot be read or has not all `required` columns; other
    columns may differ and are NULL where a file has none. Only the first bytes of a file are read for its header; files of
    one header are one scan. ValueError if no file can be read.
    """
    try:
        listed = sorted(spark.read.text(f"{folder}/{RAW_FILES}").inputFiles())  # lists the files and reads none
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"no raw file in {folder}") from e
    files = Files(spark, folder)
    paths = [files.path(spark._jvm.java.net.URI(p)).toString() for p in listed]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        headers = list(pool.map(lambda p: header(files, p), paths))
    heads: dict[tuple[str, ...], list[str]] = {}
    for path, columns in zip(paths, headers, strict=True):
        if not set(required) - set(columns):
            heads.setdefault(columns, []).append(path)
    if not heads:
        raise ValueError(f"no raw file in {folder} has the columns {list(required)}")
    rows = None
    for columns, some in sorted(heads.items()):
        part = spark.read.schema(", ".join(f"`{c.replace('`', '``')}` string" for c in columns)).option("header", True).csv(some)
        part = part.withColumn("source_file", file_name(F.col("_metadata.file_path")))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    name = lambda p: (re.findall(NAME, p) or [p])[0]
    skipped = sorted({name(p) for p in paths} - {name(p) for some in heads.values() for p in some})
    return rows.withColumn("source_satellite", cleaning.satellite_label(F.col("source_file"))), skipped


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a log of JSON lines; what stands there is never rewritten."""
    rows.write.mode("append").json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Write a download as Parquet; where there is one already it stays as it is."""
    rows.write.mode("ignore").parquet(path)


def fetch_range(source: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Save what `source` (product, acq_date, ...) has for each request of `wanted` (product, chunk_start, chunk_days); (product, chunk_start, chunk_days, record_count, outcome) of all.

    A request's rows are one folder of Parquet files below `folder`. One that is there already is neither fetched nor
    written again, whatever `source` has by now: `kept`, with its own count. The others are `saved`, or `empty` where
    there is nothing, which leaves no folder and is asked for again the next time. Requests are told once each.
    """
    spark = source.sparkSession
    files = Files(spark, folder)
    there = [(p.partition("=")[2], c.partition("=")[2]) for p in sorted(files.sizes(folder)) if p.startswith("product=") for c in sorted(files.sizes(f"{folder}/{p}")) if c.startswith("chunk_start=")]
    present = spark.createDataFrame(there, "product string, chunk_start string").select("product", F.col("chunk_start").cast("date"))  # as many as folders
    asked = wanted.select("product", "chunk_start", "chunk_days").distinct()
    new = asked.join(present, ["product", "chunk_start"], "left_anti")
    days = new.withColumn("acq_date", F.explode(F.expr("sequence(chunk_start, date_add(chunk_start, chunk_days - 1))"))).drop("chunk_days")
    source.join(days, ["product", "acq_date"]).write.mode("append").partitionBy("product", "chunk_start").parquet(folder)
    # One level below the folders of partitions, as a table without any row has no schema to read.
    saved = spark.read.schema("acq_date date, product string, chunk_start date").parquet(folder).groupBy("product", "chunk_start").agg(F.count("*").alias("record_count"))
    told = asked.join(saved, ["product", "chunk_start"], "left").join(present.withColumn("old", F.lit(True)), ["product", "chunk_start"], "left")
    outcome = F.when(F.col("old"), "kept").when(F.col("record_count") > 0, "saved").otherwise("empty")
    return told.select("product", "chunk_start", "chunk_days", F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"), outcome.alias("outcome"))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log of JSON lines; no rows where it is missing, and none for lines that cannot be read."""
    try:
        rows = spark.read.schema(f"{schema}, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.where("__bad is null").drop("__bad")
