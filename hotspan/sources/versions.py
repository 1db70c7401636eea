"""Tables written version by version: a version is seen whole or not at all, older ones stay to fall back on.

A version is a folder of Parquet files that no reader looks at until its manifest stands in the table's log. The
manifest names every file with its size; it is written beside its place and renamed into it, which file systems do in
one step and, on shared ones, only where nothing stands there yet. The live version is the newest whose manifest can
be read and whose files are all there in full. One writer at a time is expected; of two, one is told that it lost.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOG, DATA = "_log", "data"
#: Versions that are kept besides the live one.
GENERATIONS = 2


class Files:
    """The file system that holds a path, as Spark's own readers and writers see it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.fs = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def sizes(self, folder: str) -> dict[str, int]:
        """Names and sizes of what lies in a folder; nothing where there is none."""
        if not self.fs.exists(self.path(folder)):
            return {}
        return {s.getPath().getName(): int(s.getLen()) for s in self.fs.listStatus(self.path(folder))}

    def state(self, folder: str) -> tuple:
        """What tells one state of a folder's files from another: their number and size in all, and when its entries were changed."""
        s = self.fs.getContentSummary(self.path(folder))
        return s.getFileCount(), s.getLength(), tuple((e.getPath().getName(), e.getModificationTime()) for e in self.fs.listStatus(self.path(folder)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def head(self, name: str, most: int) -> bytes:
        """The first bytes of a file, `most` at the most; no more is read."""
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readNBytes(most))
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Puts a small file in one step where none stands; FileExistsError otherwise."""
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(beside), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(self.path(beside), self.path(name)):
            self.fs.delete(self.path(beside), False)
            raise FileExistsError(f"another writer has committed {name}")

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def manifests(files: Files, path: str) -> list[dict]:
    """The readable manifests of a table, the newest first."""
    out = []
    for name in sorted(files.sizes(f"{path}/{LOG}"), reverse=True):
        if name.endswith(".json") and not name.startswith("."):
            try:
                out.append(json.loads(files.read(f"{path}/{LOG}/{name}")))
            except ValueError:
                continue
    return out


def whole(files: Files, path: str, manifest: dict) -> bool:
    """Whether every file of a version is there with its size."""
    there = files.sizes(f"{path}/{manifest['folder']}")
    return all(there.get(n) == size for n, size in manifest["files"].items())


def live(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the live version, None where there is none."""
    files = Files(spark, path)
    return next((m for m in manifests(files, path) if whole(files, path, m)), None)


def write(df: DataFrame, path: str, batch: int | None = None, generations: int = GENERATIONS) -> int:
    """Commit `df` as the next version and return its number; with `batch`, a batch that is in already is not written again.

    A writer that dies before its manifest stands leaves the version before it live. Then versions before
    `generations` older whole ones are removed, so a reader may finish on a version that has just been replaced.
    """
    spark = df.sparkSession
    files = Files(spark, path)
    old = live(spark, path)
    if batch is not None and old is not None and old["batch"] is not None and old["batch"] >= batch:
        return old["version"]
    numbers = [int(n.split(".")[0]) for n in files.sizes(f"{path}/{LOG}") if n.split(".")[0].isdigit()]
    number = max(numbers, default=0) + 1
    folder = f"{DATA}-{number:08d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    made = {n: size for n, size in files.sizes(f"{path}/{folder}").items() if n.endswith(".parquet")}
    kept = batch if batch is not None else old["batch"] if old else None
    manifest = {"version": number, "folder": folder, "batch": kept, "schema": df.schema.jsonValue(), "files": made}
    files.write_new(f"{path}/{LOG}/{number:08d}.json", json.dumps(manifest))
    known = manifests(files, path)
    good = [m["version"] for m in known if whole(files, path, m)]
    for m in known:
        if len(good) > generations and m["version"] < good[generations]:
            files.remove(f"{path}/{LOG}/{m['version']:08d}.json")
            files.remove(f"{path}/{m['folder']}")
    return number


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The live version, or the one of that number; ValueError where it is not there or not whole."""
    files = Files(spark, path)
    found = [m for m in manifests(files, path) if (version is None or m["version"] == version) and whole(files, path, m)]
    if not found:
        raise ValueError(f"no whole version in {path}")
    m = found[0]
    return spark.read.schema(T.StructType.fromJson(m["schema"])).parquet(f"{path}/{m['folder']}")


def restore(spark: SparkSession, path: str) -> int:
    """Take the newest version back, so that the one before it is live; its number. ValueError where there is no older whole one."""
    files = Files(spark, path)
    known = manifests(files, path)
    older = next((m for m in known[1:] if whole(files, path, m)), None)
    if older is None:
        raise ValueError(f"nothing to fall back on in {path}")
    for m in known:
        if m["version"] > older["version"]:
            files.remove(f"{path}/{LOG}/{m['version']:08d}.json")
    return older["version"]
