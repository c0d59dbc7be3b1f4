"""Listings, manifests, copies and guards of files on any file system that Spark reaches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..stage import Stages

# fixed values: the suffixes that count as images
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _scan(batches):
    """What each folder holds: its folders and its empty files."""
    import os

    import pandas as pd

    for batch in batches:
        rows = []
        for folder in batch["path"]:
            with os.scandir(folder) as found:
                for x in found:
                    if x.is_dir():
                        rows.append((x.path, True, 0.0))
                    elif x.stat().st_size == 0 and not x.name.startswith(("_", ".")):
                        rows.append((x.path, False, x.stat().st_mtime))
        yield pd.DataFrame(rows, columns=["path", "folder", "modified"])


def empty_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, modified) of the files of no bytes, which Spark's file sources leave out.

    Folders that the executors mount are listed by them, the folders of one depth at a time, and only how many there are reaches the driver. Of other
    file systems the driver walks the listing, as it does for any file source.
    """
    fs, target = _fs(spark, root)
    if fs.getUri().getScheme() == "file":
        stages = Stages(spark)
        level = spark.createDataFrame([(target.toUri().getPath(),)], "path string")
        parts = []
        while True:
            parts.append(stages.write(level.mapInPandas(_scan, "path string, folder boolean, modified double"), "listing"))
            folders = parts[-1].where("folder").select("path")
            n = folders.count() if recursive else 0
            if not n:
                break
            level = folders.repartition(min(n, 1024))
        return stages.together(parts).where("NOT folder").select(F.concat(F.lit("file:"), "path").alias("path"), F.timestamp_seconds("modified").alias("modified"))
    found, each = [], fs.listFiles(target, recursive)
    while each.hasNext():
        status = each.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getModificationTime() / 1000))
    return spark.createDataFrame(found, "path string, modified double").withColumn("modified", F.timestamp_seconds("modified"))


def listing(spark: SparkSession, root: str, suffixes: Iterable[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, size, modified) of the files below root; suffixes are compared without case. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    out = out.unionByName(empty_files(spark, root, recursive).withColumn("size", F.lit(0).cast("bigint")))
    return out.where(names.suffix(F.col("path")).isin(*(s.lower() for s in suffixes))) if suffixes else out


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, sha256) of every file below root, path being relative to it. Each file is hashed by the task that has it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.length(F.lit(root.rstrip("/").removeprefix("file:").replace("//", "/"))) + 2
    clean = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    empty = empty_files(spark, root).select(F.substr(clean, base).alias("path"), F.lit(0).cast("bigint").alias("size"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    return files.select(F.substr(clean, base).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).unionByName(empty)


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): files added, removed or changed between two manifests; none if the folder is as it was."""
    b, a = before.select("path", F.col("sha256").alias("old")), after.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return b.join(a, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def assert_unchanged(before: DataFrame, after: DataFrame) -> None:
    if first := manifest_changes(before, after).head(5):
        raise RuntimeError("protected files changed: " + ", ".join(f"{r['path']} ({r['change']})" for r in first))


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def refuse_if_exists(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if exists(spark, path):
            raise FileExistsError(path)


def overwrite_only(spark: SparkSession, path: str, allowed: str) -> str:
    """The path, emptied, if it is the one folder that may be overwritten; an error for any other, so nothing else is ever deleted."""
    if path.rstrip("/") != allowed.rstrip("/") or not path.strip("/. "):
        raise PermissionError(f"{path} isn't the folder that may be overwritten")
    fs, target = _fs(spark, path)
    if fs.exists(target):
        fs.delete(target, True)
    return path


def copy_files(files: DataFrame, root_in: str, root_out: str) -> DataFrame:
    """Copies the files (path, relative) between folders that all executors share, byte for byte; gives (path, size, sha256) of the copies.

    Each copy is read again and held against its source; where files has a column sha256, against that too. A difference is an error.
    """
    known = F.col("sha256") if "sha256" in files.columns else F.lit(None).cast("string")

    def run(batches):
        import hashlib
        import shutil
        from pathlib import Path

        import pandas as pd

        for batch in batches:
            rows = []
            for path, want in zip(batch["path"], batch["want"]):
                target = Path(root_out, path)
                target.parent.mkdir(parents=True, exist_ok=True)
                shutil.copyfile(Path(root_in, path), target)
                with Path(root_in, path).open("rb") as a, target.open("rb") as b:
                    source, copy = (hashlib.file_digest(f, "sha256").hexdigest() for f in (a, b))
                if copy != source or (want and copy != want):
                    raise RuntimeError(f"the copy of {path} isn't what was to be copied")
                rows.append((path, target.stat().st_size, copy))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256"])

    return files.select("path", known.alias("want")).mapInPandas(run, "path string, size bigint, sha256 string")


def free_space_suffices(path: str, needed: int, reserve: int = 100 << 20) -> bool:
    """Is there room for so many bytes and a reserve? For folders that this machine mounts."""
    import shutil

    return shutil.disk_usage(path).free >= needed + reserve
