"""Tables written between the steps of an iterative operator.

A written table cuts the lineage and outlives a lost executor, because it lies in the folder that the cluster shares.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, as in tests, one of our own for this session, but only if all of Spark runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.curatrix.stage.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="curatrix-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.curatrix.stage.dir", found)
    return found.rstrip("/")


_kept: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/curatrix-{tag}-{uuid.uuid4().hex}"
    _kept.add(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes all that this driver has written to the shared folder and not deleted yet, once no result that reads it is needed any more. Gives the number of paths."""
    paths = list(_kept)
    for path in paths:
        delete(spark, path)
    return len(paths)


LIST_ROWS = 100_000


def as_list(df: DataFrame, rows: int = LIST_ROWS) -> DataFrame:
    """A table that should be a short list, for a join: broadcast if it has no more than so many rows, which is counted; else left to the planner."""
    return df.hint("broadcast") if df.limit(rows + 1).count() <= rows else df


class Stages:
    """Writes tables and deletes those that no later step reads.

    Tables that a result still reads stay until `release` is called, or the cluster empties the folder, as it does with checkpoints.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, tag: str = "stage") -> DataFrame:
        path = new_path(self.spark, tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def together(self, dfs: list[DataFrame]) -> DataFrame:
        """Written tables of one schema as one, in one scan."""
        return self.spark.read.schema(dfs[0].schema).parquet(*(self.paths[id(df)][1] for df in dfs))

    def keep(self, written: DataFrame, view: DataFrame) -> None:
        """From now on the written table is known by a view of it."""
        self.paths[id(view)] = (view, self.paths.pop(id(written))[1])

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            if df is not None and (found := self.paths.pop(id(df), None)):
                delete(self.spark, found[1])


def delete(spark: SparkSession, path: str) -> None:
    _kept.discard(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
