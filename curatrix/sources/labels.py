"""Label text: one small file an image, a line a box."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, scalars


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, split, stem, line_no, line) of the lines with text of all .txt files below root; the split is the name of the file's folder."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return lines(files, "value", "path")


def lines(files: DataFrame, content: str, path: str) -> DataFrame:
    """Lines with text, numbered from 1 among all lines of the file."""
    each = files.select(F.col(path).alias("path"), F.posexplode(F.split(content, r"\r\n?|\n")).alias("n", "line")).where("trim(line) <> ''")
    folder = F.regexp_extract("path", r"([^/\\]+)[/\\][^/\\]*$", 1)
    return each.select("path", names.split_name(folder).alias("split"), names.stem(F.col("path")).alias("stem"), (F.col("n") + 1).alias("line_no"), "line")


def boxes(lines_: DataFrame) -> DataFrame:
    """The lines with class_id, x_center, y_center, width, height; null where a field isn't a number."""
    part = F.split(F.trim("line"), r"\s+")
    at = lambda k: F.try_element_at(part, F.lit(k))
    numbers = {n: scalars.strict_double(at(k)) for k, n in enumerate(("x_center", "y_center", "width", "height"), 2)}
    return lines_.withColumns({"class_id": scalars.strict_int(at(1)).cast("int")} | numbers)


def contents(labels: DataFrame, images: DataFrame) -> DataFrame:
    """(split, stem, content) for every image (split, stem) from lines (split, stem, position, line); empty for images without lines."""
    text = labels.groupBy("split", "stem").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("rows"))
    joined = F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return images.select("split", "stem").distinct().join(text, ["split", "stem"], "left").select("split", "stem", F.coalesce(joined, F.lit("")).alias("content"))


def write(contents_: DataFrame, root: str) -> int:
    """One file an image below root/split, in a folder that all executors share; a file is empty if it has no boxes. Gives the number of files."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for split, stem, content in zip(batch["split"], batch["stem"], batch["content"]):
                target = Path(root, split, f"{stem}.txt")
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_bytes(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return contents_.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
