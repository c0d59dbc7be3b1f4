"""CSV with a byte-order mark, JSON documents, class configurations and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"

REVIEW = "pair_id string, file_a string, split_a string, file_b string, split_b string, dhash_distance int, rmse double, likely_same_source string, human_decision string, notes string, annotation_flag string"
HISTORY = "epoch int, `train/box_loss` double, `train/cls_loss` double, `train/dfl_loss` double, `val/box_loss` double, `val/cls_loss` double, `val/dfl_loss` double, `metrics/precision(B)` double, `metrics/recall(B)` double, `metrics/mAP50(B)` double, `metrics/mAP50-95(B)` double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header, by name; a byte-order mark is no part of the first name."""
    return spark.read.option("header", "true").option("enforceSchema", "false").option("escape", '"').option("multiLine", "true").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_checked(df: DataFrame, path: str, schema: str, pending: tuple[str, str] | None = None) -> int:
    """Writes, reads back and counts: as many rows, and all of them in the pending state (column, value) if one is given."""
    rows = df.count()
    write_csv(df, path)
    back = read_csv(df.sparkSession, path, schema)
    other = back.where(~F.col(pending[0]).eqNullSafe(pending[1])).count() if pending else 0
    if back.count() != rows or other:
        raise RuntimeError(f"{path}: {rows} rows were written, {back.count()} read back, {other} in another state")
    return rows


def csv_bytes(df: DataFrame, columns: list[str]) -> bytes:
    """A small table as CSV with a byte-order mark, for a spreadsheet."""
    import csv
    import io

    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(["" if v is None else v for v in row] for row in df.select(*columns).toLocalIterator())
    return (BOM + text.getvalue()).encode()


def _text(spark: SparkSession, path: str, text: str, exclusive: bool = False) -> None:
    """Where exclusive, the file system itself refuses to create what is there, so of two writers one fails."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs_path, not exclusive)
    except Exception as e:
        if exclusive and "FileAlreadyExists" in str(e):
            raise FileExistsError(path) from e
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: object, exclusive: bool = False) -> None:
    """One document with sorted keys; exclusive: an error if it is there."""
    _text(spark, path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", exclusive)


def write_data_yaml(spark: SparkSession, path: str, root: str, names: dict[int, str]) -> None:
    """The description of a data set that trainers read."""
    lines = [f"path: {root}", "train: images/train", "val: images/val", "test: images/test", f"nc: {len(names)}", "names:"]
    _text(spark, path, "\n".join([*lines, *(f"  {k}: {v}" for k, v in sorted(names.items()))]) + "\n")


def read_yaml(spark: SparkSession, path: str) -> dict:
    import yaml

    return yaml.safe_load("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def class_config(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(source_name, class_id, class_name) and the names excluded on purpose, of a configuration with classes, a source map and exclusions."""
    found = read_yaml(spark, path)
    ids = {name: int(k) for k, name in found["canonical_classes"].items()}
    rows = [(source, ids[name], name) for source, name in found["approved_source_mapping"].items()]
    return spark.createDataFrame(rows, "source_name string, class_id int, class_name string"), list(found.get("excluded_source_classes") or [])


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A report of a small table; numbers with six decimals at most, a note where rows are left out."""
    rows = df.take(limit + 1)
    show = lambda v: "" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows[:limit])]
    return "\n".join([*lines, *(["", f"Only the first {limit} rows are shown."] if len(rows) > limit else [])]) + "\n"


def summary(counts: dict[str, object]) -> str:
    """Aligned lines for the console."""
    width = max(map(len, counts), default=0)
    return "\n".join(f"{k.ljust(width)}  {v}" for k, v in counts.items())
