"""Set operations between tables, and removal with its reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, in a only, in b only. Each side is reduced to its distinct keys before they meet."""
    tagged = a.select(key).distinct().withColumn("a", F.lit(True)).join(b.select(key).distinct().withColumn("b", F.lit(True)), key, "full")
    return tagged.agg(F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("a AND b IS NULL")).alias("only_a"), F.count_if(F.expr("b AND a IS NULL")).alias("only_b"))


def union_reasons(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one boolean a reason): each key of any part once, with the reasons that hold for it."""
    out = None
    for name, df in parts.items():
        one = df.select(key).distinct().withColumn(name, F.lit(True))
        out = one if out is None else out.join(one, key, "full")
    return out.fillna(False, list(parts))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key), key, "left_semi").isEmpty()


def subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.join(b.select(key), key, "left_anti").isEmpty()


def equal(a: DataFrame, b: DataFrame) -> bool:
    """As multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def remove(images: DataFrame, annotations: DataFrame, removed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What stays of both when images are removed; numbers aren't given anew."""
    gone = removed.select(*keys).distinct()
    kept = images.join(gone, keys, "left_anti")
    return kept, annotations.join(kept.select(*keys).distinct(), keys, "left_semi")
