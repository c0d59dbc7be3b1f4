"""Splits that keep related records together (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph


def entity_links(records: DataFrame, record: str, entity: str) -> DataFrame:
    """(a, b): each record with the least record of each of its entities; as many links as rows, not as pairs."""
    r = records.select(F.col(record).alias("b"), F.col(entity).alias("e")).dropna().distinct()
    return r.join(r.groupBy("e").agg(F.min("b").alias("a")), "e").select("a", "b")


def related(records: DataFrame, record: str, entity: str) -> DataFrame:
    """(node, root): records that share an entity, directly or through others. A record alone with its entities is its own root."""
    linked = graph.star_components(entity_links(records, record, entity))
    alone = records.select(F.col(record).alias("node")).dropna().distinct().join(linked, "node", "left_anti")
    return linked.unionByName(alone.select("node", F.col("node").alias("root")))


def assign_splits(records: DataFrame, key: str, links: DataFrame, record: str, entity: str, parts: dict[str, float], seed: int = 11) -> DataFrame:
    """(key, root, split): every record of `records` in one of the splits, related ones in the same.

    `links` has rows (record, entity) whose record is a value of `key`. The hash of the component's root, with the seed, decides by ranges as wide
    as the proportions, so a component stays in its split whatever else is added, unless its root changes. Proportions must be positive or 0 and
    are scaled to sum 1; they hold in expectation over components, so a giant component may outweigh its split. Null keys, and rows of links whose record or
    entity is null, are left out; repeated rows count once.
    """
    total = sum(parts.values())
    if not parts or total <= 0 or min(parts.values()) < 0:
        raise ValueError("proportions must be positive")
    at = F.pmod(F.xxhash64("root", F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    split, reached = F.lit(None).cast("string"), 0.0
    names = [k for k, v in parts.items() if v > 0]
    for name in names:
        reached += parts[name] / total
        split = F.coalesce(split, F.when((at < reached) | F.lit(name == names[-1]), name))
    roots = related(links, record, entity).withColumnRenamed("node", key)
    all_keys = records.select(key).dropna().distinct()
    return all_keys.join(roots, key, "left").withColumn("root", F.coalesce("root", F.col(key))).withColumn("split", split)


def torn(roots: DataFrame, splits: DataFrame, key: str, split: str) -> DataFrame:
    """(root): components whose records have more than one split; null splits don't count."""
    s = roots.join(splits.select(F.col(key).alias("node"), F.col(split).alias("s")).dropna().distinct(), "node")
    return s.groupBy("root").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).where("lo <> hi").select("root")
