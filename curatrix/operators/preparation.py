"""From source annotations to the data set: class map, clipping, emptiness, statistics, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..stage import Stages, as_list


def map_classes(df: DataFrame, name: str, mapping: DataFrame) -> DataFrame:
    """Rows whose source name is in the map (source_name, class_id, class_name), with the class. All other names are dropped, excluded by name or not.

    The map is a class list.
    """
    m = mapping.select(F.col("source_name").alias(name), "class_id", "class_name")
    return df.drop("class_id", "class_name").join(as_list(m), name)


def split_by_scope(predictions: DataFrame, raw_name: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions of a canonical class, with it, and those out of scope."""
    m = mapping.select(F.col("source_name").alias(raw_name), "class_id", "class_name")
    tagged = predictions.drop("class_id", "class_name").join(as_list(m), raw_name, "left")
    return tagged.where("class_id IS NOT NULL"), tagged.where("class_id IS NULL").drop("class_id", "class_name")


def clip_boxes(df: DataFrame, bbox: str = "bbox", width: str = "width", height: str = "height") -> DataFrame:
    """With the clipped box in place of the box, `changed`, and `valid`; an invalid box stays as it was."""
    cut = df.withColumn("_cut", boxes.clip(F.col(bbox), F.col(width), F.col(height)))
    kept = cut.withColumn("valid", F.col("_cut").isNotNull()).withColumn("changed", F.coalesce("_cut.changed", F.lit(False)))
    return kept.withColumn(bbox, F.coalesce("_cut.bbox", bbox)).drop("_cut")


def emptiness(kept: Column, originals: Column) -> Column:
    """Why an image has no box: A if it never had one, B if none was kept; null if it has some."""
    return F.when(kept == 0, F.when(originals == 0, "A").otherwise("B"))


def split_stats(images: DataFrame, objects: DataFrame, classes: DataFrame) -> DataFrame:
    """Per split and class: objects, and images with the class; zeros included.

    images has (split, image_id), objects (split, image_id, class_id), classes (class_id, class_name); the latter is a fixed list.
    """
    every = images.select("split").distinct().join(as_list(classes.select("class_id", "class_name")))  # a few splits by a few classes
    found = objects.groupBy("split", "class_id").agg(F.count("*").alias("objects"), F.count_distinct("image_id").alias("images"))
    return every.join(found, ["split", "class_id"], "left").fillna(0, ["objects", "images"])


def image_stats(images: DataFrame, objects: DataFrame, originals: str) -> DataFrame:
    """Per split: images, negatives, those empty from the start and after the filter, and objects. `originals` counts an image's source objects."""
    kept = objects.groupBy("split", "image_id").agg(F.count("*").alias("kept"))
    tagged = images.join(kept, ["split", "image_id"], "left").fillna(0, ["kept"]).withColumn("why", emptiness(F.col("kept"), F.col(originals)))
    return tagged.groupBy("split").agg(
        F.count("*").alias("images"), F.count("why").alias("negatives"), F.count_if(F.col("why") == "A").alias("originally_empty"),
        F.count_if(F.col("why") == "B").alias("empty_after_filtering"), F.sum("kept").alias("objects"),
    )


def numbered(df: DataFrame, group: str | list[str], order: list[str], name: str = "number") -> DataFrame:
    """Sequential numbers from 1 within each group, in order."""
    return cumulated(df, group, order, F.lit(1), name)


def cumulated(df: DataFrame, group: str | list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """The sum of a weight up to each row of its group, in an order that leaves no ties.

    A group may be as large as a split, so it isn't sorted in one task: ranges of the order are frozen by writing them, summed apart, then shifted.
    """
    spark = df.sparkSession
    groups = [group] if isinstance(group, str) else list(group)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = Stages(spark).write(df.withColumn("_weight", weight).repartitionByRange(ranges, *groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(*groups, "_part").agg(F.sum("_weight").alias("_n"))
    offsets = sizes.select(*groups, "_part", (F.sum("_n").over(Window.partitionBy(*groups).orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a range
    inside = F.sum("_weight").over(Window.partitionBy(*groups, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inside", inside).join(offsets, [*groups, "_part"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before", "_weight")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if clash := df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").head(3):
        raise ValueError(f"not unique: {[tuple(r) for r in clash]}")
