"""A derived version of a data set: planned first, gated by the counts expected, then written and validated again from what was written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import refuse_if_exists
from . import sets, validation


@dataclass
class Derived:
    """The tables, their counts by split, and where they were written, if they were."""

    images: DataFrame
    annotations: DataFrame
    counts: DataFrame
    path: str | None


def counted(images: DataFrame, annotations: DataFrame, keys: list[str], split: str) -> DataFrame:
    """(split, images, negatives, objects)."""
    n = annotations.groupBy(*keys).agg(F.count("*").alias("_n"))
    each = images.select(split, *(k for k in keys if k != split)).join(n, keys, "left").fillna(0, ["_n"])
    return each.groupBy(split).agg(F.count("*").alias("images"), F.count_if(F.col("_n") == 0).alias("negatives"), F.sum("_n").cast("bigint").alias("objects"))


def validate(images: DataFrame, annotations: DataFrame, removed: DataFrame, keys: list[str]) -> None:
    """An image stands once, has not been removed, and every annotation has its image."""
    validation.assert_none(validation.repeated(images, keys), "images that stand more than once")
    validation.assert_none(images.join(removed.select(*keys).distinct(), keys, "left_semi"), "images that should be gone")
    validation.assert_none(annotations.join(images.select(*keys), keys, "left_anti"), "annotations without an image")


def derive(images: DataFrame, annotations: DataFrame, removed: DataFrame, keys: list[str], split: str, expected: DataFrame | None = None, out: str | None = None) -> Derived:
    """What stays when images are removed, with their annotations; ids aren't given anew.

    Without `out` this is a plan only, and nothing is written. `expected` (split, images, negatives, objects) is a gate: if the counts aren't these, or the tables are
    not sound, nothing is written either. With `out`, a folder that must not be there yet, both tables are written, read again, and held against the same rules and the
    counts of the plan. Null keys take no part in the removal; empty tables give empty ones.
    """
    kept, own = sets.remove(images, annotations, removed, keys)
    counts = counted(kept, own, keys, split)
    if expected is not None:
        validation.assert_counts(counts, expected, [split])
    validate(kept, own, removed, keys)
    if out is None:
        return Derived(kept, own, counts, None)
    spark = images.sparkSession
    refuse_if_exists(spark, out)
    kept.write.parquet(f"{out}/images")
    own.write.parquet(f"{out}/annotations")
    kept, own = (spark.read.schema(d.schema).parquet(f"{out}/{name}") for d, name in ((kept, "images"), (own, "annotations")))
    validate(kept, own, removed, keys)
    again = counted(kept, own, keys, split)
    validation.assert_counts(again, counts, [split])
    return Derived(kept, own, again, out)
