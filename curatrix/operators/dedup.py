"""Exact duplicates: groups by content, which copy stays, and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def groups(df: DataFrame, content: str, split: str) -> DataFrame:
    """(content, files, splits, cross_split) of contents that occur more than once; null contents form no group."""
    g = df.where(F.col(content).isNotNull()).groupBy(content).agg(F.count("*").alias("files"), F.count_distinct(split).alias("splits"))
    return g.where("files > 1").withColumn("cross_split", F.col("splits") > 1)


def resolve(df: DataFrame, content: str, split: str, name: str, signature: str) -> DataFrame:
    """All rows with `kept` and `outcome`.

    A content that occurs once stays. In more than one split, one copy stays, of test before val before train, then by name, whatever the
    signatures. Within one split, the first name stays if all signatures agree; if not, all copies go. Null contents stay. What is needed to know of a
    group is three aggregates, so a group of any size is combined before the shuffle and no window holds it.
    """
    key = F.struct((-names.split_priority(F.col(split))).alias("p"), F.col(name).alias("n"))
    rows = df.withColumn("_key", key)
    known = rows.where(F.col(content).isNotNull())
    about = known.groupBy(F.col(content).alias("_content")).agg(
        F.count("*").alias("_files"), F.min(split).alias("_lo"), F.max(split).alias("_hi"), F.min("_key").alias("_first"),
        F.min(signature).alias("_s0"), F.max(signature).alias("_s1"), F.count(signature).alias("_signed"),
    )
    joined = rows.join(about, F.col(content) == F.col("_content"), "left")
    alone = F.coalesce(F.col("_files"), F.lit(1)) == 1
    cross = F.col("_lo") != F.col("_hi")
    agree = F.col("_s0").eqNullSafe(F.col("_s1")) & ((F.col("_signed") == F.col("_files")) | (F.col("_signed") == 0))
    first = F.col("_key") == F.col("_first")
    outcome = F.when(alone, "UNIQUE").when(cross, "CROSS_SPLIT").when(agree, "SAME_SPLIT").otherwise("CONFLICT")
    kept = F.when(alone, True).when(cross | agree, first).otherwise(False)
    return joined.withColumn("outcome", outcome).withColumn("kept", kept).drop("_key", "_content", "_files", "_lo", "_hi", "_first", "_s0", "_s1", "_signed")


def report(df: DataFrame, content: str, split: str, signature: str) -> DataFrame:
    """One row: groups, files in them, cross-split and conflicting groups, files removed, and those of them that conflicts exclude."""
    g = df.where(F.col(content).isNotNull()).groupBy(content).agg(
        F.count("*").alias("n"), (F.min(split) != F.max(split)).alias("cross"),
        (~F.min(signature).eqNullSafe(F.max(signature)) | F.count(signature).between(1, F.count("*") - 1)).alias("conflict"),
    ).where("n > 1")
    dropped = F.col("conflict") & ~F.col("cross")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return g.agg(
        F.count("*").alias("groups"), zero(F.sum("n")).alias("files"), F.count_if("cross").alias("cross_split_groups"), F.count_if("conflict").alias("conflicting_groups"),
        zero(F.sum(F.when(dropped, F.col("n")).otherwise(F.col("n") - 1))).alias("removed_files"), zero(F.sum(F.when(dropped, F.col("n")))).alias("excluded_files"),
    )


def same_name_across(df: DataFrame, name: str, split: str) -> DataFrame:
    """(name, files, splits) of names that, case aside, occur in more than one split."""
    g = df.groupBy(F.lower(name).alias("name")).agg(F.count("*").alias("files"), F.count_distinct(split).alias("splits"))
    return g.where("splits > 1")


def crosses(split: Column) -> Column:
    return F.count_distinct(split) > 1


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows delivered more than once, the last by the given columns; keys repeat a few times, not without bound."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
