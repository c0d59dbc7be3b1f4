"""Quality audit: distributions, outliers, compositions, what-if policies, review samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stages
from . import preparation

# fixed values: the points of a distribution, and the source classes of strict negatives
POINTS = {"min": 0.0, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
STRICT_NEGATIVE = ("Blackheads", "Whiteheads")


def distribution(df: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, measure, points): exact percentiles with linear interpolation; null points where there are no values. Nulls don't count; groups by null are no groups.

    Equal values are counted before anything is shuffled, so a value however frequent is one row. Counts are added up in ranges of the values, so no task holds
    those of a group; the values next to each point are all that is gathered.
    """
    each = df.select(*by, F.explode(F.array(*(F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("v")) for v in values))).alias("m")).select(*by, "m.*")
    keys = [*by, "measure"]
    stages = Stages(df.sparkSession)
    distinct = stages.write(each.groupBy(*keys, "v").agg(F.count("*").alias("c")), "values")
    counts = distinct.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("c"))), F.lit(0)).alias("n"))
    upto = preparation.cumulated(distinct.where("v IS NOT NULL"), keys, ["v"], F.col("c"), "upto")
    points = F.array(*(F.struct(F.lit(k).alias("point"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for k, p in POINTS.items()))
    placed = upto.join(counts.where("n > 0").select(*keys, points.alias("points")), keys)
    has = lambda x, place: (place(x["at"]) + 1 > F.col("upto") - F.col("c")) & (place(x["at"]) + 1 <= F.col("upto"))
    near = placed.select(*keys, "v", F.explode(F.filter("points", lambda x: has(x, F.floor) | has(x, F.ceil))).alias("q")).select(*keys, "v", "q.*")
    found = near.groupBy(*keys, "point").agg((F.min("v") + (F.max("v") - F.min("v")) * F.max(F.col("at") - F.floor("at"))).alias("x"))
    wide = found.groupBy(*keys).pivot("point", list(POINTS)).agg(F.first("x"))
    return counts.select(*keys).join(wide, keys, "left")


def histogram(df: DataFrame, flags: str) -> DataFrame:
    """(flag, n) over an array column."""
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def composition(df: DataFrame, key: str, category: str) -> DataFrame:
    """(composition, n): how many keys have exactly this set of categories; categories are sorted and joined by ` + `. Keys without any are in ``."""
    sets = df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(category)), " + ").alias("composition"))
    return sets.groupBy("composition").agg(F.count("*").alias("n"))


def is_strict_negative(categories: Column) -> Column:
    """Some categories, and none but those of strict negatives."""
    return (F.size(categories) > 0) & (F.size(F.array_except(categories, F.array(*map(F.lit, STRICT_NEGATIVE)))) == 0)


def is_mixed(categories: Column) -> Column:
    """Has categories of strict negatives, but others too."""
    return F.arrays_overlap(categories, F.array(*map(F.lit, STRICT_NEGATIVE))) & ~is_strict_negative(categories)


def filter_created_negative(split: Column, kept: Column, categories: Column) -> Column:
    """A training image that had categories and has no annotation left."""
    return (split == "train") & (kept == 0) & (F.size(categories) > 0)


def what_if(images: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """(policy, removed, remaining, objects_remaining): each policy is a condition for removal; one pass over (objects, ...) answers all."""
    removed = lambda c: F.coalesce(c, F.lit(False))
    each = images.select("objects", F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), removed(c).alias("gone")) for n, c in policies.items()))).alias("p")).select("objects", "p.*")
    return each.groupBy("policy").agg(F.count_if("gone").alias("removed"), F.count_if(F.expr("NOT gone")).alias("remaining"), F.coalesce(F.sum(F.when(~F.col("gone"), F.col("objects"))), F.lit(0)).alias("objects_remaining"))


def before_after(images: DataFrame, removed: str) -> DataFrame:
    """Per split: images and objects at first, removed and left, in one pass."""
    gone = F.coalesce(F.col(removed), F.lit(False))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, c)), F.lit(0))
    return images.groupBy("split").agg(
        F.count("*").alias("images"), F.count_if(gone).alias("images_removed"), F.count_if(~gone).alias("images_after"),
        F.sum("objects").alias("objects"), total(F.col("objects"), gone).alias("objects_removed"), total(F.col("objects"), ~gone).alias("objects_after"),
    )


def top_with_reasons(df: DataFrame, rankings: dict[str, tuple[int, list[Column]]], keys: list[str]) -> DataFrame:
    """(keys, reasons): rows that are among the first k of any ranking, each once, with the names of the rankings in their order.

    A ranking is (k, order); the keys end each order, so ties are settled. The first k of each are found by a bounded heap a task.
    """
    parts = None
    for n, (name, (k, order)) in enumerate(rankings.items()):
        one = df.orderBy(*order, *keys).limit(k).select(*keys, F.lit(n).alias("n"), F.lit(name).alias("reason"))
        parts = one if parts is None else parts.unionByName(one)
    merged = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "reason"))).alias("r"))
    return merged.select(*keys, F.array_join(F.transform("r", lambda x: x["reason"]), ";").alias("reasons"))


def _bounded(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows a group and task before the shuffle, so a group of any size is no burden."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n)


def round_robin(df: DataFrame, stratum: str, order: list[Column], size: int) -> DataFrame:
    """`size` rows, taken from the strata in turn: the first of each, then the second of each, and so on; strata in order of their name."""
    ranked = _bounded(df, [stratum], order, size)
    return ranked.orderBy("_r", stratum).limit(size).drop("_r")


def first_per_class(df: DataFrame, class_id: str, order: list[Column], n: int) -> DataFrame:
    return _bounded(df, [class_id], order, n).withColumnRenamed("_r", "rank_no")


def flagged_first(df: DataFrame, flagged: str, key: str, size: int, seed: int) -> DataFrame:
    """`size` rows, flagged ones first, in the order of a seeded hash. Takes the place of a seeded shuffle, whose order no distributed sort can repeat."""
    return df.orderBy(F.col(flagged).desc(), F.xxhash64(F.lit(seed), F.col(key)), key).limit(size)


def pages(df: DataFrame, order: list[str], per_page: int, most: int) -> DataFrame:
    """The first `most` rows with page and place, both from 0, for contact sheets."""
    listed = df.orderBy(*order).limit(most)
    at = F.row_number().over(Window.orderBy(*order)) - 1  # over at most `most` rows
    return listed.withColumn("_at", at).withColumn("page", F.floor(F.col("_at") / per_page).cast("int")).withColumn("place", (F.col("_at") % per_page).cast("int")).drop("_at")


def first_unused(df: DataFrame, rules: list[tuple[str, Column, list[Column]]], key: str) -> DataFrame:
    """(rule, key): for each rule in turn the first row that meets it and that no rule before has taken; a rule that nothing is left for has none.

    Of each rule, as many rows as there are rules are enough to find one unused; so few are gathered.
    """
    parts = None
    for n, (name, condition, order) in enumerate(rules):
        found = df.where(condition).orderBy(*order, key).select(key).limit(len(rules))
        one = found.select(F.lit(n).alias("n"), F.lit(name).alias("rule"), F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("r"), key)
        parts = one if parts is None else parts.unionByName(one)
    taken: dict[str, object] = {}
    for row in sorted(parts.collect(), key=lambda r: (r["n"], r["r"])):  # at most the square of the number of rules
        if row["rule"] not in taken and row[key] not in taken.values():
            taken[row["rule"]] = row[key]
    return df.sparkSession.createDataFrame(list(taken.items()), f"rule string, {key} {df.schema[key].dataType.simpleString()}")
