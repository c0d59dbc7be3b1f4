"""Reviewed pairs: differences, groups, cleanup proposals and removal reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..stage import Stages
from . import contraction, preparation


def difference(items_a: Column, items_b: Column) -> Column:
    """CLASS_OR_COUNT if the two signatures differ in classes or number, BOX_GEOMETRY if in boxes, else MATCH."""
    classes = lambda items: F.array_sort(F.transform(items, lambda i: i["class"]))
    return F.when(~classes(items_a).eqNullSafe(classes(items_b)), "CLASS_OR_COUNT").when(~items_a.eqNullSafe(items_b), "BOX_GEOMETRY").otherwise("MATCH")


def in_id_range(pair_id: Column, first: int, last: int) -> Column:
    """Is the number after the letter in the range? Ids of another form are not."""
    return F.coalesce(F.regexp_extract(pair_id, r"^[A-Z]([0-9]+)$", 1).try_cast("bigint").between(first, last), F.lit(False))


def with_differences(pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """Pairs with the difference found for their pair_id, MATCH where none is recorded."""
    return pairs.join(differences.select("pair_id", "difference"), "pair_id", "left").withColumn("difference", F.coalesce("difference", F.lit("MATCH")))


def mismatched_metadata(reviewed: DataFrame, metadata: DataFrame, sides: list[str]) -> DataFrame:
    """Reviewed pairs that the metadata lacks or describes otherwise."""
    m = metadata.select("pair_id", *(F.col(c).alias(f"m_{c}") for c in sides), F.lit(True).alias("known"))
    same = F.lit(True)
    for c in sides:
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    return reviewed.join(m, "pair_id", "left").where(F.col("known").isNull() | ~same).select(*reviewed.columns)


def connected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the least node that a chain of pairs leads to.

    In each step every node moves into the one of least hash among itself and its neighbours; steps go on over the links between those, so links and nodes
    grow fewer by a factor a step. What a node needs to know of its neighbours is a minimum, combined before the shuffle.
    """
    stages = Stages(pairs.sparkSession)
    first = links = stages.write(contraction.clean_pairs(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")), "x", "y"), "links")
    levels: list[tuple[DataFrame, int]] = []
    while not links.isEmpty():
        seed = len(levels)
        least = contraction.both_ways(links).groupBy("src").agg(F.expr(f"min(struct(xxhash64(dst, {seed}) AS h, dst AS node))").alias("m"))
        moved = least.where(f"m < struct(xxhash64(src, {seed}) AS h, src AS node)").selectExpr("src AS node", "m.node AS center")
        moved = stages.write(moved, "moved")
        levels.append((moved, moved.count()))
        inner = stages.write(contraction.contract(links, *levels[-1]), "links")
        if links is not first:
            stages.drop(links)
        links = inner
    return contraction.roots(first, levels, stages)


# fixed values: the reasons of a removal, the first that applies coming first
REMOVAL_REASONS = ("STRICT_N1_BLACKHEAD_WHITEHEAD_NEGATIVE", "CONFIRMED_CROSS_SPLIT_B_VARIANT", "VAL_TEST_LEAKAGE_S1_REMOVE_VAL")


def group_table(members: DataFrame, root: str, split: str) -> DataFrame:
    """(root, num_files, has_train, has_val, has_test, splits, status); a group with val and test is held for review."""
    g = members.groupBy(root).agg(F.count("*").alias("num_files"), *(F.coalesce(F.bool_or(F.col(split) == s), F.lit(False)).alias(f"has_{s}") for s in ("train", "val", "test")))
    splits = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"has_{s}"), s) for s in ("train", "val", "test")))), ";")
    held = F.col("has_val") & F.col("has_test")
    return g.withColumn("splits", splits).withColumn("status", F.when(held, "HOLD_VAL_TEST_REVIEW").otherwise("PROPOSE_TRAIN_EXCLUSION_ONLY"))


def cleanup(members: DataFrame, groups: DataFrame, root: str, split: str) -> DataFrame:
    """Members with the proposed action. A training member of a group with val or test is proposed for exclusion, held or not."""
    joined = members.join(groups.select(root, "has_val", "has_test", "status"), root)
    train = (F.col(split) == "train") & (F.col("has_val") | F.col("has_test"))
    action = F.when(train, "PROPOSE_EXCLUDE_FROM_TRAIN").when(F.col("status") == "HOLD_VAL_TEST_REVIEW", "RETAIN_UNCHANGED_PENDING_VAL_TEST_REVIEW").otherwise("RETAIN_HELD_OUT_UNCHANGED")
    return joined.withColumn("action", action).drop("has_val", "has_test", "status")


def removals(members: DataFrame, groups: DataFrame, strict: DataFrame, root: str, key: str, split: str) -> DataFrame:
    """(key, reason) of what a derived version leaves out: strict negatives of train, training members of groups that reach val or test, and val members of groups
    that hold both."""
    joined = members.join(groups.select(root, "has_val", "has_test"), root)
    strict_first, crossing, leaking = REMOVAL_REASONS
    reason = F.when((F.col(split) == "train") & (F.col("has_val") | F.col("has_test")), crossing).when((F.col(split) == "val") & F.col("has_test"), leaking)
    linked = joined.select(key, reason.alias("reason")).where("reason IS NOT NULL")
    both = strict.select(key, F.lit(strict_first).alias("reason")).unionByName(linked)
    first = F.min(F.array_position(F.array(*map(F.lit, REMOVAL_REASONS)), F.col("reason")).cast("int"))
    return both.groupBy(key).agg(F.element_at(F.array(*map(F.lit, REMOVAL_REASONS)), first).alias("reason"))


def retained_counterparts(members: DataFrame, removed: DataFrame, root: str, key: str, split: str) -> DataFrame:
    """(root, key, role): of each group that loses members, those removed, REMOVED, and the held-out ones that stay, COUNTERPART.

    The counterparts of a removed member are those of its root. So the rows are as many as the members, not as the pairs of a member removed and one that stays.
    """
    gone = removed.select(key, F.lit(True).alias("gone")).distinct()
    told = members.join(gone, key, "left").withColumn("role", F.when(F.col("gone"), "REMOVED").when(F.col(split).isin("val", "test"), "COUNTERPART"))
    losing = told.where("role = 'REMOVED'").select(root).distinct()
    return told.where("role IS NOT NULL").join(losing, root, "left_semi").select(root, key, "role")


def split_sets(groups: DataFrame) -> DataFrame:
    """(splits, groups, files): how many groups, and files in them, have members in exactly these splits."""
    return groups.groupBy("splits").agg(F.count("*").alias("groups"), F.sum("num_files").cast("bigint").alias("files"))


def boxes_of_outliers(outliers: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """Outlier rows with the annotation that has the same keys; of several, the first by its position. An outlier without one has nulls."""
    first = annotations.groupBy(*keys).agg(F.min(F.struct("position", *(c for c in annotations.columns if c not in (*keys, "position")))).alias("_a"))
    return outliers.join(first, keys, "left").select(*outliers.columns, "_a.*")


def displayed_boxes(annotations: DataFrame, selected: DataFrame, image: list[str], ident: str) -> DataFrame:
    """All annotations of the images that have a selected one, each with `selected_outlier`."""
    marks = selected.select(*image, ident).distinct().withColumn("selected_outlier", F.lit(True))
    shown = annotations.join(selected.select(*image).distinct(), image, "left_semi")
    return shown.join(marks, [*image, ident], "left").withColumn("selected_outlier", F.coalesce("selected_outlier", F.lit(False)))


def torn_pairs(pairs: DataFrame, members: DataFrame, a: str, b: str, key: str, root: str) -> DataFrame:
    """Pairs whose two ends aren't in one group."""
    m = lambda side: members.select(F.col(key).alias(side), F.col(root).alias(f"r_{side}"))
    return pairs.join(m(a), a, "left").join(m(b), b, "left").where(~F.coalesce(F.col(f"r_{a}") == F.col(f"r_{b}"), F.lit(False))).select(*pairs.columns)


def repeated_nodes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, pairs) of nodes that stand in more than one pair."""
    return pairs.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("pairs")).where("pairs > 1")


def group_numbers(roots: DataFrame, root: str, order: str, prefix: str = "G") -> DataFrame:
    """(root, group_id): groups numbered by the least value of `order`, which decides the numbers: by least node or by least pair they differ."""
    first = roots.groupBy(root).agg(F.min(order).alias("first"))
    counted = preparation.numbered(first.withColumn("one", F.lit(1)), "one", ["first", root])
    return counted.select(root, names.numbered(prefix, F.col("number")).alias("group_id"))


def object_map(objects: DataFrame, keys: list[str], class_name: str) -> DataFrame:
    """(keys, objects map<string, int>): objects by class of each file."""
    n = objects.groupBy(*keys, class_name).agg(F.count("*").cast("int").alias("n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(class_name, "n")))).alias("objects"))


def ranked_pairs(pairs: DataFrame, order: list[str], prefix: str = "D") -> DataFrame:
    """Pairs with an ordinal id in the given order."""
    return preparation.numbered(pairs.withColumn("_one", F.lit(1)), "_one", order).withColumn("ordinal", names.numbered(prefix, F.col("number"))).drop("_one", "number")
