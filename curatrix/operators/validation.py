"""Structural checks of labels against images and annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, scalars

NAMES = ("x_center", "y_center", "width", "height")


def line_errors(line: Column, classes: int = 4) -> Column:
    """All errors of a label line: MALFORMED ends the check; CLASS, COORDINATE and SIZE add up. Null or blank lines have none."""
    part = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    five = F.size(part) == 5
    number = [scalars.strict_double(F.try_element_at(part, F.lit(k))) for k in range(2, 6)]
    class_id = scalars.strict_int(F.try_element_at(part, F.lit(1)))
    numeric = class_id.isNotNull()
    inside = F.lit(True)
    for n in number:
        numeric, inside = numeric & n.isNotNull(), inside & n.between(0, 1)
    errors = F.array_compact(
        F.array(
            F.when(~class_id.between(0, classes - 1), "CLASS"),
            F.when(~inside, "COORDINATE"),
            F.when((number[2] <= 0) | (number[3] <= 0), "SIZE"),
        )
    )
    blank = F.coalesce(~line.rlike(r"\S"), F.lit(True))
    return F.when(blank, F.array().cast("array<string>")).when(~five | ~F.coalesce(numeric, F.lit(False)), F.array(F.lit("MALFORMED"))).otherwise(errors)


def class_of_line(line: Column, classes: int = 4) -> Column:
    """The class a line counts for: a valid class counts even if coordinates are bad, a malformed line doesn't."""
    part = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\s+")
    class_id = scalars.strict_int(F.try_element_at(part, F.lit(1)))
    return F.when(~F.array_contains(line_errors(line, classes), "MALFORMED") & class_id.between(0, classes - 1), class_id.cast("int"))


def negatives(images: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Images whose label file is there and has no line with text; a file of malformed lines only isn't negative.

    images has a row for each label file; lines those of its lines that have text.
    """
    return images.select(*keys).distinct().join(lines.select(*keys).distinct(), keys, "left_anti")


def unmatched(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, missing): images without a label and labels without an image."""
    i, l = images.select(*keys).distinct(), labels.select(*keys).distinct()
    return i.join(l, keys, "left_anti").withColumn("missing", F.lit("label")).unionByName(l.join(i, keys, "left_anti").withColumn("missing", F.lit("image")))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows) of keys that should be unique and aren't."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def positional_differences(coco: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, position, problem): annotations and label rows that don't agree, compared position by position.

    Both have keys, position, class_id and the four shares of NAMES. A problem is MISSING_LABEL, MISSING_ANNOTATION, CLASS or BOX; shares agree within
    2e-6 + 1e-5 of the annotation's.
    """
    a = coco.select(*keys, "position", F.col("class_id").alias("ca"), *(F.col(n).alias(f"a_{n}") for n in NAMES))
    b = labels.select(*keys, "position", F.col("class_id").alias("cb"), *(F.col(n).alias(f"b_{n}") for n in NAMES))
    same = F.lit(True)
    for n in NAMES:
        same = same & boxes.close(F.col(f"b_{n}"), F.col(f"a_{n}"))
    problem = F.when(F.col("cb").isNull(), "MISSING_LABEL").when(F.col("ca").isNull(), "MISSING_ANNOTATION").when(F.col("ca") != F.col("cb"), "CLASS").when(~F.coalesce(same, F.lit(False)), "BOX")
    return a.join(b, [*keys, "position"], "full").select(*keys, "position", problem.alias("problem")).where("problem IS NOT NULL")


def multiset_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_a, in_b) of key combinations that the two sides have in different numbers; none if they are equal as multisets."""
    x = a.groupBy(*keys).agg(F.count("*").alias("in_a"))
    y = b.groupBy(*keys).agg(F.count("*").alias("in_b"))
    both = x.unionByName(y, allowMissingColumns=True).groupBy(*keys).agg(F.coalesce(F.sum("in_a"), F.lit(0)).alias("in_a"), F.coalesce(F.sum("in_b"), F.lit(0)).alias("in_b"))
    return both.where("in_a <> in_b")


def assert_none(df: DataFrame, what: str) -> None:
    """An error that names the first rows, if there are any."""
    if rows := df.head(3):
        raise AssertionError(f"{what}: {[tuple(r) for r in rows]}")


def assert_counts(found: DataFrame, expected: DataFrame, keys: list[str]) -> None:
    """The gate of golden counts: every expected row is there with the same numbers, and no other."""
    columns = [*keys, *(c for c in expected.columns if c not in keys)]
    assert_none(multiset_difference(found.select(*columns), expected.select(*columns), columns), "counts differ from those expected")
