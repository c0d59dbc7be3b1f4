"""Choosing a varied subset (problem 1).

The value of a subset is the sum, over features, of the square root of the mass that its records have of the feature, so each further record of a feature adds
less. Thresholds descend; in a round, records are added whose marginal gain exceeds the threshold. Records with equal features are exchangeable: a round
decides how many to take of each such class, and at the end the records with the least hashes of each class are taken.

In a round each class draws a level, one half of the classes 0, a quarter 1, and so on. It adds as many records as gain enough even if all classes of its own and of higher
levels added before it all that they might. So of classes that share a feature which bears only few more, the one on the highest level goes first, while a feature
that many records hardly change holds nobody back; the classes that go together double from level to level. What a class needs to know of the others is, for each of
its features, one sum a level, combined before the shuffle. Nothing but a threshold and counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stages

BUCKETS = 4096
LEVELS = 40


def most_added(base: np.ndarray, mass: np.ndarray, starts: np.ndarray, limit: np.ndarray, threshold: float) -> np.ndarray:
    """For each class, how many records can follow each other while the last one's gain is at least the threshold.

    base and mass hold the features of all classes one class after the other, from `starts` on.
    """
    counts = np.diff(np.append(starts, len(base)))

    def gain(n: np.ndarray) -> np.ndarray:
        each = np.repeat(n, counts)
        return np.add.reduceat(np.sqrt(base + each * mass) - np.sqrt(base + np.maximum(each - 1, 0) * mass), starts)

    low, high = np.zeros(len(limit)), limit.astype(np.float64)
    while (low < high).any():
        mid = np.ceil((low + high) / 2)
        enough = gain(mid) >= threshold - 1e-12
        low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
    return low.astype(np.int64)


FEATURES = "array<struct<feature:string,mass:double>>"
STATE = f"cls string, n long, taken long, features {FEATURES}, base array<double>, could long"


def _flat(b: pa.RecordBatch, column: str) -> np.ndarray:
    return b.column(column).flatten().to_numpy(zero_copy_only=False)


def _starts(b: pa.RecordBatch) -> np.ndarray:
    offsets = b.column("features").offsets.to_numpy()[: len(b)].astype(np.int64)
    return offsets - offsets[0]


def _masses(b: pa.RecordBatch) -> np.ndarray:
    return b.column("features").flatten().field("mass").to_numpy(zero_copy_only=False)


def _left(b: pa.RecordBatch) -> np.ndarray:
    return b.column("n").to_numpy() - b.column("taken").to_numpy()


def _might(threshold: float):
    """Rows of STATE with `could`: how many records each class could add, the others adding none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                could = most_added(_flat(b, "base"), _masses(b), _starts(b), _left(b), threshold)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(could)], names=b.schema.names)

    return run


def _add(threshold: float, least: float):
    """Rows of STATE, with base and `others`, what others might add before, to rows of STATE with add, how many were added, and best, the gain of one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            base, mass, starts = _flat(b, "base"), _masses(b), _starts(b)
            add = most_added(base + _flat(b, "others"), mass, starts, b.column("could").to_numpy(), least)
            left = _left(b) - add
            counts = np.diff(np.append(starts, len(base)))
            after = base + np.repeat(add, counts) * mass
            could = most_added(after, mass, starts, left, threshold)
            best = np.where(left > 0, np.add.reduceat(np.sqrt(after + mass) - np.sqrt(after), starts), 0.0)
            bases = pa.ListArray.from_arrays(pa.array(np.append(starts, len(base)), pa.int32()), pa.array(after))
            taken = b.column("taken").to_numpy() + add
            columns = {"cls": b.column("cls"), "n": b.column("n"), "taken": pa.array(taken), "features": b.column("features"), "base": bases}
            columns |= {"could": pa.array(could), "add": pa.array(add), "best": pa.array(best)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


_PARTS = """
SELECT cls, n, taken, could, level, k, f.feature, f.mass
FROM (SELECT *, CAST(floor(-log2((pmod(xxhash64(cls, CAST(%d AS INT)), 1L << %d) + 1) / CAST(1L << %d AS DOUBLE))) AS INT) AS level FROM {might}) LATERAL VIEW posexplode(features) AS k, f"""
_SUMS = """
SELECT feature, sum(base) AS base, collect_list(struct(level, may)) AS levels
FROM (SELECT feature, level, sum(taken * mass) AS base, sum(could * mass) AS may FROM {parts} GROUP BY feature, level) GROUP BY feature"""  # a row a level
_ROWS = """
SELECT cls, n, taken, transform(b, x -> struct(x.feature AS feature, x.mass AS mass)) AS features, transform(b, x -> x.base) AS base, transform(b, x -> x.others) AS others, could FROM (
  SELECT cls, n, taken, could, array_sort(collect_list(struct(k, feature, mass, base,
    greatest(0D, aggregate(filter(levels, x -> x.level >= level), 0D, (t, x) -> t + x.may) - could * mass) AS others))) AS b
  FROM (SELECT /*+ MERGE(s) */ p.*, s.base, s.levels FROM {parts} p JOIN {sums} s ON p.feature = s.feature) GROUP BY cls, n, taken, could)"""


def _round(state: DataFrame, threshold: float, epsilon: float, seed: int) -> DataFrame:
    """The state after a round. The base kept with a class may lack what others added in the round before; then it only seems to gain more than it does."""
    spark = state.sparkSession
    parts = spark.sql(_PARTS % (seed, LEVELS, LEVELS), might=state.mapInArrow(_might(threshold), STATE))
    rows = spark.sql(_ROWS, parts=parts, sums=spark.sql(_SUMS, parts=parts))
    return rows.mapInArrow(_add(threshold, threshold * (1 - epsilon)), STATE + ", add long, best double")


def _first_of_all(add: DataFrame, wanted: int) -> DataFrame:
    """Lowers the counts so that they add up to `wanted`, in the order of the classes' hashes; sums by bucket keep any window small."""
    at = add.withColumn("bucket", F.pmod(F.xxhash64("cls"), F.lit(BUCKETS)))
    sums = at.groupBy("bucket").agg(F.sum("add").alias("s"))  # at most BUCKETS rows
    before = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("before"))
    inside = F.sum("add").over(Window.partitionBy("bucket").orderBy("cls")) - F.col("add")
    left = F.lit(wanted) - F.col("before") - F.col("inside")
    return at.withColumn("inside", inside).join(before.hint("merge"), "bucket").select("cls", F.greatest(F.lit(0), F.least("add", left)).alias("add"))


def class_counts(classes: DataFrame, size: int, epsilon: float, stages: Stages) -> tuple[DataFrame, int]:
    """(cls, taken), how many records to take of each class (cls, n, features), and the number of rounds that took."""
    blank = [F.lit(0).cast("bigint").alias("taken"), F.col("features").cast(FEATURES).alias("features"), F.transform("features", lambda f: F.lit(0.0)).alias("base"), F.lit(0).cast("bigint").alias("could")]
    state = stages.write(classes.select("cls", "n", *blank), "state")
    gain = F.aggregate("features", F.lit(0.0), lambda g, f: g + F.sqrt(f["mass"]))
    all_, threshold = state.agg(F.sum("n"), F.max(gain)).first()
    if size >= (all_ or 0):
        return state.select("cls", F.col("n").alias("taken")), 0
    chosen = rounds = 0
    while chosen < size:
        rounds += 1
        after = stages.write(_round(state, threshold, epsilon, rounds), "state")
        got, could, best = after.agg(F.sum("add"), F.sum("could"), F.max("best")).first()
        if chosen + got > size:
            clipped = _first_of_all(after.select("cls", "add"), size - chosen).withColumnRenamed("add", "fit")
            clipped = stages.write(after.join(clipped.hint("merge"), "cls").withColumn("taken", F.col("taken") - F.col("add") + F.col("fit")).drop("fit"), "state")
            stages.drop(after)
            after, got = clipped, size - chosen
        stages.drop(state)
        state, chosen = after.drop("add", "best"), chosen + got
        stages.keep(after, state)
        if not could:
            threshold = min(threshold * (1 - epsilon), best)
    return state.where("taken > 0").select("cls", "taken"), rounds


def varied_subset(records: DataFrame, ident: str, features: str, size: int, epsilon: float = 0.2, seed: int = 9) -> DataFrame:
    """(ident): a subset of `size` records, or all if there are fewer.

    `features` is an array of struct<feature string, mass double>. Masses that are null, not positive or not finite, and null features, don't count; of a feature
    that a record has more than once the largest mass does; records without any feature come in no subset, nor do null ids; rows that agree in id and features count once. Ties go by hash of id with the seed, so the result is the same in every run.
    """
    stages = Stages(records.sparkSession)
    proper = F.filter(features, lambda f: f["feature"].isNotNull() & (f["mass"] > 0) & (f["mass"] < float("inf")))  # NaN is above infinity
    names = F.array_sort(F.array_distinct(F.transform("known", lambda f: f["feature"])))
    most = lambda name: F.array_max(F.transform(F.filter("known", lambda f: f["feature"] == name), lambda f: f["mass"]))
    once = F.transform(names, lambda name: F.struct(name.alias("feature"), most(name).cast("double").alias("mass")))
    src = records.select(F.col(ident).alias("id"), proper.alias("known")).where("id IS NOT NULL AND size(known) > 0").select("id", once.alias("features"))
    rows = stages.write(src.select("id", "features", F.to_json("features").alias("cls")).distinct(), "records")
    classes = stages.write(rows.groupBy("cls").agg(F.count("*").alias("n"), F.any_value("features").alias("features")), "classes")
    counts, _ = class_counts(classes, size, epsilon, stages)
    taken = stages.write(counts, "taken")
    stages.drop(classes)
    # the records of a class by buckets of their hash: whole buckets are taken, and part of one
    hashed = rows.select("id", "cls", F.xxhash64("id", F.lit(seed)).alias("h")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
    sums = hashed.groupBy("cls", "bucket").agg(F.count("*").alias("c")).join(taken.hint("merge"), "cls")
    before = F.sum("c").over(Window.partitionBy("cls").orderBy("bucket")) - F.col("c")
    parts = sums.withColumn("take", F.col("taken") - before).where("take > 0").select("cls", "bucket", "c", "take")
    near = hashed.join(parts, ["cls", "bucket"])
    whole = near.where("take >= c").select("id")
    part = near.where("take < c").withColumn("k", F.row_number().over(Window.partitionBy("cls", "bucket").orderBy("h", "id"))).where("k <= take").select("id")
    return whole.unionByName(part).select(F.col("id").alias(ident))
