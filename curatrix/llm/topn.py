"""Top N items within every group (problem 7).

No group is ever sorted or gathered. Each group has bounds between which its N-th item lies, on a code of score, then identifier. A pass
divides the bounds of all groups at once at evenly spaced points, counts the rows above each, and keeps the part that holds the N-th item,
tightened to the codes that occur there. A group ends once the rows at and above its lower bound are exactly N.

Groups that hold more than a 1024th of all rows, of which there can be no more than 1024, meet their bounds by broadcast, and their counts
are added up before any shuffle. All others are shuffled by group once; passes then run on that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stages

HOT_GROUPS = 1024
LEAST_HOT = 50_000


def _slot(ways: int) -> Column:
    """Part of the bounds in which a code lies; by score while the bounds' scores differ, else by identifier. Never decreasing in the code."""
    wide = F.greatest(F.abs("lo_s"), F.abs("hi_s")) > 1e300  # else the width could overflow
    unit = F.when(wide, 0.25).otherwise(1.0)
    by_score = F.try_divide(F.col("s") * unit - F.col("lo_s") * unit, F.col("hi_s") * unit - F.col("lo_s") * unit) * ways
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    by_id = (exact("i") - exact("lo_i")) * F.lit(ways).cast("decimal(3,0)") / (exact("hi_i") - exact("lo_i"))
    return F.least(F.lit(ways - 1), F.floor(F.when(F.col("lo_s") < F.col("hi_s"), by_score).otherwise(by_id.cast("double"))).cast("int"))


def _bounds() -> list[Column]:
    return [F.count("*").alias("c"), F.min("s").alias("lo_s"), F.max("s").alias("hi_s"), F.min("i").alias("lo_i"), F.max("i").alias("hi_i")]


def _cutoffs(rows: DataFrame, keys: list[str], n: int, ways: int, hot: bool, held: list[DataFrame]) -> DataFrame:
    """Lower bounds of the groups that hold more than n rows. What is cached on the way is added to `held`."""
    hint = F.broadcast if hot else lambda d: d.hint("shuffle_hash")
    state = rows.groupBy(*keys).agg(*_bounds()).where(F.col("c") > n).withColumn("need", F.lit(n).cast("bigint")).persist()
    held.append(state)
    downward = Window.partitionBy(*keys).orderBy(F.desc("slot"))
    ended: list[DataFrame] = []
    while True:
        still = state.where("c > need")
        ended.append(state.where("c = need").select(*keys, "lo_s", "lo_i"))
        if still.isEmpty():
            break
        near = rows.join(hint(still.drop("c")), keys).where("s BETWEEN lo_s AND hi_s AND i BETWEEN lo_i AND hi_i")
        parts = near.withColumn("slot", _slot(ways)).groupBy(*keys, "need", "slot").agg(*_bounds())
        state = (
            parts.withColumn("above", F.sum("c").over(downward) - F.col("c"))
            .where("above < need AND above + c >= need")
            .withColumn("need", F.col("need") - F.col("above"))
            .select(*keys, "c", "lo_s", "hi_s", "lo_i", "hi_i", "need")
            .persist()
        )
        held.append(state)
    out = ended[0]
    for more in ended[1:]:
        out = out.unionByName(more)
    return out


def top_n(df: DataFrame, keys: list[str], score: str, ident: str, n: int, ways: int = 8) -> DataFrame:
    """(keys, ident, score, rank_no): the n rows of each group with the highest score, equal scores by lower identifier.

    Rows that agree in keys, score and identifier count once. Rows with a null key, and scores that are null, NaN or infinite, don't count.
    The identifier is an integer; a null one comes last among equal scores. n below 1 gives no rows. Other columns aren't read.
    """
    spark = df.sparkSession
    stages = Stages(spark)
    g = [f"g{k}" for k in range(len(keys))]
    known = F.abs(F.col(score).cast("double")) < float("inf")
    code = F.coalesce(F.bitwise_not(F.col(ident).cast("bigint")), F.lit(-(2**63)))
    src = df.select(*(F.col(k).alias(a) for k, a in zip(keys, g)), F.col(score).cast("double").alias("s"), code.alias("i"), known.alias("known"))
    src = src.where(F.col("known") & ~F.isnan("s")).drop("known").dropna(subset=g)
    if n < 1:
        src = src.limit(0)
    many = max(LEAST_HOT, df.count() // HOT_GROUPS)
    hot = F.broadcast(stages.write(src.groupBy(*g).agg(F.count("*").alias("c")).where(F.col("c") > many).select(*g).coalesce(1), "hot"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold_rows = src.join(hot, g, "left_anti").repartition(width, *g).dropDuplicates([*g, "s", "i"]).persist()
    held = [cold_rows]
    hot_rows = stages.write(src.join(hot, g, "left_semi").distinct(), "hotrows")
    rank = Window.partitionBy(*g).orderBy(F.desc("s"), F.desc("i"))
    parts = []
    for rows, is_hot in ((cold_rows, False), (hot_rows, True)):
        cut = _cutoffs(rows, g, n, ways, is_hot, held)
        cut = F.broadcast(cut) if is_hot else cut.hint("shuffle_hash")
        kept = rows.join(cut, g, "left").where("lo_s IS NULL OR s > lo_s OR (s = lo_s AND i >= lo_i)")
        parts.append(kept.select(*g, "s", "i", F.row_number().over(rank).alias("rank_no")))
    ident_out = F.when(F.col("i") > -(2**63), F.bitwise_not("i")).cast(df.schema[ident].dataType).alias(ident)
    top = parts[0].unionByName(parts[1]).select(*(F.col(a).alias(k) for k, a in zip(keys, g)), "rank_no", ident_out, F.col("s").alias(score))
    found = stages.write(top, "top")
    for cached in held:
        cached.unpersist()
    stages.drop(hot_rows)
    return found
