"""Weighted cosine join between two sides, and the overlaps of splits that it finds (problem 6).

Vectors are rows (id, term, weight). Terms are taken from the most to the least frequent. Of each vector, the first terms aren't listed as long
as they alone can't reach the threshold: their products with the largest weights that the terms have on the other side add up to less, or
the norm of that part does, the other vector being of length 1. The rarest term that two similar vectors share is then listed on both sides,
so lists of what remains meet term by term; exact dot products of the whole vectors decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import near
from ..stage import Stages


def _unit(rows: DataFrame) -> DataFrame:
    """Weights of a term of one vector are added; vectors are brought to length 1; those without a positive weight are left out."""
    r = rows.select("id", "term", F.col("weight").cast("double").alias("weight")).where("id IS NOT NULL AND term IS NOT NULL AND weight > 0 AND weight < double('infinity')")
    r = r.groupBy("id", "term").agg(F.sum("weight").alias("w"))
    return r.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


def _listed(side: DataFrame, terms: DataFrame, most: str, threshold: float) -> DataFrame:
    """Rows that go into the inverted lists. Terms that the other side lacks have the largest weight 0 there."""
    order = Window.partitionBy("id").orderBy(F.desc("df"), "term")
    with_terms = side.join(terms, "term")
    bounds = with_terms.withColumn("b1", F.sum(F.col("w") * F.col(most)).over(order)).withColumn("b2", F.sqrt(F.sum(F.col("w") * F.col("w")).over(order)))
    return bounds.where((F.least("b1", "b2") >= threshold - 1e-9) & (F.col(most) > 0)).select("id", "term")


def cosine_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, cosine) for every pair of a left and a right vector with a cosine of at least the threshold, which must be above 0.

    Ids, of any one type a side, name vectors; rows with nulls or weights that aren't positive and finite don't count. An empty side gives no rows.
    """
    as_array = lambda side: _unit(side).groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("v"))
    return join_vectors(as_array(left), as_array(right), threshold)


def join_vectors(left: DataFrame, right: DataFrame, threshold: float, keep: Column | None = None) -> DataFrame:
    """As cosine_join, from rows (id, v array<struct<term, w>>) of length 1, a vector each. `keep` is an exact condition on left_id and right_id that a pair has to meet besides.

    If the product of the least weights reaches the threshold, any one common term does: then no term can be left out of the lists, and what meets in
    them adds up to the whole product. Else the bounds decide what is listed, and products of whole vectors are taken of the pairs that meet.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    stages = Stages(left.sparkSession)
    vectors = [stages.write(x, "vectors") for x in (left, right)]
    keep = F.lit(True) if keep is None else keep
    sides = [x.select("id", F.inline("v")) for x in vectors]
    least = [x.agg(F.min(F.array_min(F.transform("v", lambda t: t["w"])))).first()[0] or 0.0 for x in vectors]
    if least[0] * least[1] >= threshold - 1e-9:
        lists = [x.withColumnRenamed("id", f"{name}_id").withColumnRenamed("w", f"w{k}") for k, (x, name) in enumerate(zip(sides, ("left", "right")))]
        met = lists[0].join(lists[1], "term").where(keep)
        return met.groupBy("left_id", "right_id").agg(F.sum(F.col("w0") * F.col("w1")).alias("cosine")).where(F.col("cosine") >= threshold - 1e-9)
    seen = [x.groupBy("term").agg(F.count("*").alias(f"n{k}"), F.max("w").alias(f"most{k}")) for k, x in enumerate(sides)]
    terms = seen[0].join(seen[1], "term").withColumn("df", F.col("n0") + F.col("n1"))  # a term on one side only adds nothing to any product
    lists = [_listed(sides[0], terms, "most1", threshold), _listed(sides[1], terms, "most0", threshold)]
    met = lists[0].withColumnRenamed("id", "left_id").join(lists[1].withColumnRenamed("id", "right_id"), "term").where(keep).select("left_id", "right_id").distinct()
    whole = [x.select("id", F.map_from_entries("v").alias(f"v{k}")) for k, x in enumerate(vectors)]
    both = met.join(whole[0].withColumnRenamed("id", "left_id"), "left_id").join(whole[1].withColumnRenamed("id", "right_id"), "right_id")
    product = F.aggregate(F.map_entries("v0"), F.lit(0.0), lambda total, e: total + e["value"] * F.coalesce(F.try_element_at(F.col("v1"), e["key"]), F.lit(0.0)))
    return both.select("left_id", "right_id", product.alias("cosine")).where(F.col("cosine") >= threshold - 1e-9)


def bit_vectors(prints: DataFrame, distance: int, agreeing: int) -> tuple[DataFrame, float]:
    """Vectors (id, v) of 64-bit fingerprints, each once, and the cosine that any two with at most `distance` different bits reach: their block terms, all of equal weight."""
    terms = near.block_terms("id", distance, agreeing)
    listed = ", ".join(f"named_struct('term', {t}, 'w', {len(terms) ** -0.5!r}D)" for t in terms)
    return prints.selectExpr("id", f"array({listed}) AS v"), 1.0 / len(terms)


def equal_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id) of equal values, each a vector of one term."""
    one = lambda d: d.select("id", F.array(F.struct(F.col("id").alias("term"), F.lit(1.0).alias("w"))).alias("v"))
    return join_vectors(one(left), one(right), 1.0).select("left_id", "right_id")


def near_pairs(left: DataFrame, right: DataFrame, distance: int = 4, agreeing: int | None = None) -> DataFrame:
    """(left_id, right_id) of 64-bit values, each once a side, that differ in at most `distance` bits; the exact count of bits decides."""
    agreeing = agreeing or near.best_agreeing(left.count(), right.count(), distance)
    vectors, least = bit_vectors(left, distance, agreeing)
    other, _ = bit_vectors(right, distance, agreeing)
    return join_vectors(vectors, other, least, F.bit_count(F.col("left_id").bitwiseXOR(F.col("right_id"))) <= distance).select("left_id", "right_id")


def split_overlaps(records: DataFrame, ident: str, split: str, exact: str, prints: str, train: str = "train", distance: int = 4) -> DataFrame:
    """(held_out, training, how): pairs of a record outside the training split and one in it with equal `exact` values or near `prints`.

    Each distinct value is joined once, however many records have it; then pairs of values become pairs of records. Records whose split is
    null, or whose value is, take no part in that; repeated rows count once. `how` is exact if the exact values agree, else near.
    """
    stages = Stages(records.sparkSession)
    r = records.select(F.col(ident).alias("r"), (F.col(split) == train).alias("t"), F.col(exact).alias("exact"), F.col(prints).alias("near"))
    r = stages.write(r.where("r IS NOT NULL AND t IS NOT NULL AND (exact IS NOT NULL OR near IS NOT NULL)").distinct(), "records")
    found = []
    for name, join in (("exact", equal_pairs), ("near", lambda a, b: near_pairs(a, b, distance))):
        have = r.select("r", "t", F.col(name).alias("id")).dropna()
        values = [stages.write(have.where("t" if t else "NOT t").select("id").distinct(), "values") for t in (False, True)]
        pairs = join(*values)
        held = have.where("NOT t").select(F.col("r").alias("held_out"), F.col("id").alias("left_id"))
        inside = have.where("t").select(F.col("r").alias("training"), F.col("id").alias("right_id"))
        found.append(pairs.join(held, "left_id").join(inside, "right_id").select("held_out", "training", F.lit(name).alias("how")))
    return found[0].unionByName(found[1]).groupBy("held_out", "training").agg(F.min("how").alias("how"))
