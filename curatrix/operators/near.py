"""Near duplicates by fingerprint and thumbnail, and boxes of one image that overlap."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, scalars
from ..stage import Stages


def block_terms(column: str, distance: int, agreeing: int, bits: int = 64) -> list[str]:
    """SQL of bigint terms of a fingerprint, of which two with at most `distance` different bits share at least one.

    The bits are cut into distance + agreeing blocks; each choice of `agreeing` blocks with its bits is a term. Of two such fingerprints at least `agreeing` blocks are
    equal. More agreeing blocks make terms longer and more: with 4 bits, 5 terms of 12 or 13 bits, 15 of 20 to 22, 35 of 27 to 28.
    """
    parts = distance + agreeing
    edges = [round(bits * k / parts) for k in range(parts + 1)]
    block = [f"(shiftrightunsigned({column}, {lo}) & {(1 << (hi - lo)) - 1}L)" for lo, hi in zip(edges, edges[1:])]
    out = []
    for number, chosen in enumerate(combinations(range(parts), agreeing)):
        value = f"{number}L"
        for k in chosen:
            value = f"(shiftleft({value}, {edges[k + 1] - edges[k]}) | {block[k]})"
        out.append(value)
    return out


def best_agreeing(left: int, right: int, distance: int, bits: int = 64) -> int:
    """How many blocks a term should have for so many fingerprints: what is listed, each some eight times as costly, and what meets by chance add up to the least."""

    def cost(agreeing: int) -> float:
        return comb(distance + agreeing, agreeing) * (8.0 * (left + right) + left * right * 2.0 ** (-bits * agreeing / (distance + agreeing)))

    return min(range(1, 6), key=cost)


def print_pairs(df: DataFrame, print_: str, distance: int = 4, agreeing: int | None = None) -> DataFrame:
    """(p, q, hamming), p < q: distinct fingerprints that differ in 1 to `distance` bits. Equal ones are one row before they meet.

    They meet by block terms, which grow longer as the fingerprints grow more, so chance meetings don't grow with their square. The lists are merged, as
    Spark takes them for no larger than the fingerprints, though they have 5 rows of each or more, and would broadcast them. Both sides are one shuffle.
    """
    each = Stages(df.sparkSession).write(df.where(F.col(print_).isNotNull()).select(F.col(print_).alias("p")).distinct(), "prints")
    if not agreeing:
        n = each.count()
        agreeing = best_agreeing(n, n, distance)
    listed = each.selectExpr("p", f"explode(array({', '.join(block_terms('p', distance, agreeing))})) AS term")
    x, y = listed.hint("merge").alias("x"), listed.alias("y")
    met = x.join(y, "term").select(F.col("x.p").alias("p"), F.col("y.p").alias("q")).where((F.col("p") < F.col("q")) & (scalars.hamming(F.col("p"), F.col("q")) <= distance))
    return met.distinct().withColumn("hamming", scalars.hamming(F.col("p"), F.col("q")))


def near_duplicates(df: DataFrame, key: str, print_: str, thumb: str | None = None, distance: int = 4, most_rmse: float = 0.08) -> DataFrame:
    """(a, b, hamming[, rmse]), a < b: links between records whose fingerprints differ in at most `distance` bits and, if thumbnails are given, whose thumbnails
    differ by at most `most_rmse`; both limits inclusive.

    Records with the same fingerprint, and thumbnail, are a class, in which each is linked to the least key; classes are linked by their least keys. So no link
    between different records is lost, and copies, however many, aren't paired with each other. Null fingerprints have no links; repeated rows count once.
    """
    what = [print_] + ([thumb] if thumb else [])
    rows = df.select(key, *what).where(F.col(print_).isNotNull())
    heads = rows.groupBy(*what).agg(F.min(key).alias("head"))
    match = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in what]
    copies = rows.alias("r").join(heads.alias("h"), match).select(F.col("head").alias("a"), F.col(f"r.{key}").alias("b"), F.lit(0).alias("hamming"), *([F.lit(0.0).alias("rmse")] if thumb else [])).where("a < b").distinct()
    side = lambda p, name: heads.select(F.col("head").alias(name), F.col(print_).alias(p), *([F.col(thumb).alias(f"t_{name}")] if thumb else []))
    near = print_pairs(rows, print_, distance).join(side("p", "x"), "p").join(side("q", "y"), "q")
    if thumb:
        same = side("p", "x").join(side("p", "y"), "p").where("x < y").withColumn("q", F.col("p")).withColumn("hamming", F.lit(0))  # other thumbnails of one fingerprint
        near = near.unionByName(same).withColumn("rmse", scalars.rmse(F.col("t_x"), F.col("t_y"))).where(F.col("rmse") <= most_rmse)
    return copies.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "hamming", *(["rmse"] if thumb else [])))


def all_pairs(df: DataFrame, key: str, print_: str, distance: int, block: int = 2048) -> DataFrame:
    """(a, b, hamming), a < b: all pairs of records within `distance` bits, by comparing each with each, for limits beyond what bands can tell apart.

    Records fall into groups of about `block` by the hash of their key. Two groups, or a group and itself, meet in one cell, so a pair meets once; a cell is
    bounded, whatever the fingerprints are. The work grows with the square of the records. Null fingerprints have no pairs; repeated rows count once.
    """
    rows = df.where(F.col(print_).isNotNull()).select(F.col(key).alias("k"), F.col(print_).alias("p")).distinct()
    groups = max(1, -(-rows.count() // block))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int"))
    left = rows.select(F.col("g").alias("i"), F.explode(F.sequence("g", F.lit(groups - 1))).alias("j"), F.col("k").alias("x"), "p")
    right = rows.select(F.explode(F.sequence(F.lit(0), "g")).alias("i"), F.col("g").alias("j"), F.col("k").alias("y"), F.col("p").alias("q"))
    once = (F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))
    bits = scalars.hamming(F.col("p"), F.col("q"))
    return left.join(right, ["i", "j"]).where(once & (bits <= distance)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), bits.alias("hamming"))


def search(df: DataFrame, queries: DataFrame, key: str, print_: str, distance: int, block: int = 4096) -> DataFrame:
    """(query, key, hamming): for each record of a stated query set, all other records within `distance` bits, by comparing with each, for limits beyond what bands can tell apart.

    The query set goes in blocks of at most `block` records, each sent to the executors whole; a block costs one pass over the records.
    """
    rows = df.where(F.col(print_).isNotNull()).select(F.col(key).alias("key"), F.col(print_).alias("q"))
    asked = queries.where(F.col(print_).isNotNull()).select(F.col(key).alias("query"), F.col(print_).alias("p")).distinct()
    blocks = max(1, -(-asked.count() * 2 // block))  # twice as many as needed, as hashes fill them unevenly
    numbered = asked.withColumn("n", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    out = None
    for n in range(blocks):
        one = F.broadcast(numbered.where(F.col("n") == n).drop("n"))
        met = rows.join(one, (scalars.hamming(F.col("p"), F.col("q")) <= distance) & (F.col("query") != F.col("key")))
        met = met.select("query", "key", scalars.hamming(F.col("p"), F.col("q")).alias("hamming"))
        out = met if out is None else out.unionByName(met)
    return out


def overlapping(df: DataFrame, image: list[str], ident: str, corners: list[str], least: float = 0.8) -> DataFrame:
    """(image, a, b, iou), a < b: boxes of one image with an overlap of at least `least`.

    The sides of such boxes are within a factor of `least`, and their centers no further apart than 1 - `least` of the larger side. So they meet by
    cells: powers of two of the sides, and places of the centers in units of them. A crowded image is spread over its cells.
    """
    lo, hi = least * 0.999, 1 / (least * 0.999)
    log2 = lambda v: F.floor(F.log2(v)).cast("int")
    through = lambda a, b: F.explode(F.sequence(a, b))
    unit = lambda e: F.pow(F.lit(2.0), F.col(e) + 1) * hi  # noqa: E731  # above the larger side
    rows = df.select(*image, F.col(ident).alias("i"), *(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(corners))).where("c2 > c0 AND c3 > c1")
    rows = rows.withColumns({"w": F.col("c2") - F.col("c0"), "h": F.col("c3") - F.col("c1"), "x": (F.col("c0") + F.col("c2")) / 2, "y": (F.col("c1") + F.col("c3")) / 2})
    left = rows.withColumns({"ew": log2(F.col("w")), "eh": log2(F.col("h"))})
    left = left.withColumns({"gx": F.floor(F.col("x") / unit("ew")), "gy": F.floor(F.col("y") / unit("eh"))}).drop("w", "h", "x", "y")
    right = rows.select(*image, F.col("i").alias("j"), *(F.col(f"c{k}").alias(f"d{k}") for k in range(4)), "w", "h", "x", "y")
    right = right.withColumn("ew", through(log2(F.col("w") * lo), log2(F.col("w") * hi))).withColumn("eh", through(log2(F.col("h") * lo), log2(F.col("h") * hi)))
    for place, at, e in (("gx", "x", "ew"), ("gy", "y", "eh")):
        margin = unit(e) * (1 - lo)
        right = right.withColumn(place, through(F.floor((F.col(at) - margin) / unit(e)), F.floor((F.col(at) + margin) / unit(e))))
    share = boxes.iou([F.col(f"c{k}") for k in range(4)], [F.col(f"d{k}") for k in range(4)])
    met = left.join(right.drop("w", "h", "x", "y"), [*image, "ew", "eh", "gx", "gy"]).where(F.col("i") < F.col("j")).withColumn("iou", share).where(F.col("iou") >= least)
    return met.select(*image, F.col("i").alias("a"), F.col("j").alias("b"), "iou")  # the left box is in one cell, so a pair meets once


def unordered(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b)).drop(a, b).withColumnRenamed("_a", a).withColumnRenamed("_b", b)


def not_in_baseline(pairs: DataFrame, baseline: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that the baseline doesn't have in either order."""
    return unordered(pairs, a, b).join(unordered(baseline.select(a, b), a, b).distinct(), [a, b], "left_anti")


def members(df: DataFrame, key: str, print_: str) -> DataFrame:
    """(head, key): the records of each class of equal fingerprints, with the least key of the class."""
    rows = df.select(key, print_).where(F.col(print_).isNotNull()).distinct()
    return rows.join(rows.groupBy(print_).agg(F.min(key).alias("head")), print_).select("head", key)


def unjudged(df: DataFrame, key: str, print_: str, baseline: DataFrame, a: str, b: str, distance: int = 4) -> DataFrame:
    """(a, b, hamming, pairs, judged): classes of equal fingerprints, by their heads, near each other and with pairs of records that the baseline doesn't have in either order.

    pairs is how many pairs of records there are between the two classes, or within one, where a = b; judged is how many of them the baseline has. A pair of
    classes whose pairs are all judged is left out. Which pairs aren't judged follows from `members`, so copies, however many, aren't paired with each other
    here. A key has one fingerprint; repeated rows count once.
    """
    rows = df.select(key, print_).where(F.col(print_).isNotNull()).distinct()
    classes = rows.groupBy(F.col(print_).alias("p")).agg(F.min(key).alias("head"), F.count("*").alias("n"))
    within = classes.where("n > 1").select(F.col("head").alias("a"), F.col("head").alias("b"), F.lit(0).alias("hamming"), F.expr("n * (n - 1) div 2").alias("pairs"))
    side = lambda p, k: classes.select(F.col("p").alias(p), F.col("head").alias(f"h{k}"), F.col("n").alias(f"n{k}"))
    between = print_pairs(rows, print_, distance).join(side("p", 1), "p").join(side("q", 2), "q")
    between = between.select(F.least("h1", "h2").alias("a"), F.greatest("h1", "h2").alias("b"), "hamming", (F.col("n1") * F.col("n2")).alias("pairs"))
    known = unordered(baseline.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y"), "x", "y").distinct()
    for k in ("x", "y"):
        known = known.join(members(df, key, print_).select(F.col(key).alias(k), F.col("head").alias(f"h_{k}")), k)
    judged = known.groupBy(F.least("h_x", "h_y").alias("a"), F.greatest("h_x", "h_y").alias("b")).agg(F.count("*").alias("judged"))
    return within.unionByName(between).join(judged, ["a", "b"], "left").fillna(0, ["judged"]).where("judged < pairs")
