"""Groups of linked records: by low-diameter decomposition (problem 5) and by alternating stars (problem 2).

Both take pairs (a, b) of any one sortable type and give (node, root), root being the least node of the node's component. Pairs with a null or
with a = b link nothing; a pair may recur or stand in either order. Only nodes with a link come out; no pairs, no rows.

Vertices and links stay in tables. What a step needs of a vertex's neighbours it gets as an aggregate that is combined before the shuffle,
so a vertex with a third of all links costs no more than others there; in the joins that follow, adaptive execution splits its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contraction import both_ways, clean_pairs, contract, roots, small
from ..stage import Stages


def decompose(links: DataFrame, beta: float, seed: int, stages: Stages) -> tuple[DataFrame, int]:
    """(node, center) of the vertices that a cluster of another takes in, and their number: one low-diameter decomposition of links (a, b).

    Each vertex draws a head start from the exponential distribution with rate beta, a function of the vertex and the seed. A cluster grows from its center one link a
    round, beginning at minus the head start; a vertex joins the cluster that reaches it first. Rounds end when no vertex changes its cluster, after
    as many as the widest cluster has links from its center, which with high probability is O(log n / beta). Each link joins two clusters
    with a probability of at most about beta. A round goes from the vertices that changed in the one before, meets their links only and writes only what changes.
    """
    start = lambda node: f"log((pmod(xxhash64({node}, {seed}), {1 << 52}L) + 0.5D) / {1 << 52}D) / {beta}D"
    each = both_ways(links)
    offers = each.selectExpr("dst AS node", f"struct({start('src')} + 1 AS at, src AS center) AS by")
    changes: list[DataFrame] = []
    total = 0
    while True:
        news = offers.groupBy("node").agg(F.min("by").alias("by")).where(f"by < struct({start('node')} AS at, node AS center)")
        if changes:
            known = small(stages.together(changes).selectExpr("node AS seen", "by AS known"), total)
            news = news.join(known, (F.col("node") == F.col("seen")) & (F.col("known") <= F.col("by")), "left_anti")
        fresh = stages.write(news, "reached")
        n = fresh.count()
        changes.append(fresh)
        if n == 0:
            break
        total += n
        offers = each.join(small(fresh.selectExpr("node AS src", "by"), n), "src").selectExpr("dst AS node", "struct(by.at + 1 AS at, by.center AS center) AS by")
    moved = stages.write(stages.together(changes).groupBy("node").agg(F.min("by").alias("by")).selectExpr("node", "by.center AS center"), "moved")
    stages.drop(*changes)
    return moved, moved.count()


def components(pairs: DataFrame, a: str = "a", b: str = "b", beta: float = 0.3, seed: int = 7) -> DataFrame:
    """(node, root) by low-diameter decomposition: decompose, contract clusters to vertices, recurse on the links between clusters, compose the assignments."""
    stages = Stages(pairs.sparkSession)
    first = links = stages.write(clean_pairs(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")), "x", "y"), "links")
    levels: list[tuple[DataFrame, int]] = []
    while not links.isEmpty():
        levels.append(decompose(links, beta, seed + len(levels), stages))
        inner = stages.write(contract(links, *levels[-1]), "links")
        if links is not first:
            stages.drop(links)
        links = inner
    return roots(first, levels, stages)


def star_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) by alternating large-star and small-star steps until the links no longer change."""
    stages = Stages(pairs.sparkSession)
    links = stages.write(clean_pairs(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")), "x", "y"), "links")
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state
        # large star: every neighbour above a vertex links to the least of the vertex and its neighbours
        least = both_ways(links).groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("a"), F.least("src", "m").alias("m"))
        large = clean_pairs(links.join(least.hint("merge"), "a"), "b", "m")
        # small star: every neighbour below a vertex, and the vertex, link to the least of them
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        lower = large.join(lowest.hint("merge"), "b").select("a", "m").unionByName(lowest.select(F.col("b").alias("a"), "m"))
        after = stages.write(clean_pairs(lower, "a", "m"), "links")
        stages.drop(links)
        links = after
