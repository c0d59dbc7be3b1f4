"""Links contracted level by level: what groupings of linked records share.

A level moves some vertices into others. Links then join what the vertices moved into; links within one vertex vanish. The moves of all levels, one after the other,
tell where each vertex ends up. Only vertices that move are kept, and joined: by broadcast while they are few, else by sorting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..stage import Stages

BROADCAST_ROWS = 200_000  # of two keys each: some tens of megabytes


def small(df: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast if there are no more rows than a bound, else joined by sorting, where adaptive execution splits a hot key."""
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


def clean_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b), a < b, each once; pairs with a null or of a vertex with itself link nothing."""
    return pairs.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").selectExpr(f"least({a}, {b}) AS a", f"greatest({a}, {b}) AS b").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("inline(array(struct(a AS src, b AS dst), struct(b AS src, a AS dst)))")


def contract(links: DataFrame, moved: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) between what the vertices moved into, by moved (node, center)."""
    for end in ("a", "b"):
        links = links.join(small(moved.selectExpr(f"node AS {end}", f"center AS to_{end}"), rows), end, "left")
    return clean_pairs(links.selectExpr("coalesce(to_a, a) AS x", "coalesce(to_b, b) AS y"), "x", "y")


def roots(links: DataFrame, levels: list[tuple[DataFrame, int]], stages: Stages) -> DataFrame:
    """(node, root) for the vertices of the first links: root is the least of those that end up in one vertex."""
    ends, rows = (levels[-1][0], levels[-1][1]) if levels else (None, 0)
    for moved, n in reversed(levels[:-1]):
        up = small(ends.selectExpr("node AS center", "center AS higher"), rows)
        both = moved.join(up, "center", "left").selectExpr("node", "coalesce(higher, center) AS center").unionByName(ends.join(small(moved.select("node"), n), "node", "left_anti"))
        after = stages.write(both, "ends")
        stages.drop(ends, moved)
        ends, rows = after, after.count()
    nodes = links.selectExpr("explode(array(a, b)) AS node").distinct()
    if ends is None:
        return nodes.selectExpr("node", "node AS root")
    placed = stages.write(nodes.join(small(ends, rows), "node", "left").selectExpr("node", "coalesce(center, node) AS center"), "placed")
    return placed.join(placed.groupBy("center").agg({"node": "min"}).withColumnRenamed("min(node)", "root"), "center").select("node", "root")
