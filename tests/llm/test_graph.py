import random

import pytest

from curatrix.llm import graph, splits
from curatrix.operators import contraction


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in root}


def graph_rows():
    rnd = random.Random(6)
    pairs = [(f"r{rnd.randint(0, 60)}", f"r{rnd.randint(0, 60)}") for _ in range(35)]
    pairs += [(f"c{k:02}", f"c{k + 1:02}") for k in range(25)]  # a chain
    pairs += [("hub", f"s{k}") for k in range(40)]
    pairs += [(None, "x"), ("y", None), ("z", "z"), ("", "e"), pairs[0], pairs[0][::-1]]
    return pairs


@pytest.mark.parametrize("how", [graph.components, graph.star_components])
def test_components(spark, how):
    pairs = graph_rows()
    df = spark.createDataFrame([(*p, "n", "r") for p in pairs], "a string, b string, node string, root string")
    assert {r["node"]: r["root"] for r in how(df).collect()} == union_find(pairs)


def test_components_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(contraction, "BROADCAST_ROWS", -1)
    pairs = graph_rows()
    assert {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect()} == union_find(pairs)


@pytest.mark.parametrize("how", [graph.components, graph.star_components])
def test_no_pairs(spark, how):
    assert how(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_clusters_are_connected_and_cover(spark):
    from curatrix.stage import Stages

    pairs = [(k, k + 1) for k in range(40)]
    moved, n = graph.decompose(graph.clean_pairs(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b"), 0.3, 1, Stages(spark))
    rows = moved.collect()
    center = {k: k for k in range(41)} | {r["node"]: r["center"] for r in rows}
    assert set(center) == set(range(41)) and len(rows) == n > 0 and all(r["node"] != r["center"] for r in rows)
    for node, c in center.items():  # on a path, whatever lies between a node and its center belongs to it
        assert all(center[k] == c for k in range(min(node, c), max(node, c) + 1))


def test_related_records_share_a_split(spark):
    links = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("d", "3"), (None, "1"), ("e", None), ("a", "1")]
    links_df = spark.createDataFrame([(*r, "x") for r in links], "rec string, entity string, root string")
    records = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", "e", None, "a"]] + [(f"s{k}",) for k in range(400)], "rec string")
    rows = splits.assign_splits(records, "rec", links_df, "rec", "entity", {"train": 6, "val": 2, "test": 2}).collect()
    split = {r["rec"]: r["split"] for r in rows}
    assert len(rows) == len(split) == 405
    assert len({split[x] for x in "abc"}) == 1
    share = sum(s == "train" for s in split.values()) / len(split)
    assert 0.5 < share < 0.7
    with pytest.raises(ValueError):
        splits.assign_splits(records, "rec", links_df, "rec", "entity", {"train": 0.0})


def test_torn_groups(spark):
    roots = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")], "node string, root string")
    present = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test"), ("d", None), ("c", "test")], "f string, s string")
    assert [r["root"] for r in splits.torn(roots, present, "f", "s").collect()] == ["a"]
