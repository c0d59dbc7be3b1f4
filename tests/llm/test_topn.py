import random

import pytest

from curatrix.llm import topn

SCHEMA = "g bigint, h string, score double, id bigint, s string, i string, c int, need int"


def brute(rows, n):
    import math

    groups = {}
    for g, h, score, i in set(rows):
        if g is not None and h is not None and score is not None and math.isfinite(score):
            groups.setdefault((g, h), []).append((score, i))
    out = set()
    for (g, h), items in groups.items():
        items.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out |= {(g, h, k + 1, i, s) for k, (s, i) in enumerate(items[:n])}
    return out


def found(spark, rows, n):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    return {(r["g"], r["h"], r["rank_no"], r["id"], r["score"]) for r in topn.top_n(df, ["g", "h"], "score", "id", n).collect()}


@pytest.mark.parametrize("hot", [50_000, 40])
def test_as_sorting(spark, monkeypatch, hot):
    monkeypatch.setattr(topn, "LEAST_HOT", hot)
    monkeypatch.setattr(topn, "HOT_GROUPS", 1024)
    rnd = random.Random(5)
    odd = [None, float("nan"), float("inf"), -1e308, 1e308, 5e-324, 0.0]
    rows = []
    for _ in range(1500):
        g = 1 if rnd.random() < 0.4 else rnd.choice([None, *range(60)])
        score = rnd.choice(odd) if rnd.random() < 0.1 else round(rnd.random(), rnd.choice([1, 2, 9]))
        rows.append((g, rnd.choice(["a", "a", "b", None]), score, rnd.choice([None, rnd.randint(-(2**62), 2**62), rnd.randint(0, 400)])))
    rows += rows[:300]
    assert found(spark, rows, 3) == brute(rows, 3)


def test_all_equal_scores_go_by_identifier(spark):
    rows = [(1, "a", 0.5, k) for k in range(200)]
    assert found(spark, rows, 4) == brute(rows, 4)


def test_no_rows_and_none_wanted(spark):
    assert found(spark, [], 3) == set()
    assert found(spark, [(1, "a", 0.5, 1)], 0) == set()
