import random

import pytest

from curatrix.llm import mixing


def test_water_filling():
    # a third source can give 10 at most; what it lacks goes to the others by their weights
    assert mixing.water_fill([(0.25, 100, 10), (0.25, 100, 10), (0.5, 5, 2)], 100) == [45.0, 45.0, 10]
    # its share then clamps the second one too
    assert mixing.water_fill([(0.4, 1000, 1), (0.2, 25, 1), (0.4, 10, 1)], 100) == [65.0, 25, 10]
    assert mixing.water_fill([(1.0, 5, 2)], 100) == [10]
    assert mixing.water_fill([(0.5, 0, 3), (0.5, 10, 0)], 100) == [0.0, 0.0]
    assert mixing.water_fill([], 100) == []


def make(spark, rows, targets, **how):
    sized = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id bigint, source string, tokens bigint, weight double, most int")
    t = spark.createDataFrame(targets, "source string, weight double, max_repeats int")
    return mixing.Mix(sized, "doc_id", "source", "tokens", t, **how)


TARGETS = [("A", 0.5, 2), ("b", 0.3, 3), ("gone", 0.1, 1), ("zero", None, None), (None, 0.1, 1)]


def test_mix(spark):
    rows = [(k, " a " if k % 2 else "A", 10) for k in range(400)] + [(1000 + k, "B", 10) for k in range(20)] + [(2000, None, 50), (2001, "other", 50), (2002, "a", None), (2003, "a", 0)]
    m = make(spark, rows, TARGETS)
    assert m.total == 4000 + 200 + 100
    report = {r["source"]: r for r in m.report().collect()}
    assert report["b"]["reachable"] is False and report["b"]["given"] == 600 and report["b"]["repetitions"] == 3
    assert report["A"]["reachable"] is True and abs(report["A"]["given"] - 3700) < 1e-6
    assert report["gone"]["reachable"] is False and report["gone"]["given"] == 0 and report["zero"]["reachable"] is True
    uses = m.uses().collect()
    assert {r["source"] for r in uses} == {"A", "b"} and max(r["uses"] for r in uses if r["source"] == "A") <= 2
    assert all(r["uses"] == 3 for r in uses if r["source"] == "b")
    got = {r["source"]: r for r in m.reached().collect()}
    assert abs(got["A"]["used"] - 3700) < 400 and got["gone"]["used"] == 0
    assert sorted(map(tuple, m.uses().collect())) == sorted(map(tuple, uses))


def test_no_records_and_doubled_targets(spark):
    m = make(spark, [], TARGETS)
    assert m.total == 0 and m.uses().collect() == [] and len(m.report().collect()) == 5
    with pytest.raises(ValueError):
        make(spark, [], [("a", 0.5, 1), (" A", 0.5, 1)])


def test_shares_are_as_planned_but_for_a_record(spark):
    """Sizes that differ much, a source of more than a bucket's records, one with fewer tokens than its share, and one too small for a single record."""
    rnd = random.Random(4)
    rows = [(k, "a", rnd.choice([1, 5, 400])) for k in range(3000)] + [(5000 + k, " B ", 50) for k in range(40)] + [(9000, "c", 10_000)] + [(9500 + k, None, 100) for k in range(30)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.299, 2), ("C", 0.001, 5)], "source string, weight double, max_repeats int")
    plan = mixing.Mix(sized, "doc_id", "source", "tokens", targets, total=200_000)
    uses = plan.uses().collect()
    assert len({r["doc_id"] for r in uses}) == len(uses)
    for r in plan.report().collect():
        own = [u for u in uses if u["source"] == r["source"]]
        used = sum(u["uses"] * u["size"] for u in own)
        longest = max(size for _, s, size in rows if s and s.strip().lower() == r["source"].lower())
        assert abs(used - r["given"]) <= longest and all(u["uses"] <= r["max_repeats"] for u in own)
