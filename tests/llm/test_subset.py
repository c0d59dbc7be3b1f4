import math
import random

from curatrix.llm.subset import class_counts, varied_subset
from curatrix.stage import Stages

SCHEMA = "id bigint, features array<struct<feature:string,mass:double>>, cls string, taken int"


def value(chosen):
    mass = {}
    for features in chosen:
        for f, m in features:
            mass[f] = mass.get(f, 0) + m
    return sum(map(math.sqrt, mass.values()))


def run(spark, rows, size, **how):
    df = spark.createDataFrame([(i, f, "x", 0) for i, f in rows], SCHEMA)
    return [r["id"] for r in varied_subset(df, "id", "features", size, **how).collect()]


def rows_of(seed=11, n=400):
    rnd = random.Random(seed)
    kinds = [0] * 60 + [1] * 20 + list(range(2, 22))
    out = []
    for i in range(n):
        k = rnd.choice(kinds)
        out.append((i, [(f"kind{k}", 1.0), (f"source{i % 3}", 0.01)]))
    return out


def test_every_kind_and_no_crowd(spark):
    rows = rows_of()
    chosen = run(spark, rows + rows[:50], 60)
    features = dict(rows)
    assert len(chosen) == len(set(chosen)) == 60
    kinds = {f[0][0] for f in features.values()}
    assert {features[i][0][0] for i in chosen} == kinds
    left, greedy = dict(features), []
    for _ in range(60):
        best = max(left, key=lambda i: value(greedy + [left[i]]))
        greedy.append(left.pop(best))
    assert value([features[i] for i in chosen]) >= 0.95 * value(greedy)


def test_fewer_than_kinds_gives_different_kinds(spark):
    rows = rows_of()
    features = dict(rows)
    chosen = run(spark, rows, 9)
    assert len(chosen) == 9 and len({features[i][0][0] for i in chosen}) == 9


def test_all_none_and_odd_rows(spark):
    odd = [(1, [("a", 1.0)]), (2, None), (3, []), (4, [("a", None), (None, 1.0), ("b", -1.0)]), (None, [("a", 1.0)]), (5, [("b", 2.0), ("b", 2.0)])]
    assert sorted(run(spark, odd, 10)) == [1, 5]
    assert run(spark, [], 10) == [] and run(spark, odd, 0) == []


def greedy(rows, size):
    left, mass, total = dict(rows), {}, 0.0
    gain = lambda i: sum(math.sqrt(mass.get(f, 0) + m) - math.sqrt(mass.get(f, 0)) for f, m in left[i])
    for _ in range(size):
        best = max(left, key=gain)
        total += gain(best)
        for f, m in left.pop(best):
            mass[f] = mass.get(f, 0) + m
    return total


def test_classes_that_share_features(spark):
    """No two records alike, a feature that all of them have, and others that many have."""
    rnd = random.Random(5)
    rows = [(i, [("all", 1.0), *((f"w{w}", rnd.choice([1.0, 2.0])) for w in {min(int(rnd.paretovariate(0.7)), 300) for _ in range(5)}), (f"own{i}", 0.001)]) for i in range(200)]
    features = dict(rows)
    chosen = run(spark, rows, 30)
    assert len(set(chosen)) == 30 and value([features[i] for i in chosen]) >= 0.95 * greedy(rows, 30)


def test_few_rounds_where_classes_share_their_heaviest_feature(spark):
    classes = spark.createDataFrame([(f"c{k}", 30, [("shared", 1.0), (f"own{k}", 0.0001)]) for k in range(8)], "cls string, n long, features array<struct<feature:string,mass:double>>")
    taken, rounds = class_counts(classes, 160, 0.2, Stages(spark))
    assert sum(r["taken"] for r in taken.collect()) == 160 and 0 < rounds < 60


def test_masses_that_are_no_numbers(spark):
    odd = [(1, [("a", float("nan"))]), (2, [("a", 1.0)]), (3, [("b", float("inf")), ("c", 1.0)]), (4, [("c", 1.0)]), (5, [("c", 1.0), ("c", 0.5)])]
    assert sorted(run(spark, odd, 10)) == [2, 3, 4, 5]
    assert run(spark, odd, 2)[0] in (2, 3, 4, 5)
