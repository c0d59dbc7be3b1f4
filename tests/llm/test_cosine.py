import math
import random

import pytest

from curatrix.llm import cosine
from curatrix.operators import near


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "id string, term bigint, weight double, w double, df string")


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_as_brute_force(spark, threshold):
    rnd = random.Random(9)

    def side(prefix):
        out = []
        for k in range(60):
            for t in rnd.sample(range(25), rnd.randint(1, 6)):
                out.append((f"{prefix}{k}", min(t, rnd.randint(0, 25)), rnd.choice([0.5, 1.0, 2.5])))
        return out

    left, right = side("l"), side("r")
    bad = [(None, 1, 1.0), ("n", None, 1.0), ("n", 1, None), ("n", 1, 0.0), ("n", 1, -2.0), ("n", 1, float("nan"))]

    def units(rows):
        v = {}
        for i, t, w in rows:
            v.setdefault(i, {})[t] = v.get(i, {}).get(t, 0) + w
        return {i: {t: w / math.sqrt(sum(x * x for x in d.values())) for t, w in d.items()} for i, d in v.items()}

    a, b = units(left), units(right)
    want = {(x, y): dot for x, p in a.items() for y, q in b.items() if (dot := sum(w * q.get(t, 0) for t, w in p.items())) >= threshold - 1e-9}
    got = {(r["left_id"], r["right_id"]): r["cosine"] for r in cosine.cosine_join(vectors(spark, left + bad), vectors(spark, right + bad), threshold).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_empty_sides_and_threshold(spark):
    assert cosine.cosine_join(vectors(spark, []), vectors(spark, [("a", 1, 1.0)]), 0.5).collect() == []
    with pytest.raises(ValueError):
        cosine.cosine_join(vectors(spark, []), vectors(spark, []), 0)


@pytest.mark.parametrize("agreeing", [1, 2, 3])
def test_near_values_whatever_the_blocks(spark, agreeing):
    rnd = random.Random(12)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    base = [rnd.getrandbits(64) for _ in range(6)] + [0, 2**64 - 1]
    values = set()
    for _ in range(120):
        v = rnd.choice(base)
        for bit in rnd.sample(range(64), rnd.randint(0, 5)):
            v ^= 1 << bit
        values.add(signed(v))
    left, right = sorted(values)[::2], sorted(values)[1::2] + sorted(values)[:9]
    df = lambda rows: spark.createDataFrame([(v,) for v in dict.fromkeys(rows)], "id bigint")
    got = {(r["left_id"], r["right_id"]) for r in cosine.near_pairs(df(left), df(right), 4, agreeing).collect()}
    assert got == {(a, b) for a in left for b in right if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert near.best_agreeing(1000, 1000, 4) < near.best_agreeing(10**9, 10**9, 4)


def test_overlaps_of_splits(spark):
    rnd = random.Random(10)
    base = [rnd.getrandbits(64) for _ in range(12)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = []
    for k in range(160):
        v = rnd.choice(base)
        for _ in range(rnd.randint(0, 7)):
            v ^= 1 << rnd.randrange(64)
        rows.append((k, rnd.choice(["train", "train", "val", "test", None]), rnd.choice([None, f"h{rnd.randint(0, 30)}"]), rnd.choice([None, signed(v), signed(v)])))
    rows += rows[:20] + [(None, "train", "h1", 0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "image_id bigint, split string, sha string, dhash bigint, id int, term int")
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    want = {}
    for a in set(rows):
        for b in set(rows):
            if a[0] is not None and b[0] is not None and a[1] in ("val", "test") and b[1] == "train":
                exact = a[2] is not None and a[2] == b[2]
                if exact or (a[3] is not None and b[3] is not None and bits(a[3], b[3]) <= 4):
                    want[(a[0], b[0])] = "exact" if exact else "near"
    got = {(r["held_out"], r["training"]): r["how"] for r in cosine.split_overlaps(df, "image_id", "split", "sha", "dhash").collect()}
    assert got == want and "near" in want.values()
