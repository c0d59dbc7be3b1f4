import random
import re
from itertools import combinations

import pytest

from curatrix.operators import near
from curatrix.plans import registry


def bits(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.mark.parametrize("block", [7, 2048])
def test_all_pairs_as_brute_force(spark, block):
    rnd = random.Random(4)
    rows = [(k, rnd.getrandbits(64) - 2**63) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]  # copies
    df = spark.createDataFrame([*rows, rows[0], (999, None)], "id int, d bigint")
    want = sorted((a[0], b[0], bits(a[1], b[1])) for a in rows for b in rows if a[0] < b[0] and bits(a[1], b[1]) <= 26)
    assert len(want) > 5 and sorted(map(tuple, near.all_pairs(df, "id", "d", 26, block).collect())) == want
    assert near.all_pairs(df.limit(0), "id", "d", 26, block).collect() == []


def test_pairs_of_all_embeddings(spark, tmp_path):
    """No id is divisible by 100."""
    rnd = random.Random(5)
    base = [[rnd.gauss(0, 0.12) for _ in range(64)] for _ in range(5)]
    rows = [(k + 1, [v + rnd.gauss(0, 0.05) for v in rnd.choice(base)]) for k in range(40)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    prints = {k: sum(1 << n for n in range(63) if e[n + 1] > e[n]) for k, e in rows}
    rmse = lambda x, y: (sum((a - b) ** 2 for a, b in zip(x, y)) / 64) ** 0.5
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0]]
    near_ = {(a[0], b[0]) for a, b in pairs if bits(prints[a[0]], prints[b[0]]) <= 16}
    close = {(a[0], b[0]) for a, b in pairs if bits(prints[a[0]], prints[b[0]]) <= 20 and rmse(a[1], b[1]) <= 0.14}
    assert near_ and close
    for name, want in (("near_pairs", near_), ("rmse_pairs", close)):
        got = [(r["a"], r["b"]) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_term_lists_are_not_broadcast(spark):
    """They have several rows of each fingerprint, which Spark's estimate leaves out, so the driver would hold far more than the limit of broadcasts."""
    rnd = random.Random(7)
    rows = [(k, rnd.getrandbits(64) - 2**63) for k in range(2000)]
    rows += [(2000 + k, d ^ (1 << k % 63)) for k, (_, d) in enumerate(rows[:200])]
    found = near.print_pairs(spark.createDataFrame(rows, "id int, d bigint"), "d")
    plan = found._jdf.queryExecution().toString()
    assert "Generate explode" in plan and "Broadcast" not in plan.split("== Physical Plan ==")[1]
    got = sorted(map(tuple, found.collect()))
    assert got == sorted((*sorted((d, rows[k][1])), 1) for k, (_, d) in enumerate(rows[2000:]))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()  # nor once it has run


def test_unjudged_as_brute_force(spark):
    rnd = random.Random(6)
    prints = [0, 0b11, 0b11111, 1 << 40, -1, -1 << 60]
    rows = {k: rnd.choice(prints) for k in range(40)} | {99: None}
    near_ = {(a, b) for a, b in combinations(rows, 2) if None not in (rows[a], rows[b]) and bits(rows[a], rows[b]) <= 4}
    base = [p for p in combinations(rows, 2) if rows[p[0]] == rows[p[1]] == 0 or {rows[p[0]], rows[p[1]]} == {0, 0b11} or rnd.random() < 0.3]
    base = [p if rnd.random() < 0.5 else p[::-1] for p in base] + base[:50] + [(0, 0), (1000, 1)]
    judged = {tuple(sorted(p)) for p in base}
    df, b = spark.createDataFrame([*rows.items(), (0, rows[0])], "id int, d bigint"), spark.createDataFrame(base, "x int, y int")
    of = {}
    for head, k in near.members(df, "id", "d").collect():
        of.setdefault(head, []).append(k)
    assert all(head == min(ks) for head, ks in of.items()) and sorted(k for ks in of.values() for k in ks) == list(range(40))
    found = near.unjudged(df, "id", "d", b, "x", "y").collect()
    spread = []
    for r in found:
        all_ = {tuple(sorted(p)) for p in (combinations(of[r["a"]], 2) if r["a"] == r["b"] else ((x, y) for x in of[r["a"]] for y in of[r["b"]]))}
        assert all_ <= near_ and (r["pairs"], r["judged"]) == (len(all_), len(all_ & judged)) and {bits(rows[x], rows[y]) for x, y in all_} == {r["hamming"]}
        spread += all_ - judged
    assert len(spread) == len(set(spread)) and set(spread) == near_ - judged
    zero, three = (min(k for k in rows if rows[k] == p) for p in (0, 0b11))
    assert not {(zero, zero), tuple(sorted((zero, three)))} & {(r["a"], r["b"]) for r in found}  # judged whole


def test_unjudged_images_whose_heads_are_judged(spark, tmp_path):
    images = "image_id bigint, file_name string, split string, width int, height int, sha256 string, dhash bigint, original_categories string, dataset_source string"
    rows = [(k, f"{k}.jpg", "train", 10, 10, None, d, "", "s") for k, d in ((1, 0), (2, 0), (3, 1), (4, 1), (5, 1 << 30), (6, 0b111 << 30))]
    spark.createDataFrame(rows, images).write.parquet(f"{tmp_path}/source_images.parquet")
    judged = [("a/1.jpg", "3.jpg"), ("2.jpg", "1.jpg"), ("5.jpg", "6.jpg")]
    spark.createDataFrame(judged, "file_a string, file_b string").write.parquet(f"{tmp_path}/duplicate_review.parquet")
    got = {(r["a"], r["b"]) for r in registry.queries()["new_near_pairs"](spark, str(tmp_path)).collect()}
    assert {(1, 3), (3, 3)} <= got and not {(1, 1), (5, 6)} & got


def test_unjudged_broadcasts_neither_terms_nor_names(spark, tmp_path):
    """Both are larger than Spark's estimate of them; rows that are repeated, or have other details of the same image, count once."""
    images = "image_id bigint, file_name string, split string, width int, height int, sha256 string, dhash bigint, original_categories string, dataset_source string"
    few = (1, "i/1.jpg", 0), (2, "i/2.jpg", 0), (3, "3.jpg", 1), (3, "3.jpg", 1), (4, None, 1), (5, "5.jpg", None)
    rows = [(k, n, split, 10, 10, None, d, "", "s") for k, n, d in few for split in ("train", "val")]
    spark.createDataFrame(rows, images).write.parquet(f"{tmp_path}/source_images.parquet")
    judged = [("a/1.jpg", "3.jpg"), ("3.jpg", "1.jpg"), ("2.jpg", "1.jpg"), ("1.jpg", "5.jpg"), (None, "1.jpg")]
    spark.createDataFrame(judged, "file_a string, file_b string").write.parquet(f"{tmp_path}/duplicate_review.parquet")
    found = registry.queries()["new_near_pairs"](spark, str(tmp_path))
    joins = re.findall(r"(\w+Join) \[(\w+)#", found._jdf.queryExecution().executedPlan().toString())
    assert {n for kind, n in joins if kind == "SortMergeJoin"} >= {"term", "fa", "fb"} and not {n for kind, n in joins if kind == "BroadcastHashJoin"} & {"term", "fa", "fb"}
    assert sorted(map(tuple, found.select("a", "b", "hamming", "pairs", "judged").collect())) == [(1, 3, 1, 4, 1), (3, 3, 0, 1, 0)]
