import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import audit, dedup, near, preparation, review, sets, validation


def test_resolve_duplicates(spark):
    rows = [
        ("h1", "train", "a", "s"), ("h1", "val", "b", "t"), ("h1", "test", "c", "s"), ("h2", "train", "e", "s"), ("h2", "train", "d", "s"), ("h3", "val", "f", "s"), ("h3", "val", "g", "t"),
        ("h4", "test", "h", None), ("h4", "test", "i", "s"), (None, "train", "j", "s"), (None, "train", "k", "s"), ("h5", "val", "l", None),
    ]
    df = spark.createDataFrame(rows, "sha string, split string, name string, sig string")
    out = {r["name"]: (r["kept"], r["outcome"]) for r in dedup.resolve(df, "sha", "split", "name", "sig").collect()}
    assert {n for n, (k, _) in out.items() if k} == {"c", "d", "j", "k", "l"}
    assert out["f"] == (False, "CONFLICT") and out["h"] == (False, "CONFLICT") and out["a"] == (False, "CROSS_SPLIT")
    r = dedup.report(df, "sha", "split", "sig").first()
    assert tuple(r) == (4, 9, 1, 3, 2 + 1 + 2 + 2, 4)
    assert dedup.report(df.limit(0), "sha", "split", "sig").first()["removed_files"] == 0
    assert dedup.groups(df.limit(0), "sha", "split").collect() == []


def test_line_errors(spark):
    lines = {"0 .5 .5 .5 .5": [], "9 2 .5 0 .5": ["CLASS", "COORDINATE", "SIZE"], "0 .5 .5 .5": ["MALFORMED"], "x .5 .5 .5 .5": ["MALFORMED"], "0 nan .5 .5 .5": ["MALFORMED"], "  ": [], "1 2 .5 .5 .5": ["COORDINATE"]}
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "line string")
    got = {r["line"]: (r["e"], r["c"]) for r in df.select("line", validation.line_errors(F.col("line")).alias("e"), validation.class_of_line(F.col("line")).alias("c")).collect()}
    assert {k: v[0] for k, v in got.items()} == lines | {None: []}
    assert got["1 2 .5 .5 .5"][1] == 1 and got["9 2 .5 0 .5"][1] is None and got["x .5 .5 .5 .5"][1] is None


def test_negatives_and_unmatched(spark):
    images = spark.createDataFrame([("a",), ("b",), ("c",)], "stem string")
    lines = spark.createDataFrame([("b", "malformed only"), ("d", "x")], "stem string, line string")
    assert sorted(r["stem"] for r in validation.negatives(images, lines, ["stem"]).collect()) == ["a", "c"]
    assert sorted(map(tuple, validation.unmatched(images, lines, ["stem"]).collect())) == [("a", "label"), ("c", "label"), ("d", "image")]


def test_positional_differences(spark):
    schema = "stem string, position int, class_id int, x_center double, y_center double, width double, height double"
    a = spark.createDataFrame([("a", 0, 1, 0.5, 0.5, 0.1, 0.1), ("a", 1, 1, 0.5, 0.5, 0.1, 0.1), ("a", 2, 1, 0.5, 0.5, 0.1, 0.1), ("b", 0, 1, 0.5, 0.5, 0.1, 0.1)], schema)
    b = spark.createDataFrame([("a", 0, 1, 0.500001, 0.5, 0.1, 0.1), ("a", 1, 2, 0.5, 0.5, 0.1, 0.1), ("a", 2, 1, 0.51, 0.5, 0.1, 0.1), ("a", 3, 1, 0.5, 0.5, 0.1, 0.1)], schema)
    got = sorted(map(tuple, validation.positional_differences(a, b, ["stem"]).collect()))
    assert got == [("a", 1, "CLASS"), ("a", 2, "BOX"), ("a", 3, "MISSING_ANNOTATION"), ("b", 0, "MISSING_LABEL")]


def test_gate(spark):
    a = spark.createDataFrame([("train", 3), ("val", 1)], "split string, n int")
    validation.assert_counts(a, a, ["split"])
    with pytest.raises(AssertionError):
        validation.assert_counts(a, spark.createDataFrame([("train", 3), ("val", 2)], "split string, n int"), ["split"])
    with pytest.raises(ValueError):
        preparation.assert_unique(a.unionByName(a), ["split"])


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k string") for v in (["x", "y", "y"], ["y", "z"]))
    assert tuple(sets.sizes(a, b, "k").first()) == (1, 1, 1)
    assert not sets.disjoint(a, b, "k") and not sets.subset(a, b, "k") and sets.equal(a, a) and not sets.equal(a, a.distinct())
    assert sorted(map(tuple, sets.union_reasons({"n": a, "m": b}, "k").collect())) == [("x", True, False), ("y", True, True), ("z", False, True)]


def test_audit(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, None), (2, None)], "g int, v double")
    rows = {r["g"]: r for r in audit.distribution(df, ["v"], ["g"]).collect()}
    assert rows[1]["median"] == 1.5 and rows[1]["p05"] == 1.05 and rows[2]["max"] is None
    ranks = spark.createDataFrame([(k, k % 3, -k) for k in range(9)], "id int, a int, b int")
    got = {r["id"]: r["reasons"] for r in audit.top_with_reasons(ranks, {"A": (3, [F.col("a")]), "B": (2, [F.col("b")])}, ["id"]).collect()}
    assert got == {0: "A", 3: "A", 6: "A", 8: "B", 7: "B"}
    rules = [("first", F.col("a") == 0, [F.col("id")]), ("again", F.col("a") == 0, [F.col("id")]), ("none", F.col("a") == 7, [F.col("id")])]
    assert {r["rule"]: r["id"] for r in audit.first_unused(ranks, rules, "id").collect()} == {"first": 0, "again": 3}
    strata = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "s string, id int")
    assert [r["id"] for r in audit.round_robin(strata, "s", [F.col("id")], 4).collect()] == [0, 9, 1, 2]


def test_strict_negatives(spark):
    df = spark.createDataFrame([(["Blackheads"],), (["Whiteheads", "Blackheads"],), (["Acne", "Blackheads"],), ([],), (["Acne"],)], "c array<string>")
    got = [tuple(r) for r in df.select(audit.is_strict_negative(F.col("c")), audit.is_mixed(F.col("c"))).collect()]
    assert got == [(True, False), (True, False), (False, True), (False, False), (False, False)]


def test_near_duplicates_as_brute_force(spark):
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(6)]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = []
    for k in range(120):
        v = rnd.choice(base)
        for _ in range(rnd.randint(0, 5)):
            v ^= 1 << rnd.randrange(64)
        rows.append((k, signed(v), [rnd.random() * 0.2 for _ in range(8)]))
    rows.append((500, None, [0.0] * 8))
    df = spark.createDataFrame(rows, "id int, d bigint, t array<double>")
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    rm = lambda a, b: (sum((x - y) ** 2 for x, y in zip(a, b)) / len(a)) ** 0.5
    rows += [(200 + k, r[1], r[2]) for k, r in enumerate(rows[:30])]  # copies
    df = spark.createDataFrame(rows, "id int, d bigint, t array<double>")

    def joined(pairs):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in root}

    known = [r for r in rows if r[1] is not None]
    for thumb in (None, "t"):
        links = {(r["a"], r["b"]) for r in near.near_duplicates(df, "id", "d", thumb).collect()}
        brute = {(a[0], b[0]) for a in known for b in known if a[0] < b[0] and bits(a[1], b[1]) <= 4 and (thumb is None or rm(a[2], b[2]) <= 0.08)}
        assert links <= brute and joined(links) == joined(brute)
        heads = {}
        for r in known:
            kind = (r[1], tuple(r[2]) if thumb else ())
            heads[kind] = min(heads.get(kind, r[0]), r[0])
        assert {(a, b) for a, b in brute if a in heads.values() and b in heads.values()} <= links
    assert near.near_duplicates(df.limit(0), "id", "d").collect() == []
    got = {(r["query"], r["key"]) for r in near.search(df, df.where("id % 10 = 0"), "id", "d", 20, block=4).collect()}
    assert got == {(a[0], b[0]) for a in known for b in known if a[0] % 10 == 0 and a[0] != b[0] and bits(a[1], b[1]) <= 20}


@pytest.mark.parametrize("least", [0.8, 0.3])
def test_overlapping_boxes_as_brute_force(spark, least):
    rnd = random.Random(3)
    rows = []
    for k in range(250):
        x, y, w, h = rnd.random() * 60, rnd.random() * 60, rnd.choice([0.0, 8, 9, 10, 20]), rnd.choice([8, 10, 11.5])
        rows.append((k % 2, k, x if rnd.random() < 0.5 else 5.0, y if rnd.random() < 0.5 else 5.0, w, h))
    rows = [(i, k, x, y, x + w, y + h) for i, k, x, y, w, h in rows]

    def iou(a, b):
        ov = max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))
        whole = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - ov
        return ov / whole if whole > 0 else 0

    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and iou(a, b) >= least}
    df = spark.createDataFrame(rows, "image int, id int, x1 double, y1 double, x2 double, y2 double")
    got = [(r["image"], r["a"], r["b"]) for r in near.overlapping(df, ["image"], "id", ["x1", "y1", "x2", "y2"], least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_new_pairs(spark):
    pairs, base = spark.createDataFrame([("b", "a"), ("c", "d")], "a string, b string"), spark.createDataFrame([("a", "b")], "a string, b string")
    assert [tuple(r) for r in near.not_in_baseline(pairs, base, "a", "b").collect()] == [("c", "d")]


def test_groups_and_cleanup(spark):
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), ("D", "E"), ("E", "D"), (None, "X"), ("Y", "Y")], "a string, b string")
    roots = review.connected(pairs, "a", "b")
    assert {r["node"]: r["root"] for r in roots.collect()} == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D"}
    split = spark.createDataFrame([("A", "train"), ("B", "val"), ("C", "test"), ("D", "train"), ("E", "val")], "node string, split string")
    members = roots.join(split, "node")
    groups = review.group_table(members, "root", "split")
    assert {r["root"]: (r["status"], r["splits"]) for r in groups.collect()} == {"A": ("HOLD_VAL_TEST_REVIEW", "train;val;test"), "D": ("PROPOSE_TRAIN_EXCLUSION_ONLY", "train;val")}
    actions = {r["node"]: r["action"] for r in review.cleanup(members, groups, "root", "split").collect()}
    assert actions == {"A": "PROPOSE_EXCLUDE_FROM_TRAIN", "B": "RETAIN_UNCHANGED_PENDING_VAL_TEST_REVIEW", "C": "RETAIN_UNCHANGED_PENDING_VAL_TEST_REVIEW", "D": "PROPOSE_EXCLUDE_FROM_TRAIN", "E": "RETAIN_HELD_OUT_UNCHANGED"}
    removed = review.removals(members, groups, spark.createDataFrame([("S",), ("A",)], "node string"), "root", "node", "split")
    assert {r["node"]: r["reason"][:3] for r in removed.collect()} == {"S": "STR", "A": "STR", "B": "VAL", "D": "CON"}
    roles = {(r["root"], r["node"]): r["role"] for r in review.retained_counterparts(members, removed, "root", "node", "split").collect()}
    assert roles == {("A", "A"): "REMOVED", ("A", "B"): "REMOVED", ("A", "C"): "COUNTERPART", ("D", "D"): "REMOVED", ("D", "E"): "COUNTERPART"}
    assert sorted(tuple(r) for r in review.split_sets(groups).collect()) == [("train;val", 1, 2), ("train;val;test", 1, 3)]
    assert {r["root"]: r["group_id"] for r in review.group_numbers(roots, "root", "node").collect()} == {"A": "G001", "D": "G002"}
    judged = spark.createDataFrame([("A", "C"), ("E", "D"), ("A", "D"), ("A", "Q")], "a string, b string")
    assert sorted(tuple(r) for r in review.torn_pairs(judged, roots, "a", "b", "node", "root").collect()) == [("A", "D"), ("A", "Q")]
    assert review.connected(pairs.limit(0), "a", "b").collect() == []


def test_outliers_and_their_annotations(spark):
    outliers = spark.createDataFrame([("i", 1, 9.0), ("i", 2, 8.0), ("j", 1, 7.0)], "image string, ident int, ratio double")
    annotations = spark.createDataFrame([("i", 1, 5, "late"), ("i", 1, 2, "first"), ("j", 1, 0, None), ("k", 1, 0, "other")], "image string, ident int, position int, name string")
    got = {(r["image"], r["ident"]): (r["position"], r["name"]) for r in review.boxes_of_outliers(outliers, annotations, ["image", "ident"]).collect()}
    assert got == {("i", 1): (2, "first"), ("i", 2): (None, None), ("j", 1): (0, None)}
    shown = review.displayed_boxes(annotations, outliers, ["image"], "ident").collect()
    assert sorted((r["image"], r["ident"], r["selected_outlier"]) for r in shown) == [("i", 1, True), ("i", 1, True), ("j", 1, True)]


def test_metadata(spark):
    pairs = spark.createDataFrame([("D001", "x"), ("D002", "y"), ("D003", None)], "pair_id string, file_a string")
    meta = spark.createDataFrame([("D001", "x"), ("D002", "z"), ("D003", None)], "pair_id string, file_a string")
    assert [r["pair_id"] for r in review.mismatched_metadata(pairs, meta, ["file_a"]).collect()] == ["D002"]
    found = review.with_differences(pairs, spark.createDataFrame([("D002", "BOX_GEOMETRY")], "pair_id string, difference string"))
    assert sorted(r["difference"] for r in found.collect()) == ["BOX_GEOMETRY", "MATCH", "MATCH"]
    assert [r["pair_id"] for r in pairs.where(review.in_id_range(F.col("pair_id"), 2, 3)).collect()] == ["D002", "D003"]


def test_numbered(spark):
    df = spark.createDataFrame([(k % 3, k) for k in range(200)], "g int, v int")
    got = {(r["g"], r["v"]): r["number"] for r in preparation.numbered(df, "g", ["v"]).collect()}
    assert got == {(k % 3, k): k // 3 + 1 for k in range(200)}


def test_preparation(spark):
    images = spark.createDataFrame([("train", 1, 0), ("train", 2, 3), ("val", 3, 1)], "split string, image_id int, originals int")
    objects = spark.createDataFrame([("val", 3, 0), ("val", 3, 0)], "split string, image_id int, class_id int")
    classes = spark.createDataFrame([(0, "acne"), (1, "wrinkle")], "class_id int, class_name string")
    got = {(r["split"], r["class_id"]): (r["objects"], r["images"]) for r in preparation.split_stats(images, objects, classes).collect()}
    assert got == {("train", 0): (0, 0), ("train", 1): (0, 0), ("val", 0): (2, 1), ("val", 1): (0, 0)}
    stats = {r["split"]: tuple(r)[1:] for r in preparation.image_stats(images, objects, "originals").collect()}
    assert stats == {"train": (2, 2, 1, 1, 0), "val": (1, 0, 0, 0, 2)}
