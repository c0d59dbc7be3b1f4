import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import boxes, names, scalars


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


B, W, H = "b", "w", "h"


def clip(spark, bbox, w=640, h=640):
    return one(spark, boxes.clip(*map(F.col, (B, W, H))), b=bbox, w=w, h=h)


def test_clip(spark):
    r = clip(spark, [227.0, 237.0, 394.611, 403.43])
    assert r["changed"] and np.allclose(r["bbox"], [227.0, 237.0, 394.611, 403.0])
    assert clip(spark, [0.0, 0.0, 10.0, 10.0])["changed"] is False
    assert clip(spark, [0.0, 0.0, 0.0, 10.0]) is None and clip(spark, [700.0, 0.0, 5.0, 5.0]) is None and clip(spark, [-5.0, 0.0, 5.0, 5.0]) is None


def test_clip_of_wrong_length(spark):
    df = spark.createDataFrame([([],), ([1.0, 2.0, 3.0],), (None,), ([1.0, 1.0, 1.0, 1.0, 1.0],)], "b array<double>")
    assert [r["x"] for r in df.select(boxes.clip(F.col("b"), F.lit(10), F.lit(10)).alias("x")).collect()] == [None] * 4
    assert df.select(boxes.outlier_flags(F.col("b"), F.lit(10), F.lit(10)).alias("x")).count() == 4


def test_label_line(spark):
    args = dict(b=[10.0, 20.0, 30.0, 40.0], w=100, h=200, c=2)
    assert one(spark, boxes.label_line(*map(F.col, ("c", B, W, H))), **args) == "2 0.25000000 0.20000000 0.30000000 0.20000000"
    with pytest.raises(Exception, match="outside"):
        one(spark, boxes.label_line(*map(F.col, ("c", B, W, H))), **(args | {"b": [90.0, 20.0, 30.0, 40.0]}))


def test_flags(spark):
    flag = lambda b, w=640, h=640: one(spark, boxes.outlier_flags(*map(F.col, (B, W, H))), b=b, w=w, h=h)
    assert flag([100.0, 100.0, 50.0, 50.0]) == []
    assert flag([100.0, 100.0, 3.9, 50.0]) == ["TINY", "THIN_ASPECT"] and flag([100.0, 100.0, 4.0, 39.0]) == ["TINY"][:0] + (["TINY"] if 156 / 640**2 < 1e-4 else [])
    assert "LARGE" not in flag([10.0, 10.0, 320.0, 320.0]) and "LARGE" in flag([10.0, 10.0, 321.0, 320.0])
    assert flag([6.4, 100.0, 50.0, 50.0]) == ["BOUNDARY"] and flag([100.0, 100.0, 100.0, 10.0]) == ["THIN_ASPECT"]


def test_iou(spark):
    cols = lambda s: [F.col(f"{s}{k}") for k in range(4)]
    value = lambda a, b: one(spark, boxes.iou(cols("a"), cols("b")), **{f"a{k}": float(v) for k, v in enumerate(a)}, **{f"b{k}": float(v) for k, v in enumerate(b)})
    assert value((0, 0, 10, 10), (0, 0, 5, 10)) == 0.5
    assert value((0, 0, 0, 0), (0, 0, 0, 0)) == 0 and value((0, 0, 1, 1), (2, 2, 3, 3)) == 0 and value((5, 5, 0, 0), (0, 0, 5, 5)) == 0


def test_numbers(spark):
    text = ["1_0", "0.5f", "nan", "+1", " 1 ", "1.5", "1e3", ".5", "", None, "99999999999999999999"]
    df = spark.createDataFrame([(t,) for t in text], "t string").select(scalars.strict_int(F.col("t")).alias("i"), scalars.strict_double(F.col("t")).alias("d"))
    rows = df.collect()
    assert [r["i"] for r in rows] == [None, None, None, 1, 1, None, None, None, None, None, None]
    assert [r["d"] for r in rows] == [None, None, None, 1.0, 1.0, 1.5, 1000.0, 0.5, None, None, 1e20]
    r = spark.range(1).select(scalars.ratio(F.lit(1), F.lit(0)).alias("a"), scalars.f1(F.lit(0.0), F.lit(0.0)).alias("b"), scalars.binary_round(F.lit(2.0000005)).alias("c"), scalars.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")).alias("h")).first()
    assert (r["a"], r["b"], r["c"], r["h"]) == (0.0, 0.0, round(2.0000005, 6), 64)


def test_fingerprint(spark):
    rnd = np.random.default_rng(3)
    gray = rnd.integers(0, 256, (5, 72)).tolist()
    got = [r["d"] for r in spark.createDataFrame([(g,) for g in gray], "g array<int>").select(scalars.gray_dhash("g").alias("d")).collect()]
    for g, d in zip(gray, got):
        bits = [g[9 * y + x + 1] > g[9 * y + x] for y in range(8) for x in range(8)]
        assert d & (2**64 - 1) == sum(1 << k for k, b in enumerate(bits) if b)


def test_rmse(spark):
    assert math.isclose(one(spark, scalars.rmse(F.col("a"), F.col("b")), a=[0.0, 1.0], b=[1.0, 3.0]), math.sqrt(2.5))


def test_names(spark):
    rows = ["a/b\\c d.JPG ", " x.tar.gz", ".hidden", "folder/", "", None]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    got = df.select(names.bare_name(F.col("p")).alias("n"), names.stem(F.col("p")).alias("s"), names.suffix(F.col("p")).alias("e")).collect()
    assert [tuple(r) for r in got[:3]] == [("c d.JPG", "c d", ".jpg"), ("x.tar.gz", "x.tar", ".gz"), (".hidden", ".hidden", "")]
    assert [r["n"] for r in got[3:]] == [None, None, None]
    key, rest = names.key_parts(F.lit("train/a/b"))
    r = spark.range(1).select(key.alias("k"), rest.alias("r"), names.append_note(F.lit(""), F.lit("n")).alias("a"), names.append_note(F.lit("m"), F.lit("n")).alias("b"), names.numbered("D", F.lit(7)).alias("d"), names.numbered("D", F.lit(12345)).alias("e")).first()
    assert tuple(r) == ("train", "a/b", "n", "m | n", "D007", "D12345")


def test_hashes_however_written(spark):
    h = "0123456789abcdef" * 4
    wide = h.translate({ord(c): ord(c) + 0xFEE0 for c in "0123456789abcdef"})
    pairs = "-".join(h[k : k + 2] for k in range(0, 64, 2))
    same = [h, h.upper(), f"sha256:{h}", f" SHA-256 = {h.upper()}\n", f"SHA2-256({h})", f"sha256 {h}", f"0x{h}", pairs, pairs.replace("-", ":"), f"{h[:32]} {h[32:]}", wide, f"\xa0{h}\u3000", f"{h}  a/b.jpg", f"sha256-{pairs}", f'"{h}"']
    other = [None, "", h[:63], h + "0", "g" + h[1:], "sha256:", f"sha256:{h}{h}", f"x{h}"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(same + other)], "k int, v string")
    got = {r["k"]: r["s"] for r in df.select("k", names.sha_digits(F.col("v")).alias("s")).collect()}
    assert [got[k] for k in range(len(same) + len(other))] == [h] * len(same) + [None] * len(other)
    assert df.limit(1).select(names.split_name(F.lit("\tVALID\n")).alias("s")).first()["s"] == "val"
