import pytest

from curatrix.operators import derivation
from curatrix.stage import new_path


def tables(spark):
    images = spark.createDataFrame([("train", 1, "a"), ("train", 2, "b"), ("val", 1, "c"), ("val", 3, None)], "split string, image int, name string")
    annotations = spark.createDataFrame([("train", 1, 10), ("train", 1, 11), ("val", 1, 12), ("train", 2, 13)], "split string, image int, id int")
    removed = spark.createDataFrame([("train", 2), ("train", 2), ("test", 1), (None, None)], "split string, image int")
    return images, annotations, removed


def test_plan_gate_and_apply(spark):
    images, annotations, removed = tables(spark)
    plan = derivation.derive(images, annotations, removed, ["split", "image"], "split")
    want = {("train", 1, 0, 2), ("val", 2, 1, 1)}
    assert {tuple(r) for r in plan.counts.collect()} == want and plan.path is None
    out = new_path(spark, "derived")
    wrong = spark.createDataFrame([("train", 1, 0, 2), ("val", 2, 0, 1)], plan.counts.schema)
    with pytest.raises(AssertionError):
        derivation.derive(images, annotations, removed, ["split", "image"], "split", wrong, out)
    done = derivation.derive(images, annotations, removed, ["split", "image"], "split", spark.createDataFrame(list(want), plan.counts.schema), out)  # nothing was written before
    assert {tuple(r) for r in done.counts.collect()} == want and sorted(r["id"] for r in done.annotations.collect()) == [10, 11, 12]
    with pytest.raises(FileExistsError):
        derivation.derive(images, annotations, removed, ["split", "image"], "split", None, out)


def test_unsound_tables_are_refused(spark):
    images, annotations, removed = tables(spark)
    with pytest.raises(AssertionError, match="more than once"):
        derivation.derive(images.unionByName(images.limit(1)), annotations, removed, ["split", "image"], "split")
    empty = derivation.derive(images.limit(0), annotations.limit(0), removed, ["split", "image"], "split")
    assert empty.images.isEmpty() and empty.counts.isEmpty()
