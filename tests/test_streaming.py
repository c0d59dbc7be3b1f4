import pytest
from pyspark.sql import functions as F

from curatrix.operators import inference
from curatrix.streaming import frames


def test_lines_written_apart(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "a", 1, "0 .5 .5 .1 .1"), (1, "a", 1, "0 .5 .5 .1 .1"), (2, "a", 2, "x"), (3, "a", 3, None)]
    spark.createDataFrame(rows, "line_id bigint, label_file string, line_no int, line string").write.parquet(source)
    run = lambda: frames.write_apart(frames.label_lines(spark, source), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(60)
    assert run() and run()  # nothing comes twice
    assert sorted(r["line_id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == [1, 3]
    assert [tuple(r["errors"]) for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [("MALFORMED",)]


def test_frames(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"frame_{k:03}.bin").write_bytes(bytes([k + 1]))
    even = frames.skip_odd(frames.frame_folder(spark, str(tmp_path)).withColumn("n", frames.frame_number(F.col("path"))), "n")
    query = even.select("n").writeStream.format("memory").queryName("even").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("even").collect()) == [0, 2, 4]
    scores = spark.createDataFrame([(0.5,), (0.51,), (None,)], "s double").select(frames.binary_class(F.col("s"), "cat", "dog").alias("c"))
    assert [r["c"] for r in scores.collect()] == ["cat", "dog", None]


def test_predict(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad")], "id bigint, image string")
    out = {r["id"]: r for r in inference.predict(rows, "id", "image", lambda: (lambda v: [{"class": v}] if v != "bad" else {}["a secret"])).collect()}
    assert out[1]["results"] == '[{"class": "a"}]' and out[2]["error"] == "KeyError" and out[2]["results"] is None
    assert inference.timing(inference.predict(rows, "id", "image", lambda: (lambda v: []))).first()["images"] == 2
    assert inference.confidence(0.05) == 0.05
    with pytest.raises(ValueError):
        inference.confidence(0.91)
