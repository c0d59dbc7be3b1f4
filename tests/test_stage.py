from types import SimpleNamespace

import pytest

from curatrix import stage
from curatrix.operators import audit, preparation
from curatrix.sources import files


def test_a_cluster_needs_a_shared_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://somewhere:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.shared_dir(cluster)


def test_tables_are_dropped_kept_and_released(spark):
    stage.release(spark)
    stages = stage.Stages(spark)
    a, b = (stages.write(spark.range(n), "t") for n in (3, 4))
    assert stages.together([a, b]).count() == 7
    paths = [stages.paths[id(x)][1] for x in (a, b)]
    view = b.select("id")
    stages.keep(b, view)
    stages.drop(a, None)
    assert [files.exists(spark, p) for p in paths] == [False, True]
    stages.drop(view)
    assert not files.exists(spark, paths[1])
    stages.write(spark.range(2), "left")
    assert stage.release(spark) == 1 and stage.release(spark) == 0


def test_lists_are_broadcast_only_while_short(spark):
    short, rows = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "id int, name string"), spark.range(10)
    plan = lambda d: rows.join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(stage.as_list(short)) and "broadcast" not in plan(stage.as_list(short, 4))
    assert rows.join(stage.as_list(short, 4), "id").count() == 5


def test_percentiles_of_one_value_and_sums_in_order(spark):
    rows = [("a", 1.0)] * 50 + [("a", 3.0), ("a", None), ("b", None)]
    got = {r["g"]: r for r in audit.distribution(spark.createDataFrame(rows, "g string, v double"), ["v"], ["g"]).collect()}
    assert (got["a"]["min"], got["a"]["median"], got["a"]["p95"], got["a"]["max"]) == (1.0, 1.0, 1.0, 3.0) and got["b"]["median"] is None
    df = spark.createDataFrame([("x", k, 2) for k in range(20)] + [("y", 5, 7)], "g string, k int, w int")
    sums = {(r["g"], r["k"]): r["upto"] for r in preparation.cumulated(df, "g", ["k"], df["w"], "upto").collect()}
    assert sums == {("x", k): 2 * k + 2 for k in range(20)} | {("y", 5): 7}
