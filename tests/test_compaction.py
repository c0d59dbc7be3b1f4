import datetime as dt

import pytest

from curatrix.operators import compaction
from curatrix.stage import Stages

SCHEMA = "file_id bigint, path string, content string, size_bytes bigint, written_at timestamp, part int, group_no int, records string"


def at(day):
    return dt.datetime(2025, 1, day)


def frame(spark, rows):
    return spark.createDataFrame([(i, p, c, 0, t, 1, 2, "x") for i, p, c, t in rows], SCHEMA)


ROWS = [
    (1, "a/1.txt", "0 .1 .1 .1 .1\n1 .2 .2 .2 .2", at(1)), (1, "a/1.txt", "2 .3 .3 .3 .3\r\n\r\n \t\n3 x", at(2)), (1, "a/1.txt", "2 .3 .3 .3 .3\r\n\r\n \t\n3 x", at(2)),
    (2, "a/2.txt", "", at(1)), (3, "a/3.txt", None, at(1)), (4, "a/4.txt", "\n\n", at(3)), (5, "b/5.txt", "a 1\n9999999999 2\n\t 7 3\r8", None), (6, None, "0 .1", at(1)), (None, "z", "0 .1", at(1)),
    (7, "b/7.txt", "5 tie", at(4)), (7, "b/7.txt", "6 tie", at(4)),
]


def test_last_content_each_record_once(spark):
    done = compaction.compact(frame(spark, ROWS), target=20, ranges=3)
    got = sorted((r["file_id"], r["line_no"], r["class_id"], r["record"]) for r in done.records.collect())
    assert got == [
        (1, 1, 2, "2 .3 .3 .3 .3"), (1, 2, 3, "3 x"), (5, 1, None, "a 1"), (5, 2, None, "9999999999 2"), (5, 3, 7, "\t 7 3"), (5, 4, 8, "8"), (6, 1, 0, "0 .1"), (7, 1, 6, "6 tie"),
    ]
    assert done.counts["records"] == 8 and done.counts["files"] == 7


def test_very_long_and_many(spark):
    rows = [(k, f"p/{k % 7}/{k}.txt", "0 .1 .1 .1 .1\n" * (k % 4), at(1)) for k in range(500)] + [(1000, "p/long.txt", "1 .5 .5 .5 .5\n" * 20_000, at(1))]
    done = compaction.compact(frame(spark, rows), target=5000, ranges=5)
    assert done.counts["records"] == sum(k % 4 for k in range(500)) + 20_000
    plan = done.plan.collect()
    assert len(plan) == 501
    size = {}
    for r in plan:
        size[r["group_no"]] = size.get(r["group_no"], 0) + r["bytes"]
    largest = max(r["bytes"] for r in plan)
    assert all(s < 5000 + largest for s in size.values()) and sum(size.values()) == sum(r["bytes"] for r in plan)
    in_order = sorted(plan, key=lambda r: (r["path"], r["file_id"]))
    assert [r["group_no"] for r in in_order] == sorted(r["group_no"] for r in plan)


def test_no_files(spark):
    done = compaction.compact(frame(spark, []), ranges=2)
    assert done.records.count() == 0 and done.counts == {"files": 0, "bytes": 0, "records": 0}


def test_a_lost_doubled_or_changed_record_is_found(spark):
    last = Stages(spark).write(compaction.last_contents(frame(spark, ROWS)))
    before = spark.sql(compaction.BEFORE, last=last).first().asDict()
    good = compaction.compact(frame(spark, ROWS)).records
    compaction.reconcile(good, before)
    for bad in (good.where("file_id <> 6"), good.unionByName(good.where("file_id = 6")), good.selectExpr("file_id", "path", "line_no", "class_id", "replace(record, 'tie', 'tia') AS record", "group_no")):
        with pytest.raises(RuntimeError):
            compaction.reconcile(bad, before)
