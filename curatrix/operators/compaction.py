"""Far too many small files: their records in few well-sized files, each exactly once (problem 4).

Planning is SQL. The manifest is frozen first, by writing it, in ranges of the path; sizes are summed within each range, and the ranges' sums give
each its offset, so no task sees more than a range. A file goes to the group in whose interval of the cumulative size it begins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stages, new_path

LAST = """
SELECT file_id, path, coalesce(octet_length(content), 0) AS bytes, coalesce(filter(split(content, '\\r\\n?|\\n'), x -> x RLIKE '[^ \\t]'), array()) AS records FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY written_at DESC NULLS LAST, content DESC NULLS LAST, path) AS r FROM {files} WHERE file_id IS NOT NULL
) WHERE r = 1"""
FREEZE = """SELECT file_id, path, bytes, spark_partition_id() AS part FROM (SELECT /*+ REPARTITION_BY_RANGE(%d, path, file_id) */ file_id, path, bytes FROM {last})"""
PLAN = """
WITH sums AS (SELECT part, sum(bytes) AS s FROM {frozen} GROUP BY part),
offsets AS (SELECT part, sum(s) OVER (ORDER BY part) - s AS before FROM sums),
placed AS (SELECT *, sum(bytes) OVER (PARTITION BY part ORDER BY path, file_id ROWS UNBOUNDED PRECEDING) - bytes AS inside FROM {frozen})
SELECT /*+ BROADCAST(o) */ p.file_id, p.path, p.bytes, (p.inside + o.before) DIV %d AS group_no FROM placed p JOIN offsets o ON p.part = o.part"""
RECORDS = """
SELECT p.group_no, p.file_id, p.path, CAST(r.pos + 1 AS INT) AS line_no, try_cast(element_at(split(trim(BOTH ' \\t' FROM r.record), '[ \\t]+'), 1) AS INT) AS class_id, r.record
FROM {last} l JOIN {plan} p ON l.file_id = p.file_id LATERAL VIEW posexplode(l.records) r AS pos, record"""
HASH = "CAST(xxhash64({file_id}, {line_no}, {record}) AS DECIMAL(38, 0))"
BEFORE = f"""
SELECT count(*) AS files, coalesce(sum(bytes), 0) AS bytes, coalesce(sum(size(records)), 0) AS records,
  coalesce(sum(aggregate(transform(records, (x, i) -> {HASH.format(file_id="file_id", line_no="CAST(i + 1 AS INT)", record="x")}), CAST(0 AS DECIMAL(38, 0)), (a, x) -> CAST(a + x AS DECIMAL(38, 0)))), 0) AS content FROM {{last}}"""
AFTER = f"SELECT count(*) AS records, coalesce(sum({HASH.format(file_id='file_id', line_no='line_no', record='record')}), 0) AS content FROM {{written}}"


@dataclass
class Compacted:
    """Where the records lie, how the files were grouped, and what was counted before and after."""

    path: str
    records: DataFrame
    plan: DataFrame
    counts: dict[str, int]


def last_contents(files: DataFrame) -> DataFrame:
    """One row a file_id, that of its last written_at; at one time, the greatest content. Null ids are left out."""
    return files.sparkSession.sql(LAST, files=files)


def plan_groups(last: DataFrame, target: int, stages: Stages, ranges: int | None = None) -> DataFrame:
    """(file_id, path, bytes, group_no)."""
    spark = last.sparkSession
    frozen = stages.write(spark.sql(FREEZE % (ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))), last=last), "frozen")
    plan = stages.write(spark.sql(PLAN % target, frozen=frozen), "plan")
    stages.drop(frozen)
    return plan


def reconcile(written: DataFrame, before: dict) -> dict[str, int]:
    """Counts of what was read and written; an error if a record is missing, doubled or changed. Hashes of file, number and record are added up, so nothing is shuffled."""
    after = written.sparkSession.sql(AFTER, written=written).first()
    if before["records"] != after["records"] or before["content"] != after["content"]:
        raise RuntimeError(f"records read: {before['records']}, written: {after['records']}, with{'out' if before['content'] == after['content'] else ''} differences in what they hold")
    return {"files": before["files"], "bytes": before["bytes"], "records": after["records"]}


def compact(files: DataFrame, out: str | None = None, target: int = 128 << 20, ranges: int | None = None) -> Compacted:
    """Writes the records of files (file_id, path, content, written_at) into `out`, one file a group, and reconciles what was written.

    A record is a line with anything but blanks and tabs; line_no counts a file's records from 1; class_id is the record's first field, null if that
    is no integer. Lines end with a line feed, a carriage return or both. Files without records, or with null content, have none in the output but are in the plan. No group is larger than
    the target plus one file. If the records read back aren't those read, an error is raised and nothing should be removed. Each group is one task and one file, without a folder of its own.
    """
    spark = files.sparkSession
    stages = Stages(spark)
    last = stages.write(last_contents(files), "last")
    plan = plan_groups(last, target, stages, ranges)
    before = spark.sql(BEFORE, last=last).first().asDict()
    out = out or new_path(spark, "compacted")
    records = spark.sql(RECORDS, last=last, plan=plan)
    groups = int(before["bytes"]) // target + 1
    records.repartitionById(groups, F.col("group_no").cast("int")).sortWithinPartitions("path", "file_id", "line_no").write.parquet(out)
    written = spark.read.schema("group_no bigint, file_id bigint, path string, line_no int, class_id int, record string").parquet(out)
    counts = reconcile(written, before)
    stages.drop(last)
    return Compacted(out, written, plan, counts)
