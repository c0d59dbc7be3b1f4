"""Loading: lines that parse or don't, and small files brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction, rejects
from ..stage import table
from .registry import Registry

registry = Registry()

# fields are cut one after the other from the left: a quoted one if a quote stands at its beginning and the next quote at its end, else up to the next separator
_LINES_SQL = rf"""
WITH RECURSIVE l AS (SELECT DISTINCT line_id, line, label_file, line_no FROM label_lines WHERE regexp_matches(line, '[^ \t\r]')),
q AS (SELECT DISTINCT line FROM l WHERE contains(line, '"')),
w AS (SELECT line, CAST([] AS VARCHAR[]) AS f, ltrim(line, ' ' || chr(9) || chr(13)) AS rest, 0 AS bad FROM q
  UNION ALL SELECT line, list_append(f, CASE WHEN quoted THEN substr(rest, 2, strpos(substr(rest, 2), '"') - 1) ELSE plain END),
    ltrim(substr(rest, 1 + CASE WHEN quoted THEN strpos(substr(rest, 2), '"') + 1 ELSE length(plain) END), ' ' || chr(9) || chr(13)), bad + CASE WHEN NOT quoted AND contains(plain, '"') THEN 1 ELSE 0 END
  FROM (SELECT *, regexp_matches(rest, '^"[^"]*"([ \t\r]|$)') AS quoted, regexp_extract(rest, '^[^ \t\r]+') AS plain FROM w WHERE rest <> '')),
k AS (SELECT line_id, label_file, line_no, l.line, CASE WHEN w.line IS NULL THEN list_filter(string_split_regex(l.line, '[ \t\r]+'), lambda x: x <> '') ELSE w.f END AS v, coalesce(w.bad, 0) > 0 AS misquoted FROM l LEFT JOIN (SELECT * FROM w WHERE rest = '') w ON w.line = l.line),
n AS (SELECT *, len(v) = 5 AS five, len(v) = 5 AND regexp_full_match(v[1], '{rejects.WHOLE}') AND len(list_filter(v[2:5], lambda x: NOT regexp_full_match(x, '{rejects.REAL}'))) = 0 AS numeric FROM k),
d AS (SELECT *, CASE WHEN numeric THEN try_cast(v[1] AS HUGEINT) END AS c, CASE WHEN numeric THEN list_transform(v[2:5], lambda x: try_cast(x AS DOUBLE)) END AS p FROM n),
r AS (SELECT *, CASE WHEN misquoted THEN 'QUOTING' WHEN NOT five THEN 'COLUMNS' WHEN NOT numeric THEN 'NUMERIC' WHEN NOT coalesce(c BETWEEN 0 AND 3, false) THEN 'CLASS_RANGE'
  WHEN len(list_filter(p, lambda x: coalesce(x BETWEEN 0 AND 1, false))) < 4 THEN 'COORD_RANGE' WHEN p[3] = 0 OR p[4] = 0 THEN 'SIZE' END AS reason FROM d)
"""


def parsed_lines(spark: SparkSession, sf_dir: str, *source: str) -> DataFrame:
    return rejects.parse_lines(table(spark, sf_dir, "label_lines"), "line_id", "line", source=source)


@registry.query(_LINES_SQL + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.failed(parsed_lines(spark, sf_dir)).select("line_id", "reason")


@registry.query(_LINES_SQL + "SELECT line_id, label_file, line_no, line, reason FROM r WHERE reason IS NOT NULL")
def p3_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failed lines with their files and numbers."""
    return rejects.failed(parsed_lines(spark, sf_dir, "label_file", "line_no"))


@registry.query(_LINES_SQL + "SELECT line_id, CAST(c AS INTEGER) AS class_id, p[1] AS x_center, p[2] AS y_center, p[3] AS width, p[4] AS height FROM r WHERE reason IS NULL")
def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.valid(parsed_lines(spark, sf_dir)).select("line_id", *rejects.FIELDS)


@registry.query(_LINES_SQL + "SELECT coalesce(reason, 'VALID') AS outcome, count(*) AS lines FROM r GROUP BY 1")
def p3_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_lines(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("VALID")).alias("outcome")).agg(F.count("*").alias("lines"))


_FILES_SQL = r"""
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY written_at DESC, content DESC) AS r FROM label_files) WHERE r = 1),
x AS (SELECT file_id, path, list_filter(string_split_regex(content, '\r\n?|\n'), lambda s: regexp_matches(s, '[^ \t]')) AS records FROM l),
p AS (SELECT file_id, path, unnest(range(1, len(records) + 1)) AS i, records FROM x)
"""


@registry.query(_FILES_SQL + r"SELECT file_id, CAST(i AS INTEGER) AS line_no, TRY_CAST(regexp_extract(records[i], '^[ \t]*([^ \t]+)', 1) AS INTEGER) AS class_id FROM p")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compact(table(spark, sf_dir, "label_files")).records.select("file_id", "line_no", "class_id")


@registry.query(
    _FILES_SQL
    + """, s AS (SELECT file_id, octet_length(encode(coalesce(content, ''))) AS bytes, sum(octet_length(encode(coalesce(content, '')))) OVER (ORDER BY path, file_id ROWS UNBOUNDED PRECEDING) AS upto FROM l)
SELECT CAST((upto - bytes) // 16384 AS BIGINT) AS group_no, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY 1"""
)
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each group when files of 16 KiB are wanted, so that small tables have many."""
    done = compaction.compact(table(spark, sf_dir, "label_files"), target=16 << 10)
    return done.plan.groupBy("group_no").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@registry.query(
    _FILES_SQL
    + """, s AS (SELECT file_id, sum(octet_length(encode(coalesce(content, '')))) OVER (ORDER BY path, file_id ROWS UNBOUNDED PRECEDING) - octet_length(encode(coalesce(content, ''))) AS before FROM l)
SELECT CAST(before // 16384 AS BIGINT) AS group_no, 1 AS files, count(*) AS records FROM s JOIN p USING (file_id) GROUP BY 1"""
)
def p4_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that hold the records of each group, as written: one, and how many records are in it."""
    done = compaction.compact(table(spark, sf_dir, "label_files"), target=16 << 10)
    return done.records.select("group_no", F.col("_metadata.file_path").alias("file")).groupBy("group_no").agg(F.count_distinct("file").cast("int").alias("files"), F.count("*").alias("records"))
