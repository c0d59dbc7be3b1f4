"""Exact duplicates, names across splits, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, sets, validation
from ..sources import files
from ..stage import table
from . import inputs
from .registry import Registry

registry = Registry()

_W = f"WITH {inputs.IMAGES}, i AS (SELECT *, coalesce(source, '') AS sig FROM images WHERE split IS NOT NULL)"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.images(spark, sf_dir).where("split IS NOT NULL").withColumn("sig", F.coalesce("source", F.lit("")))


@registry.query(_W + "SELECT sha, count(*) AS files, count(DISTINCT split) AS splits, count(DISTINCT split) > 1 AS cross_split FROM i WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(_images(spark, sf_dir), "sha", "split")


@registry.query(
    _W
    + """, g AS (SELECT *, count(*) OVER s AS n, min(split) OVER s <> max(split) OVER s AS cr, min(sig) OVER s = max(sig) OVER s AS agree,
  row_number() OVER (PARTITION BY sha ORDER BY CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, file_name) AS r FROM i WHERE sha IS NOT NULL WINDOW s AS (PARTITION BY sha))
SELECT image_id, split, file_name, CASE WHEN n = 1 THEN 'UNIQUE' WHEN cr THEN 'CROSS_SPLIT' ELSE 'SAME_SPLIT' END AS outcome FROM g WHERE n = 1 OR ((cr OR agree) AND r = 1)
UNION ALL SELECT image_id, split, file_name, 'UNIQUE' FROM i WHERE sha IS NULL"""
)
def dedup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.resolve(_images(spark, sf_dir), "sha", "split", "file_name", "sig").where("kept").select("image_id", "split", "file_name", "outcome")


@registry.query(
    _W
    + """, g AS (SELECT sha, count(*) AS n, min(split) <> max(split) AS cr, min(sig) <> max(sig) AS conflict FROM i WHERE sha IS NOT NULL GROUP BY sha HAVING count(*) > 1)
SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files, coalesce(CAST(count_if(cr) AS BIGINT), 0) AS cross_split_groups, coalesce(CAST(count_if(conflict) AS BIGINT), 0) AS conflicting_groups,
  CAST(coalesce(sum(CASE WHEN conflict AND NOT cr THEN n ELSE n - 1 END), 0) AS BIGINT) AS removed_files, CAST(coalesce(sum(CASE WHEN conflict AND NOT cr THEN n END), 0) AS BIGINT) AS excluded_files FROM g"""
)
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.report(_images(spark, sf_dir), "sha", "split", "sig")


@registry.query("SELECT lower(trim(text)) AS name, count(*) AS files, count(DISTINCT lang) AS splits FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def names_across_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check for names across splits, on texts across languages."""
    return dedup.same_name_across(table(spark, sf_dir, "documents").withColumn("text", F.trim("text")), "text", "lang")


@registry.query("SELECT sha256(text) AS sha, count(*) AS files, count(DISTINCT source) AS splits, count(DISTINCT source) > 1 AS cross_split FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def text_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(table(spark, sf_dir, "documents").withColumn("sha", F.sha2("text", 256)), "sha", "source")


@registry.query("""WITH a AS (SELECT path, sha256(content) AS h, row_number() OVER (PARTITION BY path ORDER BY written_at, content) AS r, row_number() OVER (PARTITION BY path ORDER BY written_at DESC, content DESC) AS q FROM label_files)
SELECT b.path, 'changed' AS change FROM a b JOIN a c ON b.path = c.path AND b.r = 1 AND c.q = 1 WHERE b.h <> c.h""")
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose last content isn't their first."""
    rows = table(spark, sf_dir, "label_files").groupBy("path").agg(F.min(F.struct("written_at", "content")).alias("first"), F.max(F.struct("written_at", "content")).alias("last"))
    side = lambda name: rows.select("path", F.sha2(f"{name}.content", 256).alias("sha256"))
    return files.manifest_changes(side("first"), side("last"))


@registry.query("SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS \"both\", (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_a, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_b")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.sizes(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k")


@registry.query("""WITH a AS (SELECT o_orderstatus AS k, count(*) AS in_a FROM orders GROUP BY 1), b AS (SELECT l_linestatus AS k, count(*) AS in_b FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(in_a, 0) AS in_a, coalesce(in_b, 0) AS in_b FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(in_a, 0) <> coalesce(in_b, 0)""")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.multiset_difference(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k")), ["k"])


@registry.query(
    f"WITH {inputs.IMAGES}, gone AS (SELECT stem FROM images WHERE split IS NULL), kept AS (SELECT * FROM images WHERE split IS NOT NULL), {inputs.LABELS}"
    + " SELECT coalesce(k.split, '') AS split, count(DISTINCT image_id) AS images, count(line_id) AS objects FROM kept k LEFT JOIN lab USING (stem) GROUP BY 1"
)
def remove_and_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without a split are removed with their boxes; what stays, by split."""
    i = inputs.images(spark, sf_dir)
    kept, objects = sets.remove(i, inputs.label_boxes(spark, sf_dir).select("stem", "line_id"), i.where("split IS NULL"), ["stem"])
    n = objects.groupBy("stem").agg(F.count("*").alias("n"))
    return kept.join(n, "stem", "left").groupBy("split").agg(F.count("*").alias("images"), F.coalesce(F.sum("n"), F.lit(0)).alias("objects"))


@registry.query(
    f"WITH RECURSIVE {inputs.IMAGES}, {inputs.COMPONENTS}"
    + """, a AS (SELECT DISTINCT file_name FROM comp), b AS (SELECT DISTINCT file_name FROM images WHERE split IS NULL)
SELECT coalesce(a.file_name, b.file_name) AS file_name, a.file_name IS NOT NULL AS linked, b.file_name IS NOT NULL AS no_split FROM a FULL JOIN b ON a.file_name = b.file_name"""
)
def removal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file once, with a boolean for each reason it would go for."""
    links = inputs.review_links(spark, sf_dir)
    linked = links.select(F.col("a").alias("file_name")).unionByName(links.select(F.col("b").alias("file_name")))
    return sets.union_reasons({"linked": linked, "no_split": inputs.images(spark, sf_dir).where("split IS NULL")}, "file_name")
