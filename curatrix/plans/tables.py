"""Queries on the plain tables: percentiles, top k, boxes, samples, components of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, scalars
from ..operators import audit, evaluation, near, preparation
from ..stage import table
from .registry import Registry

registry = Registry()


@registry.query("""SELECT l_returnflag, measure, round(min(v), 6) AS min, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(max(v), 6) AS max FROM
  (SELECT l_returnflag, 'l_quantity' AS measure, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', l_extendedprice FROM lineitem) GROUP BY 1, 2""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = audit.distribution(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])
    return d.select("l_returnflag", "measure", *(F.round(p, 6).alias(p) for p in audit.POINTS))


_BOX_SQL = """b AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS x, l_discount * 1000 AS y, l_quantity * 8 AS w, (l_tax * 100 + 1) * 10 AS h, 640 AS iw, 480 AS ih FROM lineitem)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes of an image of 640 by 480."""
    l = table(spark, sf_dir, "lineitem")
    bbox = F.array(F.col("l_extendedprice") / 100, F.col("l_discount") * 1000, F.col("l_quantity") * 8, (F.col("l_tax") * 100 + 1) * 10)
    return l.select("l_orderkey", "l_linenumber", bbox.alias("bbox"), F.lit(640).alias("width"), F.lit(480).alias("height"))


@registry.query(f"""WITH {_BOX_SQL}, c AS (SELECT *, greatest(0, least(x, iw)) AS x1, greatest(0, least(y, ih)) AS y1, greatest(0, least(x + w, iw)) AS x2, greatest(0, least(y + h, ih)) AS y2 FROM b)
SELECT l_orderkey, l_linenumber, (x1 + (x2 - x1) / 2) / iw AS xc, (y1 + (y2 - y1) / 2) / ih AS yc, (x2 - x1) / iw AS nw, (y2 - y1) / ih AS nh,
  abs(x1 - x) > 1e-9 OR abs(y1 - y) > 1e-9 OR abs(x2 - x1 - w) > 1e-9 OR abs(y2 - y1 - h) > 1e-9 AS changed FROM c WHERE w > 0 AND h > 0 AND x2 > x1 AND y2 > y1""")
def clip_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = preparation.clip_boxes(_boxes(spark, sf_dir)).where("valid")
    shares = boxes.to_center(F.col("bbox"), F.col("width"), F.col("height"))
    return cut.select("l_orderkey", "l_linenumber", *(s.alias(n) for s, n in zip(shares, ("xc", "yc", "nw", "nh"))), "changed")


_FLAG_SQL = f"""WITH {_BOX_SQL}, f AS (SELECT *, list_filter([CASE WHEN least(w, h) < 4 OR w * h / (iw * ih) < 1e-4 THEN 'TINY' END, CASE WHEN w * h / (iw * ih) > 0.25 THEN 'LARGE' END,
  CASE WHEN least(x / iw, y / ih, (iw - x - w) / iw, (ih - y - h) / ih) <= 0.01 THEN 'BOUNDARY' END, CASE WHEN greatest(w / h, h / w) >= 10 THEN 'THIN_ASPECT' END], lambda v: v IS NOT NULL) AS flags FROM b)"""


@registry.query(_FLAG_SQL + " SELECT l_orderkey, l_linenumber, array_to_string(flags, ';') AS flags FROM f WHERE len(flags) > 0")
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = boxes.outlier_flags(F.col("bbox"), F.col("width"), F.col("height"))
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(flags, ";").alias("flags")).where("flags <> ''")


@registry.query(_FLAG_SQL + " SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM f) GROUP BY 1")
def flag_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(_boxes(spark, sf_dir).withColumn("flags", boxes.outlier_flags(F.col("bbox"), F.col("width"), F.col("height"))), "flags")


@registry.query(f"""WITH {_BOX_SQL}, r AS (
  SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY w * h, least(w, h), l_orderkey, l_linenumber) AS r1, row_number() OVER (ORDER BY greatest(w / h, h / w) DESC, l_orderkey, l_linenumber) AS r2,
    row_number() OVER (ORDER BY w / iw DESC, l_orderkey, l_linenumber) AS r3, row_number() OVER (ORDER BY least(x / iw, y / ih, (iw - x - w) / iw, (ih - y - h) / ih), l_orderkey, l_linenumber) AS r4 FROM b)
SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN r1 <= 20 THEN 'SMALLEST' END, CASE WHEN r2 <= 20 THEN 'THINNEST' END, CASE WHEN r3 <= 10 THEN 'WIDEST' END, CASE WHEN r4 <= 10 THEN 'BOUNDARY' END], lambda v: v IS NOT NULL), ';') AS reasons
FROM r WHERE r1 <= 20 OR r2 <= 20 OR r3 <= 10 OR r4 <= 10""")
def topk_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("bbox")[2], F.col("bbox")[3]
    gap = boxes.edge_gap(F.col("bbox"), F.col("width"), F.col("height"))
    rankings = {"SMALLEST": (20, [w * h, F.least(w, h)]), "THINNEST": (20, [F.greatest(w / h, h / w).desc()]), "WIDEST": (10, [(w / F.col("width")).desc()]), "BOUNDARY": (10, [gap])}
    return audit.top_with_reasons(_boxes(spark, sf_dir), rankings, ["l_orderkey", "l_linenumber"])


@registry.query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) ORDER BY r, event_type LIMIT 100")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.round_robin(table(spark, sf_dir, "events"), "event_type", [F.desc("value"), F.col("event_id")], 100).select("event_id", "event_type")


@registry.query("SELECT event_type, event_id, CAST(r AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r <= 5")
def first_n_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.first_per_class(table(spark, sf_dir, "events"), "event_type", [F.col("ts"), F.col("event_id")], 5).select("event_type", "event_id", "rank_no")


@registry.query("SELECT count(*) AS n, least(40, (SELECT count_if(value > 90) FROM events)) AS flagged, least(40, (SELECT count_if(value > 90) FROM events)) AS flagged_again, count(*) AS distinct_rows FROM (SELECT * FROM events LIMIT 40)")
def flagged_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows first, in a seeded order; SQL can't have that hash, but knows how many of the sample are flagged, and that another seed has as many."""
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce(F.col("value") > 90, F.lit(False)).alias("flagged"))
    one, other = (audit.flagged_first(rows, "flagged", "event_id", 40, seed) for seed in (42, 43))
    count = one.agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"), F.count_distinct("event_id").alias("distinct_rows"))
    return count.join(F.broadcast(other.agg(F.count_if("flagged").alias("flagged_again")))).select("n", "flagged", "flagged_again", "distinct_rows")  # a row each


@registry.query("""SELECT page, place, event_id FROM (SELECT event_id, CAST((row_number() OVER (ORDER BY value DESC, event_id) - 1) // 12 AS INTEGER) AS page, CAST((row_number() OVER (ORDER BY value DESC, event_id) - 1) % 12 AS INTEGER) AS place
FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 60))""")
def sheet_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("falling", -F.col("value"))
    return audit.pages(events, ["falling", "event_id"], 12, 60).select("page", "place", "event_id")


@registry.query("""WITH m(event_type, class_id, class_name) AS (VALUES ('click', 0, 'acne'), ('purchase', 1, 'wrinkle'), ('view', 2, 'dark_spot'))
SELECT class_id, class_name, count(*) AS n FROM events JOIN m USING (event_type) GROUP BY ALL""")
def category_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("click", 0, "acne"), ("purchase", 1, "wrinkle"), ("view", 2, "dark_spot")], "source_name string, class_id int, class_name string")
    return preparation.map_classes(table(spark, sf_dir, "events"), "event_type", mapping).groupBy("class_id", "class_name").agg(F.count("*").alias("n"))


@registry.query("SELECT composition, count(*) AS n FROM (SELECT user_id, string_agg(DISTINCT event_type, ' + ' ORDER BY event_type) AS composition FROM events GROUP BY user_id) GROUP BY 1")
def user_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.composition(table(spark, sf_dir, "events"), "user_id", "event_type")


@registry.query("SELECT CAST(day AS VARCHAR) AS day, total FROM (SELECT CAST(ts AS DATE) AS day, round(sum(value), 6) AS total FROM events GROUP BY 1) ORDER BY total DESC, day LIMIT 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 6).alias("total"))
    return evaluation.best_epoch(days, "total", "day")


@registry.query("""SELECT c.c_custkey, count(o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1""")
def left_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents keep their place without children."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["orders"])


@registry.query("SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS number FROM orders")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.numbered(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", ["o_orderkey"]).select("o_orderstatus", "o_orderkey", F.col("number").cast("bigint"))


def _print(e: Column) -> Column:
    return scalars.dhash_bits(e, 63)


_PRINT_SQL = "p AS (SELECT vec_id, CAST(list_sum([CASE WHEN embedding[k + 2] > embedding[k + 1] THEN CAST(1 AS BIGINT) << k ELSE 0 END FOR k IN range(0, 63)]) AS BIGINT) AS d, embedding AS e FROM embeddings)"


@registry.query(f"WITH {_PRINT_SQL} SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.d, y.d)) AS INTEGER) AS hamming FROM p x JOIN p y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.d, y.d)) <= 16")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs at 16 bits, beyond what bands can tell apart."""
    prints = table(spark, sf_dir, "embeddings").select("vec_id", _print(F.col("embedding")).alias("d"))
    return near.all_pairs(prints, "vec_id", "d", 16)


@registry.query(f"""WITH {_PRINT_SQL} SELECT x.vec_id AS a, y.vec_id AS b, round(sqrt(list_sum([(x.e[k] - y.e[k]) ** 2 FOR k IN range(1, 65)]) / 64), 4) AS rmse FROM p x JOIN p y ON x.vec_id < y.vec_id
WHERE bit_count(xor(x.d, y.d)) <= 20 AND sqrt(list_sum([(x.e[k] - y.e[k]) ** 2 FOR k IN range(1, 65)]) / 64) <= 0.14""")
def rmse_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs, first by bits, then by thumbnail."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = near.all_pairs(vectors.withColumn("d", _print(F.col("embedding"))), "vec_id", "d", 20)
    side = lambda k, v: vectors.select(F.col("vec_id").alias(k), F.col("embedding").alias(v))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").withColumn("rmse", scalars.rmse(F.col("x"), F.col("y")))
    return both.where("rmse <= 0.14").select("a", "b", F.round("rmse", 4).alias("rmse"))


@registry.query(f"WITH {_PRINT_SQL} SELECT x.vec_id AS query, y.vec_id AS key, CAST(bit_count(xor(x.d, y.d)) AS INTEGER) AS hamming FROM p x JOIN p y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0 AND bit_count(xor(x.d, y.d)) <= 22")
def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches at 22 bits, beyond what bands can tell apart: every record whose id is divisible by 100 against all."""
    prints = table(spark, sf_dir, "embeddings").select("vec_id", _print(F.col("embedding")).alias("d"))
    return near.search(prints, prints.where("vec_id % 100 = 0"), "vec_id", "d", 22)


@registry.query(f"""WITH {_PRINT_SQL} SELECT x.vec_id AS query, y.vec_id AS key, round(sqrt(list_sum([(x.e[k] - y.e[k]) ** 2 FOR k IN range(1, 65)]) / 64), 4) AS rmse FROM p x JOIN p y ON x.vec_id <> y.vec_id
WHERE x.vec_id % 100 = 0 AND bit_count(xor(x.d, y.d)) <= 26 AND sqrt(list_sum([(x.e[k] - y.e[k]) ** 2 FOR k IN range(1, 65)]) / 64) <= 0.17""")
def rmse_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, first by bits, then by thumbnail."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").withColumn("d", _print(F.col("embedding")))
    pairs = near.search(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "d", 26)
    side = lambda k, v: vectors.select(F.col("vec_id").alias(k), F.col("embedding").alias(v))
    both = pairs.join(side("query", "x"), "query").join(side("key", "y"), "key").withColumn("rmse", scalars.rmse(F.col("x"), F.col("y")))
    return both.where("rmse <= 0.17").select("query", "key", F.round("rmse", 4).alias("rmse"))
