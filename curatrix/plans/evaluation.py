"""Detections scored against the label boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators import evaluation as ev
from ..stage import table
from . import inputs
from .registry import Registry

registry = Registry()
LOOSE = 0.1  # so that these data have matches enough; 0.5 is the default elsewhere

_BASE = f"WITH RECURSIVE {inputs.TRUTH}, {inputs.PREDICTIONS}"
_IOU = """, near AS (SELECT *, inter / (ap + at_ - inter) AS iou FROM (SELECT p.image, p.class_id AS pc, t.class_id AS tc, p.pred, p.conf, t.truth,
  greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS inter, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (t.x2 - t.x1) * (t.y2 - t.y1) AS at_
  FROM pred p JOIN truth t USING (image)) WHERE ap + at_ - inter > 0)"""


def _greedy(least: float, key: str, order: str, where: str = "true") -> str:
    return f"""{_IOU}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM near WHERE iou >= {least} AND {where}),
walk AS (SELECT {key}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS ts, false AS taken, CAST(NULL AS BIGINT) AS pred, CAST(NULL AS BIGINT) AS truth FROM (SELECT DISTINCT {key} FROM ranked)
  UNION ALL SELECT {", ".join("r." + c.strip() for c in key.split(","))}, r.k, CASE WHEN list_contains(w.ps, r.pred) OR list_contains(w.ts, r.truth) THEN w.ps ELSE list_append(w.ps, r.pred) END,
    CASE WHEN list_contains(w.ps, r.pred) OR list_contains(w.ts, r.truth) THEN w.ts ELSE list_append(w.ts, r.truth) END, NOT (list_contains(w.ps, r.pred) OR list_contains(w.ts, r.truth)), r.pred, r.truth
  FROM walk w JOIN ranked r ON {" AND ".join(f"w.{c.strip()} = r.{c.strip()}" for c in key.split(","))} AND r.k = w.k + 1),
hit AS (SELECT {key}, pred, truth FROM walk WHERE taken)"""


_CLASS = _BASE + _greedy(LOOSE, "image, pc", "conf DESC, pred, iou DESC, truth", "pc = tc") + ", flag AS (SELECT p.*, h.pred IS NOT NULL AS tp FROM pred p LEFT JOIN hit h ON h.image = p.image AND h.pc = p.class_id AND h.pred = p.pred)"
_SPATIAL = _BASE + _greedy(LOOSE, "image", "iou DESC, truth, pred")


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    truth = inputs.truth(spark, sf_dir)
    return ev.flags(inputs.predictions(spark, sf_dir), truth, LOOSE), truth


@registry.query(_BASE + _greedy(0.5, "image, pc", "conf DESC, pred, iou DESC, truth", "pc = tc") + " SELECT image, pc AS class_id, pred, truth FROM hit")
def match_class_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.match_by_class(inputs.predictions(spark, sf_dir), inputs.truth(spark, sf_dir)).select("image", "class_id", "pred", "truth")


@registry.query(_CLASS + " SELECT image, pc AS class_id, pred, truth FROM hit")
def match_class_aware_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.match_by_class(inputs.predictions(spark, sf_dir), inputs.truth(spark, sf_dir), LOOSE).select("image", "class_id", "pred", "truth")


@registry.query(_SPATIAL + " SELECT image, pred, truth FROM hit")
def match_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.match_spatial(inputs.predictions(spark, sf_dir), inputs.truth(spark, sf_dir), LOOSE).select("image", "pred", "truth")


_PRF = """, c AS (SELECT DISTINCT class_id FROM category_names WHERE class_id IS NOT NULL), n AS (SELECT c.class_id, (SELECT count(*) FROM flag f WHERE f.class_id = c.class_id AND tp) AS tp, (SELECT count(*) FROM flag f WHERE f.class_id = c.class_id AND NOT tp) AS fp,
  (SELECT count(*) FROM truth t WHERE t.class_id = c.class_id) AS support FROM c),
s AS (SELECT class_id, CAST(sum(support) AS BIGINT) AS support, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM n GROUP BY GROUPING SETS ((class_id), ())),
r AS (SELECT *, support - tp AS fn, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS q FROM s)
SELECT coalesce(class_id, -1) AS class_id, support, tp, fp, fn, round(p, 9) AS precision, round(q, 9) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 9) AS f1 FROM r"""


@registry.query(_CLASS + _PRF)
def prf1_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class and, as class -1, all together."""
    flagged, truth = _flagged(spark, sf_dir)
    classes = table(spark, sf_dir, "category_names").where("class_id IS NOT NULL").select("class_id").distinct()
    scores = ev.per_class(flagged, truth, classes)
    return scores.select(F.coalesce("class_id", F.lit(-1)).alias("class_id"), "support", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@registry.query(
    _CLASS
    + " SELECT coalesce(a.image, b.image) AS image, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(support, 0) - coalesce(tp, 0) AS fn FROM (SELECT image, CAST(count_if(tp) AS BIGINT) AS tp, CAST(count_if(NOT tp) AS BIGINT) AS fp FROM flag GROUP BY 1) a FULL JOIN (SELECT image, count(*) AS support FROM truth GROUP BY 1) b ON a.image = b.image"
)
def per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.per_image(*_flagged(spark, sf_dir))


_POINTS = [k / 20 for k in range(20)]


@registry.query(
    _CLASS
    + f""", t AS (SELECT unnest({_POINTS}) AS threshold), k AS (SELECT class_id FROM flag UNION SELECT class_id FROM truth UNION ALL SELECT NULL),
x AS (SELECT k.class_id, threshold, (SELECT count(*) FROM flag f WHERE (f.class_id = k.class_id OR k.class_id IS NULL) AND conf >= threshold) AS n, (SELECT count(*) FROM flag f WHERE (f.class_id = k.class_id OR k.class_id IS NULL) AND conf >= threshold AND tp) AS tp,
  (SELECT count(*) FROM truth r WHERE r.class_id = k.class_id OR k.class_id IS NULL) AS support FROM k CROSS JOIN t)
SELECT coalesce(class_id, -1) AS class_id, CAST(threshold AS DOUBLE) AS threshold, n, tp, round(coalesce(tp / nullif(n, 0), 0), 9) AS precision, round(coalesce(tp / nullif(support, 0), 0), 9) AS recall FROM x"""
)
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged, truth = _flagged(spark, sf_dir)
    return ev.curve(flagged, truth, _POINTS).select(F.coalesce("class_id", F.lit(-1)).alias("class_id"), "threshold", "n", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_CONF = """, m AS (SELECT class_id AS pred_class, CASE WHEN tp THEN class_id ELSE -1 END AS true_class FROM flag UNION ALL
  SELECT -1, t.class_id FROM truth t LEFT JOIN hit h ON h.image = t.image AND h.pc = t.class_id AND h.truth = t.truth WHERE h.truth IS NULL)"""


@registry.query(_CLASS + _CONF + " SELECT pred_class, true_class, count(*) AS n FROM m GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_by_class(*_flagged(spark, sf_dir))


@registry.query(_CLASS + _CONF + " SELECT pred_class, true_class, n, round(n / sum(n) OVER (PARTITION BY true_class), 9) AS share FROM (SELECT pred_class, true_class, count(*) AS n FROM m GROUP BY ALL)")
def confusion_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.column_shares(ev.confusion_by_class(*_flagged(spark, sf_dir))).withColumn("share", F.round("share", 9))


_SCONF = """, m AS (SELECT p.class_id AS pred_class, t.class_id AS true_class FROM hit h JOIN pred p ON p.pred = h.pred AND p.image = h.image JOIN truth t ON t.truth = h.truth AND t.image = h.image UNION ALL
  SELECT -1, t.class_id FROM truth t WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.truth = t.truth AND h.image = t.image) UNION ALL SELECT p.class_id, -1 FROM pred p WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.pred = p.pred AND h.image = p.image))"""


@registry.query(_SPATIAL + _SCONF + " SELECT pred_class, true_class, count(*) AS n FROM m GROUP BY ALL")
def confusion_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion_spatial(inputs.predictions(spark, sf_dir), inputs.truth(spark, sf_dir), LOOSE)


@registry.query(
    _SPATIAL
    + _SCONF
    + " SELECT k.c AS pred_class, "
    + ", ".join(f"CAST(count(*) FILTER (WHERE m.true_class = {c}) AS BIGINT) AS {n}" for c, n in ((0, "t0"), (1, "t1"), (2, "t2"), (3, "t3"), (-1, "t_background")))
    + " FROM (SELECT unnest([0, 1, 2, 3, -1]) AS c) k LEFT JOIN m ON m.pred_class = k.c GROUP BY 1"
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.matrix(confusion_spatial(spark, sf_dir), list(inputs.CLASSES))


@registry.query(f"WITH {inputs.PREDICTIONS} SELECT image, count(*) AS n FROM pred GROUP BY 1 HAVING count(*) > 300")
def crowded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.crowded_images(inputs.predictions(spark, sf_dir))


@registry.query("SELECT count(*) AS n FROM (SELECT DISTINCT prediction_id, confidence FROM canonical_predictions WHERE NOT coalesce(confidence BETWEEN 0 AND 1, false) OR NOT coalesce(isfinite(x1) AND isfinite(y1) AND isfinite(x2) AND isfinite(y2), false))")
def invalid_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "canonical_predictions").withColumn("conf", F.col("confidence"))
    return ev.invalid_predictions(p).select("prediction_id", "confidence").distinct().agg(F.count("*").alias("n"))


@registry.query(f"WITH {inputs.IMAGES}, {inputs.PREDICTIONS}, a AS (SELECT DISTINCT image_id AS image FROM images), b AS (SELECT DISTINCT image FROM pred) SELECT coalesce(a.image, b.image) AS image, CASE WHEN b.image IS NULL THEN 'images' ELSE 'processed' END AS side FROM a FULL JOIN b ON a.image = b.image WHERE a.image IS NULL OR b.image IS NULL")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.incomplete(inputs.images(spark, sf_dir).select(F.col("image_id").alias("image")), inputs.predictions(spark, sf_dir))


@registry.query(f"WITH {inputs.PREDICTIONS} SELECT c.class_id, count(pred) AS n FROM (SELECT DISTINCT class_id FROM category_names WHERE class_id IS NOT NULL) c LEFT JOIN pred ON pred.class_id = c.class_id GROUP BY 1")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = table(spark, sf_dir, "category_names").where("class_id IS NOT NULL").select("class_id").distinct()
    return ev.class_histogram(inputs.predictions(spark, sf_dir), "class_id", classes)


@registry.query("SELECT prediction_id, confidence FROM (SELECT DISTINCT prediction_id, confidence, class_name FROM canonical_predictions WHERE confidence BETWEEN 0.25 AND 1) WHERE class_name = 'wrinkle'")
def confident_wrinkles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operating point: confidence of at least 0.25, inclusive."""
    p = table(spark, sf_dir, "canonical_predictions").where("confidence BETWEEN 0.25 AND 1 AND class_name = 'wrinkle'")
    return p.select("prediction_id", "confidence").distinct()


def _ap_sql(levels: list[int]) -> str:
    """Every overlap threshold (in hundredths) matched by recursion on its own, then the best precision at each of 101 recalls or beyond."""
    return f"""{_BASE}{_IOU}, lv AS (SELECT unnest({levels}) AS level), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, class_id ORDER BY conf DESC, pred) AS r FROM pred) WHERE r <= 300),
cand AS (SELECT n.image, n.pc, n.pred, n.conf, n.truth, n.iou, lv.level FROM near n JOIN top ON top.image = n.image AND top.class_id = n.pc AND top.pred = n.pred JOIN lv ON iou >= least(level / CAST(100 AS DOUBLE), 1 - 1e-10) WHERE pc = tc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image, pc, level ORDER BY conf DESC, pred, iou DESC, truth DESC) AS k FROM cand),
walk AS (SELECT image, pc, level, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS ts, false AS taken, CAST(NULL AS BIGINT) AS pred FROM (SELECT DISTINCT image, pc, level FROM ranked)
  UNION ALL SELECT r.image, r.pc, r.level, r.k, CASE WHEN list_contains(w.ps, r.pred) OR list_contains(w.ts, r.truth) THEN w.ps ELSE list_append(w.ps, r.pred) END,
    CASE WHEN list_contains(w.ps, r.pred) OR list_contains(w.ts, r.truth) THEN w.ts ELSE list_append(w.ts, r.truth) END, NOT (list_contains(w.ps, r.pred) OR list_contains(w.ts, r.truth)), r.pred
  FROM walk w JOIN ranked r ON w.image = r.image AND w.pc = r.pc AND w.level = r.level AND r.k = w.k + 1),
hit AS (SELECT image, pc, level, pred FROM walk WHERE taken), support AS (SELECT class_id, count(*) AS n FROM truth GROUP BY 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY conf DESC, image, pred) AS place FROM top),
marks AS (SELECT p.class_id, h.level, p.place, row_number() OVER (PARTITION BY p.class_id, h.level ORDER BY p.place) AS tp FROM placed p JOIN hit h ON h.image = p.image AND h.pc = p.class_id AND h.pred = p.pred),
pr AS (SELECT m.class_id, level, tp / CAST(s.n AS DOUBLE) AS r, tp / CAST(place AS DOUBLE) AS p FROM marks m JOIN support s USING (class_id)),
grid AS (SELECT s.class_id, lv.level, CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS least FROM support s CROSS JOIN lv CROSS JOIN (SELECT unnest(range(0, 101)) AS i)),
best AS (SELECT g.class_id, g.level, g.least, coalesce(max(pr.p), 0) AS p FROM grid g LEFT JOIN pr ON pr.class_id = g.class_id AND pr.level = g.level AND pr.r >= g.least GROUP BY ALL),
ap AS (SELECT class_id, level / CAST(100 AS DOUBLE) AS threshold, avg(p) AS ap FROM best GROUP BY ALL)"""


_STRICT, _LOOSE_LEVELS = list(range(50, 100, 5)), [10, 20, 30]
_MAP_SQL = """, per AS (SELECT class_id, avg(ap) FILTER (WHERE threshold = 0.5) AS map50, avg(ap) AS map50_95 FROM ap GROUP BY 1)
SELECT coalesce(class_id, -1) AS class_id, round(avg(map50), 9) AS map50, round(avg(map50_95), 9) AS map50_95 FROM per GROUP BY GROUPING SETS ((class_id), ())"""


@registry.query(_ap_sql(_STRICT) + " SELECT class_id, threshold, round(ap, 9) AS ap FROM ap")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP by class and overlap threshold."""
    return ev.average_precision(inputs.predictions(spark, sf_dir), inputs.truth(spark, sf_dir)).withColumn("ap", F.round("ap", 9))


@registry.query(_ap_sql(_LOOSE_LEVELS) + " SELECT class_id, threshold, round(ap, 9) AS ap FROM ap")
def average_precision_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at thresholds that these data reach more often."""
    return ev.average_precision(inputs.predictions(spark, sf_dir), inputs.truth(spark, sf_dir), thresholds=[k / 100 for k in _LOOSE_LEVELS]).withColumn("ap", F.round("ap", 9))


@registry.query(_ap_sql(_STRICT) + _MAP_SQL)
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ap = ev.average_precision(inputs.predictions(spark, sf_dir), inputs.truth(spark, sf_dir))
    return ev.mean_average_precision(ap).select(F.coalesce("class_id", F.lit(-1)).alias("class_id"), F.round("map50", 9).alias("map50"), F.round("map50_95", 9).alias("map50_95"))


_WITH_SECONDARY = f"""{_CLASS}, f1 AS (SELECT class_id, count(*) AS n, CAST(count_if(tp) AS BIGINT) AS tp FROM flag GROUP BY 1), s1 AS (SELECT class_id, count(*) AS support FROM truth GROUP BY 1)
SELECT s1.class_id, support, coalesce(n, 0) AS predictions, coalesce(tp, 0) AS tp, support - coalesce(tp, 0) AS fn FROM s1 LEFT JOIN f1 USING (class_id)"""


@registry.query(_WITH_SECONDARY)
def joined_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main figures of each class with its secondary ones."""
    flagged, truth = _flagged(spark, sf_dir)
    main = truth.groupBy("class_id").agg(F.count("*").alias("support"))
    second = flagged.groupBy("class_id").agg(F.count("*").alias("predictions"), F.count_if("tp").alias("tp"))
    return ev.with_secondary(main, second, ["class_id"]).fillna(0, ["predictions", "tp"]).withColumn("fn", F.col("support") - F.col("tp"))


@registry.query(f"""{_CLASS}, h AS (SELECT image, CAST(count_if(tp) AS BIGINT) AS tp FROM flag GROUP BY 1), i AS (SELECT image, min(class_id) AS lo, max(class_id) AS hi, coalesce(max(h.tp), 0) AS tp FROM truth LEFT JOIN h USING (image) GROUP BY 1),
a AS (SELECT min(image) AS image FROM i WHERE tp > 0), b AS (SELECT min(image) AS image FROM i WHERE tp = 0 AND image NOT IN (SELECT image FROM a WHERE image IS NOT NULL)),
c AS (SELECT min(image) AS image FROM i WHERE lo < hi AND image NOT IN (SELECT image FROM a WHERE image IS NOT NULL UNION SELECT image FROM b WHERE image IS NOT NULL))
SELECT * FROM (SELECT 'HIT' AS rule, image FROM a UNION ALL SELECT 'MISSED', image FROM b UNION ALL SELECT 'SEVERAL_CLASSES', image FROM c) WHERE image IS NOT NULL""")
def example_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule the first image that no rule before it took."""
    flagged, truth = _flagged(spark, sf_dir)
    hits = flagged.groupBy("image").agg(F.count_if("tp").alias("tp"))
    images = truth.groupBy("image").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).join(hits, "image", "left").fillna(0, ["tp"])
    rules = [("HIT", F.col("tp") > 0, []), ("MISSED", F.col("tp") == 0, []), ("SEVERAL_CLASSES", F.col("lo") < F.col("hi"), [])]
    return audit.first_unused(images, rules, "image")
