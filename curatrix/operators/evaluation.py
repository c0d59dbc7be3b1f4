"""Scoring detections: matching, precision and recall, curves, confusion, average precision.

Predictions have (image, class_id, conf, pred, x1, y1, x2, y2), truth (image, class_id, truth, x1, y1, x2, y2); `pred` and `truth` are numbers that order
ties. Candidates, that is overlaps of at least the threshold, are found by a join on the image; only they are gathered, in one array an image
(and class), over which a fold keeps what is used. An image with a tenth of all predictions has no more candidates than its true boxes overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, scalars
from ..stage import as_list

BOX = ("x1", "y1", "x2", "y2")


def candidates(pred: DataFrame, truth: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Pairs of one key with an overlap of at least `least`, inclusive."""
    p = pred.select(*keys, "conf", "pred", *([] if "class_id" in keys else [F.col("class_id").alias("pred_class")]), *(F.col(b).alias(f"p_{b}") for b in BOX))
    t = truth.select(*keys, "truth", *([] if "class_id" in keys else [F.col("class_id").alias("true_class")]), *(F.col(b).alias(f"t_{b}") for b in BOX))
    overlap = boxes.iou([F.col(f"p_{b}") for b in BOX], [F.col(f"t_{b}") for b in BOX])
    return p.join(t, keys).withColumn("iou", overlap).where(F.col("iou") >= least).drop(*(f"{s}_{b}" for s in "pt" for b in BOX))


def greedy(pairs: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """(keys, pred, truth, iou): pairs in order, each taken if neither end is used yet.

    With predictions first in the order and overlaps after, that gives each prediction, in turn, the unused true box with the largest overlap.
    """
    rank = [c.alias(f"o{k}") for k, c in enumerate(order)]
    lists = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rank, "pred", "truth", "iou"))).alias("c"))
    kind = dict(pairs.dtypes)
    start = F.struct(F.array().cast(f"array<{kind['pred']}>").alias("p"), F.array().cast(f"array<{kind['truth']}>").alias("t"), F.array().cast(f"array<struct<pred:{kind['pred']},truth:{kind['truth']},iou:double>>").alias("m"))

    def step(acc: Column, c: Column) -> Column:
        used = F.array_contains(acc["p"], c["pred"]) | F.array_contains(acc["t"], c["truth"])
        more = F.struct(c["pred"].alias("pred"), c["truth"].alias("truth"), c["iou"].alias("iou"))
        taken = F.struct(F.array_append(acc["p"], c["pred"]).alias("p"), F.array_append(acc["t"], c["truth"]).alias("t"), F.array_append(acc["m"], more).alias("m"))
        return F.when(used, acc).otherwise(taken)

    return lists.select(*keys, F.inline(F.aggregate("c", start, step)["m"]))


def match_by_class(pred: DataFrame, truth: DataFrame, least: float = 0.5, last_truth_wins: bool = False) -> DataFrame:
    """Class-aware matches: per image and class, by falling confidence, then `pred`; of equal overlaps the lowest `truth`, or the last if so asked."""
    tie = -F.col("truth") if last_truth_wins else F.col("truth")
    return greedy(candidates(pred, truth, ["image", "class_id"], least), ["image", "class_id"], [-F.col("conf"), F.col("pred"), -F.col("iou"), tie])


def match_spatial(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Class-agnostic matches, largest overlap first, then `truth`, then `pred`; with both classes."""
    pairs = candidates(pred, truth, ["image"], least)
    found = greedy(pairs, ["image"], [-F.col("iou"), F.col("truth"), F.col("pred")])
    return found.join(pairs.select("image", "pred", "truth", "pred_class", "true_class"), ["image", "pred", "truth"])


def flags(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """Predictions with `tp`, fixed once on all of them; thresholds may come later."""
    hit = match_by_class(pred, truth, least).select("image", "class_id", "pred", F.lit(True).alias("tp"))
    return pred.join(hit, ["image", "class_id", "pred"], "left").withColumn("tp", F.coalesce("tp", F.lit(False)))


def _scores(df: DataFrame) -> DataFrame:
    p, r = scalars.ratio(F.col("tp"), F.col("tp") + F.col("fp")), scalars.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", scalars.f1(F.col("precision"), F.col("recall")))


def per_class(flagged: DataFrame, truth: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, support, tp, fp, fn, precision, recall, f1) for every class of the list, and with class_id null for all of them together (micro)."""
    n = flagged.groupBy("class_id").agg(F.count_if("tp").alias("tp"), F.count_if(F.expr("NOT tp")).alias("fp"))
    s = truth.groupBy("class_id").agg(F.count("*").alias("support"))
    every = as_list(classes.select("class_id")).join(n, "class_id", "left").join(s, "class_id", "left").fillna(0, ["tp", "fp", "support"])  # a class list
    sums = every.groupingSets([["class_id"], []], "class_id").agg(*(F.sum(c).alias(c) for c in ("support", "tp", "fp")))
    return _scores(sums.withColumn("fn", F.col("support") - F.col("tp")))


def per_image(flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """(image, tp, fp, fn) of images with predictions or truth."""
    n = flagged.groupBy("image").agg(F.count_if("tp").alias("tp"), F.count_if(F.expr("NOT tp")).alias("fp"))
    s = truth.groupBy("image").agg(F.count("*").alias("support"))
    both = n.join(s, "image", "full").fillna(0, ["tp", "fp", "support"])
    return both.select("image", "tp", "fp", (F.col("support") - F.col("tp")).alias("fn"))


def curve(flagged: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """(class_id, threshold, n, tp, precision, recall), with class_id null for all classes: counts of predictions at or above each threshold.

    Each prediction counts once, for the highest threshold it reaches; sums over thresholds, as few as they are, do the rest.
    """
    spark = flagged.sparkSession
    points = sorted(set(thresholds))
    reached = F.aggregate(F.array(*map(F.lit, points)), F.lit(0), lambda n, t: n + (F.col("conf") >= t).cast("int"))
    n = flagged.withColumn("k", reached).where("k > 0").groupBy("class_id", "k").agg(F.count("*").alias("n"), F.count_if("tp").alias("tp"))
    s = truth.groupBy("class_id").agg(F.count("*").alias("support"))
    steps = F.broadcast(spark.createDataFrame(list(enumerate(points, 1)), "k int, threshold double"))
    classes = n.select("class_id").unionByName(s.select("class_id")).distinct()
    grid = classes.join(steps).join(n, ["class_id", "k"], "left").fillna(0, ["n", "tp"])  # classes by thresholds
    micro = grid.groupBy("k", "threshold").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp")).withColumn("class_id", F.lit(None).cast("int"))
    total = s.agg(F.sum("support").alias("support")).withColumn("class_id", F.lit(None).cast("int"))
    above = Window.partitionBy("class_id").orderBy(F.desc("k"))
    both = grid.unionByName(micro).withColumn("n", F.sum("n").over(above)).withColumn("tp", F.sum("tp").over(above))
    support = s.unionByName(total).withColumnRenamed("class_id", "c")
    joined = both.join(F.broadcast(support), F.col("class_id").eqNullSafe(F.col("c")), "left").fillna(0, ["support"])  # a row a class
    return joined.select("class_id", "threshold", "n", "tp", scalars.ratio(F.col("tp"), F.col("n")).alias("precision"), scalars.ratio(F.col("tp"), F.col("support")).alias("recall"))


BACKGROUND = -1


def confusion_by_class(flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """(pred_class, true_class, n): a class-aware match is a hit of its class, other predictions are on background, missed truth is background."""
    n = flagged.groupBy(F.col("class_id").alias("pred_class"), F.when(F.col("tp"), F.col("class_id")).otherwise(F.lit(BACKGROUND)).alias("true_class")).agg(F.count("*").alias("n"))
    hits = n.where("pred_class = true_class").select(F.col("true_class").alias("class_id"), F.col("n").alias("hits"))
    missed = truth.groupBy("class_id").agg(F.count("*").alias("support")).join(hits, "class_id", "left").fillna(0, ["hits"])
    rest = missed.select(F.lit(BACKGROUND).alias("pred_class"), F.col("class_id").alias("true_class"), (F.col("support") - F.col("hits")).alias("n")).where("n > 0")
    return n.unionByName(rest)


def confusion_spatial(pred: DataFrame, truth: DataFrame, least: float = 0.5) -> DataFrame:
    """(pred_class, true_class, n) of class-agnostic matches, unmatched truth and unmatched predictions."""
    m = match_spatial(pred, truth, least)
    matched = m.select("pred_class", "true_class")
    missed = truth.join(m.select("image", "truth"), ["image", "truth"], "left_anti").select(F.lit(BACKGROUND).alias("pred_class"), F.col("class_id").alias("true_class"))
    extra = pred.join(m.select("image", "pred"), ["image", "pred"], "left_anti").select(F.col("class_id").alias("pred_class"), F.lit(BACKGROUND).alias("true_class"))
    return matched.unionByName(missed).unionByName(extra).groupBy("pred_class", "true_class").agg(F.count("*").alias("n"))


def column_shares(confusion: DataFrame) -> DataFrame:
    """With `share`, of the column of the true class; 0 for an empty column. A matrix is as small as the classes are few."""
    return confusion.withColumn("share", scalars.ratio(F.col("n"), F.sum("n").over(Window.partitionBy("true_class"))))


def matrix(confusion: DataFrame, classes: list[int]) -> DataFrame:
    """The square form: a row a predicted class, a column `t<class>` a true one, background last as `t_background`; zeros included."""
    spark = confusion.sparkSession
    rows = spark.createDataFrame([(c,) for c in [*classes, BACKGROUND]], "pred_class int")
    wide = confusion.groupBy("pred_class").pivot("true_class", [*classes, BACKGROUND]).agg(F.sum("n"))
    named = wide.select("pred_class", *(F.col(f"`{c}`").alias("t_background" if c == BACKGROUND else f"t{c}") for c in [*classes, BACKGROUND]))
    return rows.join(F.broadcast(named), "pred_class", "left").fillna(0)  # as many rows as classes


def best_epoch(history: DataFrame, metric: str, epoch: str = "epoch") -> DataFrame:
    """The row with the largest value of the metric, the first such epoch."""
    return history.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double"))).orderBy(F.desc(metric), epoch).limit(1)


def crowded_images(pred: DataFrame, most: int = 300) -> DataFrame:
    """(image, n) of images with more predictions than a detector may give."""
    return pred.groupBy("image").agg(F.count("*").alias("n")).where(F.col("n") > most)


def invalid_predictions(pred: DataFrame) -> DataFrame:
    """Predictions with a coordinate that isn't finite or a score outside 0..1."""
    ok = F.coalesce(F.col("conf").between(0, 1), F.lit(False))
    for b in BOX:
        ok = ok & scalars.finite(F.col(b))
    return pred.where(~ok)


def incomplete(images: DataFrame, processed: DataFrame) -> DataFrame:
    """(image, side): images that only one of the two sets has."""
    a, b = images.select("image").distinct(), processed.select("image").distinct()
    return a.join(b, "image", "left_anti").withColumn("side", F.lit("images")).unionByName(b.join(a, "image", "left_anti").withColumn("side", F.lit("processed")))


def class_histogram(pred: DataFrame, column: str, classes: DataFrame) -> DataFrame:
    """(column, n) for every class of the list, zeros included."""
    n = pred.groupBy(column).agg(F.count("*").alias("n"))
    return as_list(classes.select(column)).join(n, column, "left").fillna(0, ["n"])


THRESHOLDS = [k / 100 for k in range(50, 100, 5)]
RECALL_POINTS = 101
SCORE_RANGES = 1024


def average_precision(pred: DataFrame, truth: DataFrame, most: int = 300, thresholds: list[float] | None = None) -> DataFrame:
    """(class_id, threshold, ap): interpolated over 101 recall points, boxes of any area, `most` best predictions of each image and class.

    Per threshold, predictions are matched by falling confidence to the unused true box of largest overlap, of equal ones the last. Ties of confidence go by
    image, then `pred`. Classes without truth have no row. Precision at a recall is the best at that recall or beyond.

    A prediction is one row whatever the number of thresholds: what it hits is a bit for each. A class may hold most rows, so ranges of the confidence,
    which lies in 0..1, are summed apart and shifted.
    """
    thresholds = thresholds or THRESHOLDS
    spark = pred.sparkSession
    best = Window.partitionBy("image", "class_id").orderBy(F.desc("conf"), "pred")
    top = pred.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most).drop("_r")
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.lit(t).alias("threshold")) for k, t in enumerate(thresholds)))).alias("l")
    near = candidates(top, truth, ["image", "class_id"], min(thresholds) - 1e-9)  # few beside all predictions
    near = near.select("*", levels).where("iou >= least(l.threshold, 1 - 1e-10)").select(*near.columns, "l.level")
    keys = ["image", "class_id", "level"]
    hits = greedy(near, keys, [-F.col("conf"), F.col("pred"), -F.col("iou"), -F.col("truth")])
    bits = hits.groupBy("image", "class_id", "pred").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("level"))).alias("hit"))
    every = top.select("image", "class_id", "pred", "conf").join(bits, ["image", "class_id", "pred"], "left")
    every = every.withColumn("part", -F.floor(F.col("conf") * SCORE_RANGES).cast("int")).fillna(0, ["hit"])
    hit = lambda k: (F.col("hit").bitwiseAND(1 << k) != 0).cast("long")
    tally = {"n": F.lit(1)} | {f"t{k}": hit(k) for k in range(len(thresholds))}
    by_part = Window.partitionBy("class_id").orderBy("part")  # at most SCORE_RANGES + 1 rows
    sums = every.groupBy("class_id", "part").agg(*(F.sum(c).alias(name) for name, c in tally.items()))
    before = sums.select("class_id", "part", *((F.sum(c).over(by_part) - F.col(c)).alias(f"b_{c}") for c in tally))
    inside = Window.partitionBy("class_id", "part").orderBy(F.desc("conf"), "image", "pred").rowsBetween(Window.unboundedPreceding, 0)
    ranked = every.select("class_id", "part", *(F.sum(c).over(inside).alias(name) for name, c in tally.items())).join(before, ["class_id", "part"])
    support = truth.groupBy("class_id").agg(F.count("*").alias("support"))
    ranked = ranked.join(F.broadcast(support), "class_id")  # a row a class
    recall = lambda k: (F.col(f"t{k}") + F.col(f"b_t{k}")) / F.col("support")
    precision = lambda k: (F.col(f"t{k}") + F.col(f"b_t{k}")) / (F.col("n") + F.col("b_n"))
    marks = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), recall(k).alias("r"), precision(k).alias("p")) for k in range(len(thresholds))))).alias("m")
    point = F.floor(F.col("r") * (RECALL_POINTS - 1)).cast("int")
    point = F.when(F.col("r") >= (point + 1) * 0.01, point + 1).when(F.col("r") < point * 0.01, point - 1).otherwise(point)
    peaks = ranked.select("class_id", marks).select("class_id", "m.*").groupBy("class_id", "level", point.alias("k")).agg(F.max("p").alias("p"))
    grid = spark.range(RECALL_POINTS).select(F.col("id").cast("int").alias("k")).join(F.broadcast(support.select("class_id"))).select("k", "class_id", levels)  # classes, points, thresholds
    beyond = Window.partitionBy("class_id", "level").orderBy(F.desc("k"))
    whole = grid.select("k", "class_id", "l.*").join(peaks, ["class_id", "level", "k"], "left").withColumn("p", F.coalesce(F.max("p").over(beyond), F.lit(0.0)))
    return whole.groupBy("class_id", "threshold").agg(F.avg("p").alias("ap"))


def with_secondary(main: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the main figures with those of the secondary ones that have the same keys; null where there are none. Names that both have are taken from the main ones."""
    more = secondary.select(*keys, *(c for c in secondary.columns if c not in main.columns))
    return main.join(more, keys, "left")


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """(class_id, map50, map50_95), with class_id null for the mean of the classes."""
    per = ap.groupBy("class_id").agg(F.avg(F.when(F.abs(F.col("threshold") - 0.5) < 1e-9, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95"))
    return per.groupingSets([["class_id"], []], "class_id").agg(F.avg("map50").alias("map50"), F.avg("map50_95").alias("map50_95"))
