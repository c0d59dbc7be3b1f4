"""Tables written as the files that people and trainers use, read again, and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, names
from ..sources import coco, files, labels, tabular
from ..stage import new_path, table
from . import inputs
from .registry import Registry

registry = Registry()
_I, _L = inputs.IMAGES, inputs.LABELS


@registry.query("SELECT likely_same_source, human_decision, count(*) AS n, count(notes) AS notes, CAST(sum(dhash_distance) AS BIGINT) AS bits FROM (SELECT * REPLACE (nullif(notes, '') AS notes, nullif(likely_same_source, '') AS likely_same_source, nullif(human_decision, '') AS human_decision) FROM duplicate_review) GROUP BY 1, 2")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review table as CSV, written with a count of what is read back; CSV doesn't tell an empty text from none."""
    review = table(spark, sf_dir, "duplicate_review")
    path = new_path(spark, "review-csv")
    tabular.write_checked(review.select(*(c.split(" ")[0] for c in tabular.REVIEW.split(", "))), path, tabular.REVIEW)
    empty = lambda c: F.nullif(c, F.lit("")).alias(c)
    back = tabular.read_csv(spark, path, tabular.REVIEW).select(empty("likely_same_source"), empty("human_decision"), empty("notes"), "dhash_distance")
    return back.groupBy("likely_same_source", "human_decision").agg(F.count("*").alias("n"), F.count("notes").alias("notes"), F.sum("dhash_distance").alias("bits"))


def _held_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Images of val and test, and their label boxes by class and place."""
    i = inputs.images(spark, sf_dir).where("split IN ('val', 'test')").select("split", "image_id", "file_name", "stem", "width", "height").distinct()
    return i, inputs.label_boxes(spark, sf_dir).join(i.select("split", "image_id", "stem"), "stem")


@registry.query(f"""WITH {_I}, {_L}, i AS (SELECT split, image_id, stem FROM images WHERE split IN ('val', 'test'))
SELECT split, count(DISTINCT image_id) AS images, count(line_id) AS annotations, CAST(count(DISTINCT image_id) FILTER (WHERE line_id IS NULL) AS BIGINT) AS negatives, CAST(coalesce(sum(class_id), 0) AS BIGINT) AS class_sum FROM i LEFT JOIN lab USING (stem) GROUP BY 1""")
def coco_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The held-out splits as documents, one each, written and read again, with the annotations of each image."""
    i, b = _held_out(spark, sf_dir)
    images = i.select("split", F.col("image_id").alias("id"), "file_name", "width", "height")
    box = F.array("x_center", "y_center", "w", "h")
    annotations = b.select("split", F.col("line_id").alias("id"), "image_id", F.col("class_id").alias("category_id"), box.alias("bbox"))
    classes = table(spark, sf_dir, "category_names").where("class_id IS NOT NULL").select(F.col("class_id").alias("id"), F.col("class_name").alias("name")).distinct()
    categories = classes.crossJoin(spark.createDataFrame([("val",), ("test",)], "split string"))  # a class list, twice
    paths = {}
    for split in ("val", "test"):
        paths[split] = new_path(spark, f"coco-{split}")
        coco.document(images, annotations, categories, split).coalesce(1).write.text(paths[split])
    back = coco.read(spark, paths)
    both = coco.with_annotations(back["images"], back["annotations"])
    sums = F.aggregate("items", F.lit(0).cast("bigint"), lambda t, x: t + x["category_id"])
    return both.groupBy("split").agg(F.count("*").alias("images"), F.sum(F.size("items")).cast("bigint").alias("annotations"), F.count_if(F.size("items") == 0).alias("negatives"), F.sum(sums).alias("class_sum"))


@registry.query(f"""WITH {_I}, {_L}, i AS (SELECT DISTINCT split, stem FROM images WHERE split = 'test'), o AS (SELECT stem, count(*) AS n FROM lab GROUP BY 1)
SELECT count(*) AS files, CAST(count_if(n IS NULL) AS BIGINT) AS empty_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS lines, CAST(0 AS BIGINT) AS changed FROM i LEFT JOIN o USING (stem)""")
def label_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of the test split written for its images, listed, copied with their hashes and read again."""
    i, b = _held_out(spark, sf_dir)
    text = F.concat_ws(" ", "class_id", "x_center", "y_center", "w", "h")
    rows = b.where("split = 'test'").select("split", "stem", F.col("line_id").alias("position"), text.alias("line"))
    root, copies = (new_path(spark, n).removeprefix("file://") for n in ("labels", "copies"))
    labels.write(labels.contents(rows, i.where("split = 'test'").select("split", "stem")), root)
    before = files.manifest(spark, root)
    files.copy_files(before, root, copies).write.format("noop").mode("overwrite").save()
    listed = files.listing(spark, copies, [".txt"]).agg(F.count("*").alias("files"), F.count_if(F.col("size") == 0).alias("empty_files"))
    changed = files.manifest_changes(before, files.manifest(spark, copies)).agg(F.count("*").alias("changed"))
    lines = labels.read(spark, copies).select(names.stem(F.col("path")).alias("stem"), "line").agg(F.count("*").alias("lines"))
    return listed.join(lines).join(changed).select("files", "empty_files", "lines", "changed")  # a row each


@registry.query(f"""WITH {_I}, {_L}, b AS (SELECT image_id, class_id, line_id, (x_center - w / 2) * width AS x1, (y_center - h / 2) * height AS y1, w * width AS bw, h * height AS bh, width, height FROM lab JOIN images USING (stem))
SELECT class_id, count(*) AS boxes, round(avg(bw), 6) AS width_px, round(avg(bh), 6) AS height_px, round(avg(bw * bh / (width * height)), 9) AS area_norm, round(avg((x1 + bw + x1) / 2), 6) AS center_px FROM b GROUP BY 1""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean measures of the boxes of each class, by way of both box forms."""
    t = inputs.truth(spark, sf_dir).join(inputs.images(spark, sf_dir).select(F.col("image_id").alias("image"), "width", "height"), "image")
    box = boxes.corners_to_xywh(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    corners = boxes.xywh_to_corners(box)
    m = boxes.measures(box, F.col("width"), F.col("height"))
    each = t.select("class_id", m["width_px"].alias("w"), m["height_px"].alias("h"), m["area_norm"].alias("a"), ((corners[0] + corners[2]) / 2).alias("c"))
    return each.groupBy("class_id").agg(F.count("*").alias("boxes"), F.round(F.avg("w"), 6).alias("width_px"), F.round(F.avg("h"), 6).alias("height_px"), F.round(F.avg("a"), 9).alias("area_norm"), F.round(F.avg("c"), 6).alias("center_px"))
