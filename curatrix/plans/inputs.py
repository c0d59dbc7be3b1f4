"""The test tables as the operators take them, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, names, scalars
from ..stage import table

CLASSES = (0, 1, 2, 3)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, file_name, stem, split, width, height, sha, dhash, source) with each image once; split null where it isn't known."""
    i = table(spark, sf_dir, "source_images")
    return i.select(
        "image_id", names.bare_name(F.col("file_name")).alias("file_name"), names.stem(F.col("file_name")).alias("stem"), names.split_name(F.col("split")).alias("split"),
        "width", "height", names.sha_digits(F.col("sha256")).alias("sha"), "dhash", F.col("dataset_source").alias("source"), "original_categories",
    ).distinct()


IMAGES = """images AS (SELECT DISTINCT image_id, file_name, regexp_extract(file_name, '^(.+)[.][^.]*$', 1) AS stem,
  CASE WHEN split = 'valid' THEN 'val' ELSE split END AS split, width, height, nullif(regexp_extract(lower(sha256), '([0-9a-f]{64})', 1), '') AS sha, dhash, dataset_source AS source, original_categories FROM source_images)"""


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, split, name, class_id): the source categories of each image, each once."""
    plain = names.plain_words
    known = table(spark, sf_dir, "category_names").select("name", "class_id", plain(F.col("name")).alias("plain"))
    words = images(spark, sf_dir).select("image_id", "split", F.explode(F.split("original_categories", "[;,]")).alias("word"))
    return words.select("image_id", "split", plain(F.col("word")).alias("plain")).join(F.broadcast(known), "plain").select("image_id", "split", "name", "class_id").distinct()  # a fixed list


CATEGORIES = """cat AS (SELECT DISTINCT image_id, split, name, class_id FROM (SELECT image_id, split, unnest(string_split_regex(original_categories, '[;,]')) AS word FROM images) w
  JOIN category_names n ON trim(regexp_replace(lower(n.name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(word), '[^a-z0-9]+', ' ', 'g')))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, class_id, conf, pred, corners) of canonical predictions with a proper score, each once."""
    p = table(spark, sf_dir, "canonical_predictions").where("image_id IS NOT NULL AND class_id IS NOT NULL AND confidence BETWEEN 0 AND 1")
    return p.select(F.col("image_id").alias("image"), "class_id", F.col("confidence").alias("conf"), F.col("prediction_id").alias("pred"), "x1", "y1", "x2", "y2").distinct()


PREDICTIONS = """pred AS (SELECT DISTINCT image_id AS image, class_id, confidence AS conf, prediction_id AS pred, x1, y1, x2, y2 FROM canonical_predictions
  WHERE image_id IS NOT NULL AND class_id IS NOT NULL AND confidence BETWEEN 0 AND 1)"""


def label_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_id, stem, class_id, four shares) of lines with five numbers, a known class, shares within 0..1 and an area; quotes aren't understood here."""
    part = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    fields = {n: scalars.strict_double(F.try_element_at(part, F.lit(k))) for k, n in enumerate(("x_center", "y_center", "w", "h"), 2)}
    lines = table(spark, sf_dir, "label_lines").select("line_id", "label_file", "line").distinct()
    rows = lines.select("line_id", names.stem(F.col("label_file")).alias("stem"), F.size(part).alias("n"), scalars.strict_int(F.try_element_at(part, F.lit(1))).cast("int").alias("class_id"), *(v.alias(k) for k, v in fields.items()))
    ok = F.col("n") == 5
    for n in fields:
        ok = ok & F.col(n).between(0, 1)
    return rows.where(ok & F.col("class_id").between(0, 3) & (F.col("w") > 0) & (F.col("h") > 0)).drop("n")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, class_id, truth, corners in pixels) of label boxes of known images."""
    i = images(spark, sf_dir).select(F.col("image_id").alias("image"), "stem", "width", "height")
    corners = boxes.center_to_corners(*(F.col(c) for c in ("x_center", "y_center", "w", "h", "width", "height")))
    return label_boxes(spark, sf_dir).join(i, "stem").select("image", "class_id", F.col("line_id").alias("truth"), *(c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"))))


LABELS = r"""lab AS (SELECT * FROM (SELECT line_id, stem, try_cast(f[1] AS BIGINT) AS class_id, try_cast(f[2] AS DOUBLE) AS x_center, try_cast(f[3] AS DOUBLE) AS y_center, try_cast(f[4] AS DOUBLE) AS w, try_cast(f[5] AS DOUBLE) AS h
  FROM (SELECT DISTINCT line_id, regexp_extract(regexp_extract(label_file, '([^/\\]*)$', 1), '^(.+)[.][^.]*$', 1) AS stem, string_split_regex(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS f FROM label_lines)
  WHERE len(f) = 5 AND regexp_full_match(f[1], '[+-]?[0-9]+') AND len(list_filter(f[2:5], lambda x: NOT regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'))) = 0)
  WHERE class_id BETWEEN 0 AND 3 AND x_center BETWEEN 0 AND 1 AND y_center BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1 AND w > 0 AND h > 0)"""
TRUTH = (
    IMAGES
    + ",\n"
    + LABELS
    + """,
truth AS (SELECT image_id AS image, CAST(class_id AS INTEGER) AS class_id, line_id AS truth, (x_center - w / 2) * width AS x1, (y_center - h / 2) * height AS y1, (x_center + w / 2) * width AS x2, (y_center + h / 2) * height AS y2 FROM lab JOIN images USING (stem))"""
)


def review_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) of pairs judged to have the same source, as bare file names."""
    r = table(spark, sf_dir, "duplicate_review").where("lower(trim(likely_same_source)) = 'yes'")
    return r.select(names.bare_name(F.col("file_a")).alias("a"), names.bare_name(F.col("file_b")).alias("b")).where("a <> b")


LINKS = r"""links AS (SELECT DISTINCT a, b FROM (SELECT trim(regexp_replace(file_a, '^.*[/\\]', '')) AS a, trim(regexp_replace(file_b, '^.*[/\\]', '')) AS b FROM duplicate_review WHERE lower(trim(likely_same_source)) = 'yes') WHERE a <> b AND a <> '' AND b <> '')"""
COMPONENTS = (
    LINKS
    + """,
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS n, a AS m FROM edges UNION SELECT e.b, r.m FROM reach r JOIN edges e ON e.a = r.n),
comp AS (SELECT n AS file_name, min(m) AS root FROM reach GROUP BY n)"""
)
