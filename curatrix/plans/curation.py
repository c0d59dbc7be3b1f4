"""Preparation, audit, review and derivation over the curation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, names
from ..operators import audit, derivation, near, preparation, review, sets, validation
from ..sources import coco, labels
from ..stage import Stages, new_path, table
from . import inputs
from .registry import Registry

registry = Registry()
_I, _C, _L = inputs.IMAGES, inputs.CATEGORIES, inputs.LABELS


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "category_names").where("class_id IS NOT NULL").select("class_id", "class_name").distinct()


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inputs.images(spark, sf_dir).select("image_id", "split", "stem")
    return inputs.label_boxes(spark, sf_dir).join(i, "stem")


@registry.query(
    f"""WITH {_I}, {_L}, o AS (SELECT image_id, split, class_id FROM lab JOIN images USING (stem) WHERE split IS NOT NULL)
SELECT s.split, c.class_id, c.class_name, count(o.image_id) AS objects, count(DISTINCT o.image_id) AS images FROM (SELECT DISTINCT split FROM images WHERE split IS NOT NULL) s
CROSS JOIN (SELECT DISTINCT class_id, class_name FROM category_names WHERE class_id IS NOT NULL) c LEFT JOIN o ON o.split = s.split AND o.class_id = c.class_id GROUP BY ALL"""
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preparation.split_stats(inputs.images(spark, sf_dir).where("split IS NOT NULL"), _objects(spark, sf_dir), _classes(spark, sf_dir))


@registry.query(
    f"""WITH {_I}, {_C}, {_L}, k AS (SELECT image_id, count(line_id) AS kept FROM images LEFT JOIN lab USING (stem) GROUP BY 1), n AS (SELECT i.image_id, i.split, count(c.name) AS orig FROM images i LEFT JOIN cat c USING (image_id) GROUP BY ALL)
SELECT split, count(*) AS images, CAST(count_if(kept = 0) AS BIGINT) AS negatives, CAST(count_if(kept = 0 AND orig = 0) AS BIGINT) AS originally_empty, CAST(count_if(kept = 0 AND orig > 0) AS BIGINT) AS empty_after_filtering, CAST(sum(kept) AS BIGINT) AS objects
FROM n JOIN k USING (image_id) WHERE split IS NOT NULL GROUP BY 1"""
)
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    originals = inputs.categories(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("originals"))
    i = inputs.images(spark, sf_dir).where("split IS NOT NULL").select("image_id", "split").join(originals, "image_id", "left").fillna(0, ["originals"])
    return preparation.image_stats(i, _objects(spark, sf_dir), "originals")


@registry.query("""WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS plain, class_id FROM category_names),
p AS (SELECT DISTINCT prediction_id, trim(regexp_replace(lower(raw_class_name), '[^a-z0-9]+', ' ', 'g')) AS plain FROM canonical_predictions)
SELECT coalesce(class_id, -1) AS class_id, count(*) AS predictions FROM p LEFT JOIN n USING (plain) GROUP BY 1""")
def prediction_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by the class that their raw name stands for; -1 is out of scope."""
    plain = names.plain_words
    mapping = table(spark, sf_dir, "category_names").where("class_id IS NOT NULL").select(plain(F.col("name")).alias("source_name"), "class_id", "class_name").distinct()
    raw = table(spark, sf_dir, "canonical_predictions").select("prediction_id", plain(F.col("raw_class_name")).alias("raw")).distinct()
    inside, outside = preparation.split_by_scope(raw, "raw", mapping)
    both = inside.select("class_id").unionByName(outside.select(F.lit(-1).alias("class_id")))
    return both.groupBy("class_id").agg(F.count("*").alias("predictions"))


@registry.query(f"WITH {_I}, {_C} SELECT composition, count(*) AS n FROM (SELECT image_id, coalesce(string_agg(DISTINCT name, ' + ' ORDER BY name), '') AS composition FROM images LEFT JOIN cat USING (image_id) GROUP BY 1) GROUP BY 1")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = inputs.images(spark, sf_dir).select("image_id").join(inputs.categories(spark, sf_dir).select("image_id", "name"), "image_id", "left")
    return audit.composition(every, "image_id", "name")


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, split, categories, objects)."""
    cats = inputs.categories(spark, sf_dir).groupBy("image_id").agg(F.collect_set("name").alias("categories"))
    n = _objects(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("objects"))
    i = inputs.images(spark, sf_dir).select("image_id", "split").join(cats, "image_id", "left").join(n, "image_id", "left")
    return i.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).fillna(0, ["objects"])


_AUDITED = f"""{_I}, {_C}, {_L}, a AS (SELECT i.image_id, i.split, coalesce(o.n, 0) AS objects, coalesce(c.names, []) AS names FROM images i
  LEFT JOIN (SELECT image_id, count(*) AS n FROM lab JOIN images USING (stem) GROUP BY 1) o USING (image_id) LEFT JOIN (SELECT image_id, list(name) AS names FROM cat GROUP BY 1) c USING (image_id)),
f AS (SELECT *, len(names) > 0 AND len(list_filter(names, lambda x: x NOT IN ('Blackheads', 'Whiteheads'))) = 0 AS strict, len(list_filter(names, lambda x: x IN ('Blackheads', 'Whiteheads'))) > 0 AS touches FROM a)"""


@registry.query(
    f"""WITH {_AUDITED}, p AS (SELECT objects, unnest(['N0', 'N1', 'N2']) AS policy, unnest([false, coalesce(split = 'train' AND strict, false), coalesce(split = 'train' AND objects = 0 AND len(names) > 0, false)]) AS gone FROM f)
SELECT policy, CAST(count_if(gone) AS BIGINT) AS removed, CAST(count_if(NOT gone) AS BIGINT) AS remaining, CAST(coalesce(sum(CASE WHEN NOT gone THEN objects END), 0) AS BIGINT) AS objects_remaining FROM p GROUP BY 1"""
)
def policy_whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.col("split") == "train"
    policies = {"N0": F.lit(False), "N1": train & audit.is_strict_negative(F.col("categories")), "N2": audit.filter_created_negative(F.col("split"), F.col("objects"), F.col("categories"))}
    return audit.what_if(_audited(spark, sf_dir), policies)


@registry.query(f"WITH {_AUDITED} SELECT CAST(count_if(strict) AS BIGINT) AS strict, CAST(count_if(touches AND NOT strict) AS BIGINT) AS mixed, count(*) AS images FROM f")
def strict_and_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("categories")
    return _audited(spark, sf_dir).agg(F.count_if(audit.is_strict_negative(c)).alias("strict"), F.count_if(audit.is_mixed(c)).alias("mixed"), F.count("*").alias("images"))


@registry.query(
    f"""WITH {_AUDITED}, g AS (SELECT *, coalesce(split = 'train' AND strict, false) AS gone FROM f WHERE split IS NOT NULL)
SELECT split, count(*) AS images, CAST(count_if(gone) AS BIGINT) AS images_removed, CAST(count_if(NOT gone) AS BIGINT) AS images_after, CAST(sum(objects) AS BIGINT) AS objects,
  CAST(coalesce(sum(CASE WHEN gone THEN objects END), 0) AS BIGINT) AS objects_removed, CAST(coalesce(sum(CASE WHEN NOT gone THEN objects END), 0) AS BIGINT) AS objects_after FROM g GROUP BY 1"""
)
def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _audited(spark, sf_dir).where("split IS NOT NULL").withColumn("gone", (F.col("split") == "train") & audit.is_strict_negative(F.col("categories")))
    return audit.before_after(rows, "gone")


_ERRORS_SQL = r"""WITH l AS (SELECT DISTINCT line_id, line, string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' ') AS f FROM label_lines WHERE regexp_matches(line, '\S')),
n AS (SELECT line_id, len(f) = 5 AND regexp_full_match(f[1], '[+-]?[0-9]+') AND len(list_filter(f[2:5], lambda x: NOT regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'))) = 0 AS ok, f FROM l),
v AS (SELECT line_id, ok, CASE WHEN ok THEN try_cast(f[1] AS HUGEINT) END AS c, CASE WHEN ok THEN list_transform(f[2:5], lambda x: try_cast(x AS DOUBLE)) END AS p FROM n),
e AS (SELECT line_id, c, CASE WHEN NOT ok THEN ['MALFORMED'] ELSE list_filter([CASE WHEN NOT c BETWEEN 0 AND 3 THEN 'CLASS' END, CASE WHEN len(list_filter(p, lambda x: x BETWEEN 0 AND 1)) < 4 THEN 'COORDINATE' END,
  CASE WHEN p[3] <= 0 OR p[4] <= 0 THEN 'SIZE' END], lambda x: x IS NOT NULL) END AS errors FROM v)"""


@registry.query(_ERRORS_SQL + " SELECT error, count(*) AS n FROM (SELECT unnest(errors) AS error FROM e) GROUP BY 1")
def label_line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors add up on a line, other than in the loading of lines, where the first decides."""
    lines = table(spark, sf_dir, "label_lines").select("line_id", "line").distinct()
    return audit.histogram(lines.withColumn("errors", validation.line_errors(F.col("line"))), "errors").withColumnRenamed("flag", "error")


@registry.query(_ERRORS_SQL + " SELECT CAST(c AS INTEGER) AS class_id, count(*) AS n FROM e WHERE NOT list_contains(errors, 'MALFORMED') AND NOT list_contains(errors, 'CLASS') GROUP BY 1")
def label_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line with a valid class counts even if its coordinates are bad."""
    lines = table(spark, sf_dir, "label_lines").select("line_id", "line").distinct().withColumn("class_id", validation.class_of_line(F.col("line")))
    return lines.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("n"))


@registry.query(r"""WITH l AS (SELECT path, content, row_number() OVER (PARTITION BY file_id ORDER BY written_at DESC, content DESC) AS r FROM label_files) SELECT path FROM l WHERE r = 1 AND NOT coalesce(regexp_matches(content, '\S'), false)""")
def negative_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files that are there and have no line with text."""
    last = table(spark, sf_dir, "label_files").groupBy("file_id", "path").agg(F.max(F.struct("written_at", "content")).alias("last")).select("path", "last.content")
    lines = last.select("path", F.explode(F.split("content", r"\r\n?|\n")).alias("line")).where(F.col("line").rlike(r"\S"))
    return validation.negatives(last, lines, ["path"])


@registry.query(
    rf"""WITH {_I}, s AS (SELECT DISTINCT regexp_extract(regexp_extract(label_file, '([^/\\]*)$', 1), '^(.+)[.][^.]*$', 1) AS stem FROM label_lines WHERE label_file IS NOT NULL), i AS (SELECT DISTINCT stem FROM images)
SELECT stem, 'label' AS missing FROM (SELECT stem FROM i EXCEPT SELECT stem FROM s) UNION ALL SELECT stem, 'image' FROM (SELECT stem FROM s EXCEPT SELECT stem FROM i)"""
)
def unmatched_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "label_lines").where("label_file IS NOT NULL").select(names.stem(F.col("label_file")).alias("stem"))
    return validation.unmatched(inputs.images(spark, sf_dir), labels, ["stem"])


@registry.query(
    r"""WITH a AS (SELECT DISTINCT regexp_extract(regexp_extract(label_file, '([^/\\]*)$', 1), '^(.+)[.][^.]*$', 1) AS stem, line_no AS position, trim(regexp_replace(line, '\s+', ' ', 'g')) AS x FROM label_lines WHERE regexp_matches(line, '\S')),
l AS (SELECT * FROM (SELECT path, content, row_number() OVER (PARTITION BY file_id ORDER BY written_at DESC, content DESC) AS r FROM label_files) WHERE r = 1),
b AS (SELECT stem, CAST(i AS INTEGER) AS position, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS x FROM (SELECT regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '^(.+)[.][^.]*$', 1) AS stem, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, list_filter(string_split_regex(content, '\r\n?|\n'), lambda s: regexp_matches(s, '\S')) AS ls FROM l)))
SELECT CASE WHEN b.x IS NULL THEN 'MISSING_LABEL' WHEN a.x IS NULL THEN 'MISSING_ANNOTATION' ELSE 'DIFFERENT' END AS problem, count(*) AS n FROM a FULL JOIN b ON a.stem = b.stem AND a.position = b.position WHERE a.x IS DISTINCT FROM b.x GROUP BY 1"""
)
def positional_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two forms of the label text compared place by place, as text."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    a = table(spark, sf_dir, "label_lines").where(F.col("line").rlike(r"\S")).select(names.stem(F.col("label_file")).alias("stem"), F.col("line_no").alias("position"), flat(F.col("line")).alias("x")).distinct()
    last = table(spark, sf_dir, "label_files").groupBy("file_id", "path").agg(F.max(F.struct("written_at", "content")).alias("last"))
    listed = F.filter(F.split("last.content", r"\r\n?|\n"), lambda s: s.rlike(r"\S"))
    b = last.select(names.stem(F.col("path")).alias("stem"), F.posexplode(listed).alias("p", "line")).select("stem", (F.col("p") + 1).alias("position"), flat(F.col("line")).alias("y"))
    both = a.join(b, ["stem", "position"], "full").where(~F.col("x").eqNullSafe(F.col("y")))
    problem = F.when(F.col("y").isNull(), "MISSING_LABEL").when(F.col("x").isNull(), "MISSING_ANNOTATION").otherwise("DIFFERENT")
    return both.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


_PLACED = rf"""{_I}, {_L}, a AS (SELECT DISTINCT line_id, stem, line_no AS position, class_id, x_center, y_center, w, h FROM lab JOIN (SELECT DISTINCT line_id, line_no FROM label_lines) USING (line_id) JOIN (SELECT DISTINCT stem FROM images) USING (stem)),
l AS (SELECT * FROM (SELECT path, content, row_number() OVER (PARTITION BY file_id ORDER BY written_at DESC, content DESC) AS r FROM label_files) WHERE r = 1),
t AS (SELECT stem, CAST(i AS INTEGER) AS position, string_split(trim(regexp_replace(ls[i], '\s+', ' ', 'g')), ' ') AS f FROM (SELECT regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '^(.+)[.][^.]*$', 1) AS stem, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, list_filter(string_split_regex(content, '\r\n?|\n'), lambda s: regexp_matches(s, '\S')) AS ls FROM l))),
b AS (SELECT stem, position, CAST(f[1] AS BIGINT) AS cb, list_transform(f[2:5], lambda x: CAST(x AS DOUBLE)) AS v FROM t WHERE len(f) = 5 AND regexp_full_match(f[1], '[+-]?[0-9]+') AND len(list_filter(f[2:5], lambda x: NOT regexp_full_match(x, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'))) = 0 AND stem IN (SELECT stem FROM images)),
j AS (SELECT coalesce(a.stem, b.stem) AS stem, coalesce(a.position, b.position) AS position, CASE WHEN cb IS NULL THEN 'MISSING_LABEL' WHEN class_id IS NULL THEN 'MISSING_ANNOTATION' WHEN class_id <> cb THEN 'CLASS'
  WHEN NOT (abs(v[1] - x_center) <= 2e-6 + 1e-5 * abs(x_center) AND abs(v[2] - y_center) <= 2e-6 + 1e-5 * abs(y_center) AND abs(v[3] - w) <= 2e-6 + 1e-5 * abs(w) AND abs(v[4] - h) <= 2e-6 + 1e-5 * abs(h)) THEN 'BOX' END AS problem
  FROM a FULL JOIN b ON a.stem = b.stem AND a.position = b.position)"""


@registry.query(f"WITH {_PLACED} SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY 1")
def positional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the line table and of the label files compared place by place, with the tolerance for written shares."""
    known = inputs.images(spark, sf_dir).select("stem").distinct()
    place = table(spark, sf_dir, "label_lines").select("line_id", F.col("line_no").alias("position")).distinct()
    share = {"w": "width", "h": "height"}
    a = inputs.label_boxes(spark, sf_dir).join(place, "line_id").join(known, "stem").withColumnsRenamed(share)
    last = table(spark, sf_dir, "label_files").groupBy("file_id", "path").agg(F.max(F.struct("written_at", "content")).alias("last"))
    listed = F.filter(F.split("last.content", r"\r\n?|\n"), lambda s: s.rlike(r"\S"))
    rows = last.select(names.stem(F.col("path")).alias("stem"), F.posexplode(listed).alias("p", "line")).select("stem", (F.col("p") + 1).alias("position"), "line")
    b = labels.boxes(rows).where("size(split(trim(regexp_replace(line, '\\\\s+', ' ')), ' ')) = 5").dropna(subset=["class_id", *validation.NAMES]).join(known, "stem")
    found = validation.positional_differences(a, b, ["stem"])
    return found.groupBy("problem").agg(F.count("*").alias("n"))


_PIXEL = "b AS (SELECT image_id, line_id, (x_center - w / 2) * width AS x1, (y_center - h / 2) * height AS y1, (x_center + w / 2) * width AS x2, (y_center + h / 2) * height AS y2 FROM lab JOIN images USING (stem))"


@registry.query(
    f"""WITH {_I}, {_L}, {_PIXEL}, p AS (SELECT image_id, x.line_id AS a, y.line_id AS b, greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) * greatest(0, least(x.y2, y.y2) - greatest(x.y1, y.y1)) AS inter,
  (x.x2 - x.x1) * (x.y2 - x.y1) AS ax, (y.x2 - y.x1) * (y.y2 - y.y1) AS ay FROM b x JOIN b y USING (image_id) WHERE x.line_id < y.line_id)
SELECT image_id, a, b, round(inter / (ax + ay - inter), 6) AS iou FROM p WHERE inter / (ax + ay - inter) >= 0.3"""
)
def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label boxes of one image with an overlap of at least 0.3, so that these data have some; 0.8 is the default elsewhere."""
    b = inputs.truth(spark, sf_dir)
    return near.overlapping(b, ["image"], "truth", ["x1", "y1", "x2", "y2"], 0.3).select(F.col("image").alias("image_id"), "a", "b", F.round("iou", 6).alias("iou"))


_NEAR = """heads AS (SELECT dhash, min(image_id) AS head FROM images WHERE dhash IS NOT NULL GROUP BY 1),
np AS (SELECT least(x.head, y.head) AS a, greatest(x.head, y.head) AS b, CAST(bit_count(xor(x.dhash, y.dhash)) AS INTEGER) AS hamming FROM heads x JOIN heads y ON x.dhash < y.dhash AND bit_count(xor(x.dhash, y.dhash)) <= 4
  UNION SELECT head, image_id, 0 FROM images JOIN heads USING (dhash) WHERE head < image_id)"""


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, dhash) as the table has them, repeated rows too: inputs.images would shuffle whole rows to have each once."""
    return table(spark, sf_dir, "source_images").select("image_id", "dhash")


@registry.query(f"WITH {_I}, {_NEAR} SELECT a, b, hamming FROM np")
def near_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose fingerprints differ in at most 4 bits, by the heads of classes with equal ones, and each image with its head."""
    return near.near_duplicates(_prints(spark, sf_dir), "image_id", "dhash")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b) of images whose pair has been judged. The joins are merged, as the names are longer than Spark takes them for when it decides what to broadcast."""
    i = table(spark, sf_dir, "source_images").select("image_id", names.bare_name(F.col("file_name")).alias("file_name")).distinct().hint("merge")
    d = table(spark, sf_dir, "duplicate_review").select(names.bare_name(F.col("file_a")).alias("fa"), names.bare_name(F.col("file_b")).alias("fb"))
    return d.join(i.select(F.col("file_name").alias("fa"), F.col("image_id").alias("a")), "fa").join(i.select(F.col("file_name").alias("fb"), F.col("image_id").alias("b")), "fb").select("a", "b")


@registry.query(
    f"""WITH {_I}, {_NEAR}, d AS (SELECT trim(regexp_replace(file_a, '^.*[/\\\\]', '')) AS fa, trim(regexp_replace(file_b, '^.*[/\\\\]', '')) AS fb FROM duplicate_review),
base AS (SELECT x.image_id AS a, y.image_id AS b FROM d JOIN images x ON x.file_name = fa JOIN images y ON y.file_name = fb)
SELECT a, b, hamming FROM np WHERE NOT EXISTS (SELECT 1 FROM base WHERE (base.a = np.a AND base.b = np.b) OR (base.a = np.b AND base.b = np.a))"""
)
def new_near_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of near_images that aren't judged pairs themselves; new_near_pairs has the pairs of all images."""
    return near.not_in_baseline(near_images(spark, sf_dir), _judged(spark, sf_dir), "a", "b").select("a", "b", "hamming")


@registry.query(
    f"""WITH {_I}, im AS (SELECT DISTINCT image_id, dhash, min(image_id) OVER (PARTITION BY dhash) AS head FROM images WHERE dhash IS NOT NULL),
d AS (SELECT trim(regexp_replace(file_a, '^.*[/\\\\]', '')) AS fa, trim(regexp_replace(file_b, '^.*[/\\\\]', '')) AS fb FROM duplicate_review),
base AS (SELECT DISTINCT least(x.image_id, y.image_id) AS a, greatest(x.image_id, y.image_id) AS b FROM d JOIN images x ON x.file_name = fa JOIN images y ON y.file_name = fb),
np AS (SELECT x.image_id AS a, y.image_id AS b, least(x.head, y.head) AS ha, greatest(x.head, y.head) AS hb, CAST(bit_count(xor(x.dhash, y.dhash)) AS INTEGER) AS hamming FROM im x JOIN im y ON x.image_id < y.image_id AND bit_count(xor(x.dhash, y.dhash)) <= 4)
SELECT ha AS a, hb AS b, hamming, count(*) AS pairs, count(base.a) AS judged FROM np LEFT JOIN base ON base.a = np.a AND base.b = np.b GROUP BY 1, 2, 3 HAVING count(base.a) < count(*)"""
)
def new_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of images that nobody has judged yet, of all images, by classes of equal fingerprints; near_members has the images of each."""
    return near.unjudged(_prints(spark, sf_dir), "image_id", "dhash", _judged(spark, sf_dir), "a", "b")


@registry.query(f"WITH {_I} SELECT min(image_id) OVER (PARTITION BY dhash) AS head, image_id FROM images WHERE dhash IS NOT NULL")
def near_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of each class of equal fingerprints, with its head."""
    return near.members(inputs.images(spark, sf_dir), "image_id", "dhash")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_name, root, split) of files linked by review."""
    comp = review.connected(inputs.review_links(spark, sf_dir), "a", "b").withColumnRenamed("node", "file_name")
    split = inputs.images(spark, sf_dir).select("file_name", "split").where("split IS NOT NULL")
    return Stages(spark).write(comp.join(split, "file_name", "left"), "members")


_MEMBERS = f"""{_I}, {inputs.COMPONENTS}, m AS (SELECT file_name, root, split FROM comp LEFT JOIN (SELECT DISTINCT file_name, split FROM images WHERE split IS NOT NULL) USING (file_name)),
g AS (SELECT root, count(*) AS num_files, coalesce(bool_or(split = 'train'), false) AS has_train, coalesce(bool_or(split = 'val'), false) AS has_val, coalesce(bool_or(split = 'test'), false) AS has_test FROM m GROUP BY 1)"""
_REMOVED = f"""{_MEMBERS}, {_C}, strict AS (SELECT i.file_name FROM images i JOIN (SELECT image_id FROM cat GROUP BY 1 HAVING count_if(name NOT IN ('Blackheads', 'Whiteheads')) = 0) USING (image_id) WHERE i.split = 'train'),
rem AS (SELECT file_name, max(reason) AS reason FROM (SELECT file_name, 'STRICT_N1_BLACKHEAD_WHITEHEAD_NEGATIVE' AS reason FROM strict UNION ALL
  SELECT file_name, CASE WHEN split = 'train' AND (has_val OR has_test) THEN 'CONFIRMED_CROSS_SPLIT_B_VARIANT' WHEN split = 'val' AND has_test THEN 'VAL_TEST_LEAKAGE_S1_REMOVE_VAL' END FROM m JOIN g USING (root)) WHERE reason IS NOT NULL GROUP BY 1)"""


@registry.query(f"WITH RECURSIVE {inputs.COMPONENTS} SELECT file_name AS node, root FROM comp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.connected(inputs.review_links(spark, sf_dir), "a", "b")


@registry.query(
    f"WITH RECURSIVE {_MEMBERS} SELECT root, num_files, has_train, has_val, has_test, array_to_string(list_filter([CASE WHEN has_train THEN 'train' END, CASE WHEN has_val THEN 'val' END, CASE WHEN has_test THEN 'test' END], lambda x: x IS NOT NULL), ';') AS splits,"
    " CASE WHEN has_val AND has_test THEN 'HOLD_VAL_TEST_REVIEW' ELSE 'PROPOSE_TRAIN_EXCLUSION_ONLY' END AS status FROM g"
)
def review_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.group_table(_members(spark, sf_dir), "root", "split")


@registry.query(
    f"""WITH RECURSIVE {_MEMBERS} SELECT file_name, m.root, split, CASE WHEN split = 'train' AND (has_val OR has_test) THEN 'PROPOSE_EXCLUDE_FROM_TRAIN' WHEN has_val AND has_test THEN 'RETAIN_UNCHANGED_PENDING_VAL_TEST_REVIEW' ELSE 'RETAIN_HELD_OUT_UNCHANGED' END AS action
FROM m JOIN g ON m.root = g.root"""
)
def cleanup_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    return review.cleanup(m, review.group_table(m, "root", "split"), "root", "split").select("file_name", "root", "split", "action")


def _removed(spark: SparkSession, sf_dir: str, members: DataFrame) -> DataFrame:
    strict = _audited(spark, sf_dir).where((F.col("split") == "train") & audit.is_strict_negative(F.col("categories"))).select("image_id")
    named = strict.join(inputs.images(spark, sf_dir).select("image_id", "file_name"), "image_id")
    return review.removals(members, review.group_table(members, "root", "split"), named, "root", "file_name", "split")


@registry.query(f"WITH RECURSIVE {_REMOVED} SELECT file_name, reason FROM rem")
def derived_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(spark, sf_dir, _members(spark, sf_dir))


@registry.query(
    f"""WITH RECURSIVE {_REMOVED}, losing AS (SELECT DISTINCT root FROM m WHERE file_name IN (SELECT file_name FROM rem)),
role AS (SELECT root, file_name, CASE WHEN file_name IN (SELECT file_name FROM rem) THEN 'REMOVED' WHEN split IN ('val', 'test') THEN 'COUNTERPART' END AS role FROM m WHERE root IN (SELECT root FROM losing))
SELECT root, file_name, role FROM role WHERE role IS NOT NULL"""
)
def retained_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    return review.retained_counterparts(m, _removed(spark, sf_dir, m), "root", "file_name", "split")


@registry.query(
    f"""WITH RECURSIVE {_MEMBERS} SELECT array_to_string(list_filter([CASE WHEN has_train THEN 'train' END, CASE WHEN has_val THEN 'val' END, CASE WHEN has_test THEN 'test' END], lambda x: x IS NOT NULL), ';') AS splits,
count(*) AS groups, CAST(sum(num_files) AS BIGINT) AS files FROM g GROUP BY 1"""
)
def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups reach which splits."""
    return review.split_sets(review.group_table(_members(spark, sf_dir), "root", "split"))


@registry.query(
    rf"""WITH RECURSIVE {inputs.COMPONENTS}, d AS (SELECT DISTINCT pair_id, trim(regexp_replace(file_a, '^.*[/\\]', '')) AS a, trim(regexp_replace(file_b, '^.*[/\\]', '')) AS b FROM duplicate_review WHERE pair_id IS NOT NULL)
SELECT pair_id, a, b FROM d LEFT JOIN comp x ON x.file_name = a LEFT JOIN comp y ON y.file_name = b WHERE a <> '' AND b <> '' AND NOT coalesce(x.root = y.root, false)"""
)
def torn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged pairs, whatever the verdict, whose two files aren't in one group."""
    d = table(spark, sf_dir, "duplicate_review").where("pair_id IS NOT NULL")
    pairs = d.select("pair_id", names.bare_name(F.col("file_a")).alias("a"), names.bare_name(F.col("file_b")).alias("b")).dropna().distinct()
    return review.torn_pairs(pairs, components(spark, sf_dir), "a", "b", "node", "root")


@registry.query(f"WITH RECURSIVE {_REMOVED} SELECT i.split, count(*) AS images FROM (SELECT DISTINCT file_name, split FROM images WHERE split IS NOT NULL) i WHERE file_name NOT IN (SELECT file_name FROM rem) GROUP BY 1")
def derived_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when the removals are applied, checked for groups that still span splits."""
    m = _members(spark, sf_dir)
    removed = _removed(spark, sf_dir, m)
    i = inputs.images(spark, sf_dir).where("split IS NOT NULL").select("file_name", "split").distinct()
    kept, members = sets.remove(i, m, removed, ["file_name"])
    spanning = members.groupBy("root").agg(F.count_distinct("split").alias("n")).where("n > 1")
    validation.assert_none(spanning, "groups that still span splits")
    return kept.groupBy("split").agg(F.count("*").alias("images"))


@registry.query(
    f"""WITH RECURSIVE {_REMOVED}, {_L}, i AS (SELECT split, file_name, stem FROM images WHERE split IS NOT NULL AND file_name NOT IN (SELECT file_name FROM rem)), o AS (SELECT stem, count(*) AS n FROM lab GROUP BY 1)
SELECT split, count(*) AS images, CAST(count_if(n IS NULL) AS BIGINT) AS negatives, CAST(coalesce(sum(n), 0) AS BIGINT) AS objects FROM i LEFT JOIN o USING (stem) GROUP BY 1"""
)
def derived_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived version planned, gated by its own counts, written, and validated from what was written."""
    m = _members(spark, sf_dir)
    removed = Stages(spark).write(_removed(spark, sf_dir, m), "removed")
    i = inputs.images(spark, sf_dir).where("split IS NOT NULL").select("split", "file_name", "stem").distinct()
    annotations = inputs.label_boxes(spark, sf_dir).join(i, "stem").select("file_name", "line_id", "class_id")
    plan = derivation.derive(i, annotations, removed, ["file_name"], "split")
    return derivation.derive(i, annotations, removed, ["file_name"], "split", plan.counts, new_path(spark, "derived")).counts


@registry.query(f"WITH RECURSIVE {inputs.COMPONENTS} SELECT root, 'G' || lpad(CAST(row_number() OVER (ORDER BY root) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY root) AS VARCHAR))) AS INTEGER), '0') AS group_id FROM (SELECT DISTINCT root FROM comp)")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.group_numbers(components(spark, sf_dir), "root", "node")


@registry.query(f"WITH {inputs.LINKS} SELECT node, count(*) AS pairs FROM (SELECT a AS node FROM links UNION ALL SELECT b FROM links) GROUP BY 1 HAVING count(*) > 1")
def repeated_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.repeated_nodes(inputs.review_links(spark, sf_dir).distinct(), "a", "b")


@registry.query(
    rf"""WITH {_I}, {inputs.LINKS}, {_L}, s AS (SELECT i.file_name, list_sort(list({{'c': CAST(class_id AS INTEGER), 'b': [x_center, y_center, w, h]}}) FILTER (WHERE line_id IS NOT NULL)) AS sig, list_sort(list(CAST(class_id AS INTEGER)) FILTER (WHERE line_id IS NOT NULL)) AS cls FROM images i LEFT JOIN lab USING (stem) GROUP BY 1)
SELECT CASE WHEN x.cls IS DISTINCT FROM y.cls THEN 'CLASS_OR_COUNT' WHEN x.sig IS DISTINCT FROM y.sig THEN 'BOX_GEOMETRY' ELSE 'MATCH' END AS difference, count(*) AS pairs FROM links JOIN s x ON x.file_name = a JOIN s y ON y.file_name = b GROUP BY 1"""
)
def annotation_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the labels of linked files differ."""
    item = F.struct(F.col("class_id").alias("class"), F.array("x_center", "y_center", "w", "h").alias("bbox"))
    sig = inputs.label_boxes(spark, sf_dir).groupBy("stem").agg(boxes.signature(F.collect_list(item)).alias("items"))
    files = inputs.images(spark, sf_dir).select("file_name", "stem").distinct().join(sig, "stem", "left")
    side = lambda k: files.select(F.col("file_name").alias(k), F.col("items").alias(f"items_{k}"))
    pairs = inputs.review_links(spark, sf_dir).distinct().join(side("a"), "a").join(side("b"), "b")
    return pairs.groupBy(review.difference(F.col("items_a"), F.col("items_b")).alias("difference")).agg(F.count("*").alias("pairs"))


@registry.query(
    "SELECT pair_id, 'C' || lpad(CAST(r AS VARCHAR), CAST(greatest(3, length(CAST(r AS VARCHAR))) AS INTEGER), '0') AS ordinal FROM (SELECT pair_id, row_number() OVER (ORDER BY rmse, dhash_distance, a, b, pair_id) AS r FROM "
    "(SELECT DISTINCT pair_id, rmse, dhash_distance, coalesce(file_a, '') AS a, coalesce(file_b, '') AS b FROM duplicate_review WHERE pair_id IS NOT NULL AND rmse IS NOT NULL AND dhash_distance IS NOT NULL AND split_a <> split_b))"
)
def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-split pairs by closeness, with ordinals."""
    r = table(spark, sf_dir, "duplicate_review").where("pair_id IS NOT NULL AND rmse IS NOT NULL AND dhash_distance IS NOT NULL AND split_a <> split_b")
    rows = r.select("pair_id", "rmse", "dhash_distance", F.coalesce("file_a", F.lit("")).alias("a"), F.coalesce("file_b", F.lit("")).alias("b")).distinct()
    return review.ranked_pairs(rows, ["rmse", "dhash_distance", "a", "b", "pair_id"], "C").select("pair_id", "ordinal")


@registry.query("SELECT lower(trim(human_decision)) AS decision, count(*) AS n, CAST(count_if(coalesce(annotation_flag, 'MATCH') = 'MATCH') AS BIGINT) AS matching FROM (SELECT DISTINCT * FROM duplicate_review) WHERE regexp_matches(pair_id, '^D[0-9]+$') AND CAST(substr(pair_id, 2) AS BIGINT) BETWEEN 31 AND 100000 GROUP BY 1")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "duplicate_review").distinct().where(review.in_id_range(F.col("pair_id"), 31, 100_000) & F.col("pair_id").startswith("D"))
    found = r.withColumn("difference", F.coalesce("annotation_flag", F.lit("MATCH")))
    return found.groupBy(F.lower(F.trim("human_decision")).alias("decision")).agg(F.count("*").alias("n"), F.count_if(F.col("difference") == "MATCH").alias("matching"))


@registry.query(f"WITH {_I}, {_L}, o AS (SELECT image_id, class_id, count(*) AS n FROM lab JOIN images USING (stem) GROUP BY ALL) SELECT image_id, string_agg(class_id || ':' || n, ',' ORDER BY class_id) AS objects FROM o GROUP BY 1")
def object_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = review.object_map(_objects(spark, sf_dir), ["image_id"], "class_id")
    return m.select("image_id", F.array_join(F.transform(F.map_entries("objects"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("objects"))


_OUTLIERS = f"""{_I}, {_L}, b AS (SELECT image_id, line_id, class_id, width AS iw, height AS ih, (x_center - w / 2) * width AS x, (y_center - h / 2) * height AS y, w * width AS bw, h * height AS bh FROM lab JOIN images USING (stem) WHERE class_id = 1),
s AS (SELECT image_id, line_id FROM b WHERE greatest(bw / bh, bh / bw) >= 8)"""


def _wrinkle_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, line_id, class_id, bbox, width, height) of label boxes of the class of thin things."""
    t = inputs.truth(spark, sf_dir).where("class_id = 1").select(F.col("image").alias("image_id"), F.col("truth").alias("line_id"), "class_id", boxes.corners_to_xywh(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))).alias("bbox"))
    return t.join(inputs.images(spark, sf_dir).select("image_id", "width", "height"), "image_id")


@registry.query(
    f"""WITH {_OUTLIERS} SELECT image_id, line_id, round(bw, 6) AS width_px, round(bh, 6) AS height_px, round(bw * bh / (iw * ih), 12) AS area_norm, round(bw / bh, 6) AS aspect_ratio,
(image_id, line_id) IN (SELECT (image_id, line_id) FROM s) AS selected_outlier FROM b WHERE image_id IN (SELECT image_id FROM s)"""
)
def displayed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes of the images with an outlier, measured, and whether each is one."""
    every = _wrinkle_boxes(spark, sf_dir)
    m = boxes.measures(F.col("bbox"), F.col("width"), F.col("height"))
    measured = every.select("image_id", "line_id", *(m[c].alias(c) for c in ("width_px", "height_px", "area_norm", "aspect_ratio")))
    thin = measured.where(F.greatest(F.col("aspect_ratio"), 1 / F.col("aspect_ratio")) >= 8)
    shown = review.displayed_boxes(measured, thin, ["image_id"], "line_id")
    return shown.select("image_id", "line_id", F.round("width_px", 6).alias("width_px"), F.round("height_px", 6).alias("height_px"), F.round("area_norm", 12).alias("area_norm"), F.round("aspect_ratio", 6).alias("aspect_ratio"), "selected_outlier")


@registry.query(f"""WITH {_OUTLIERS} SELECT s.image_id, s.line_id, round(least(x / iw, y / ih, (iw - x - bw) / iw, (ih - y - bh) / ih), 9) AS gap FROM s JOIN b USING (image_id, line_id)""")
def outlier_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each outlier with its own annotation, and that one's distance to the edge."""
    every = _wrinkle_boxes(spark, sf_dir)
    m = boxes.measures(F.col("bbox"), F.col("width"), F.col("height"))
    outliers = every.where(F.greatest(m["aspect_ratio"], 1 / m["aspect_ratio"]) >= 8).select("image_id", "line_id")
    found = review.boxes_of_outliers(outliers, every.withColumn("position", F.col("line_id")), ["image_id", "line_id"])
    return found.select("image_id", "line_id", F.round(boxes.edge_gap(F.col("bbox"), F.col("width"), F.col("height")), 9).alias("gap"))


@registry.query(f"""WITH {_I}, d AS (SELECT DISTINCT image_id, split, source_image_id FROM source_images)
SELECT d.image_id, d.source_image_id, i.file_name AS source_file_name FROM d JOIN (SELECT image_id, CASE WHEN split = 'valid' THEN 'val' ELSE split END AS s FROM d) k USING (image_id) JOIN images i ON i.image_id = d.image_id WHERE k.s IS NOT NULL""")
def source_images_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived images with the raw image that each was made from; ids of raw images restart in each split."""
    i = table(spark, sf_dir, "source_images").select("image_id", names.split_name(F.col("split")).alias("split"), "source_image_id", names.bare_name(F.col("file_name")).alias("file_name")).where("split IS NOT NULL").distinct()
    derived = i.select("image_id", F.col("split").alias("source_split"), "source_image_id")
    raw = i.select("split", F.col("source_image_id").alias("id"), "file_name")
    return coco.to_source(derived, raw).select("image_id", "source_image_id", "source_file_name")


@registry.query(rf"""WITH {_I}, r AS (SELECT DISTINCT trim(regexp_replace(file_a, '^.*[/\\]', '')) AS f, CASE lower(trim(split_a)) WHEN 'valid' THEN 'val' ELSE lower(trim(split_a)) END AS split FROM duplicate_review),
x AS (SELECT f, min(split) AS split FROM r WHERE f <> '' AND split IN ('train', 'val', 'test') GROUP BY 1)
SELECT x.f AS pair_id, x.split FROM x LEFT JOIN images i ON i.file_name = x.f WHERE i.file_name IS NULL OR i.split IS DISTINCT FROM x.split""")
def mismatched_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed files whose split at the time isn't the present one, or that are gone."""
    r = table(spark, sf_dir, "duplicate_review").select(names.bare_name(F.col("file_a")).alias("pair_id"), names.split_name(F.col("split_a")).alias("split")).dropna()
    reviewed = r.groupBy("pair_id").agg(F.min("split").alias("split"))
    now = inputs.images(spark, sf_dir).select(F.col("file_name").alias("pair_id"), "split").distinct()
    return review.mismatched_metadata(reviewed, now, ["split"])


@registry.query(f"WITH {_I}, {_L} SELECT line_id, class_id || ' ' || printf('%.8f', x_center) || ' ' || printf('%.8f', y_center) || ' ' || printf('%.8f', w) || ' ' || printf('%.8f', h) AS line FROM lab JOIN images USING (stem) WHERE x_center - w / 2 >= 0.01 AND y_center - h / 2 >= 0.01 AND x_center + w / 2 <= 0.99 AND y_center + h / 2 <= 0.99")
def rewritten_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines written again from boxes in pixels that lie within their image."""
    t = inputs.truth(spark, sf_dir).join(inputs.images(spark, sf_dir).select(F.col("image_id").alias("image"), "width", "height"), "image")
    box = boxes.corners_to_xywh(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    inside = (F.col("x1") >= 0.01 * F.col("width")) & (F.col("y1") >= 0.01 * F.col("height")) & (F.col("x2") <= 0.99 * F.col("width")) & (F.col("y2") <= 0.99 * F.col("height"))
    return t.where(inside).select(F.col("truth").alias("line_id"), boxes.label_line(F.col("class_id"), box, F.col("width"), F.col("height")).alias("line"))
