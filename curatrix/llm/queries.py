"""The queries of the problems in this folder over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..plans.registry import Registry
from ..stage import Stages, table
from . import cosine, graph, mixing, packing, spans, splits, subset, tokens, topn

registry = Registry()
queries = registry.queries
oracle_sql = registry.oracle_sql

_SPANS_SQL = """
WITH w AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
x AS (SELECT doc_id, i, md5(substr(text, i, 200)) AS h FROM w),
s AS (SELECT h FROM x GROUP BY h HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM x WHERE h IN (SELECT h FROM s)),
n AS (SELECT doc_id, CAST(sum(least(200, coalesce(j - i, 200))) AS BIGINT) AS shared_chars FROM c GROUP BY doc_id)
"""


@registry.query(_SPANS_SQL + "SELECT doc_id, shared_chars FROM n")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_length(table(spark, sf_dir, "documents"))


@registry.query(
    _SPANS_SQL
    + """SELECT coalesce(lower(trim(source)), '') AS source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars,
CAST(coalesce(sum(shared_chars), 0) AS BIGINT) AS shared_chars, count(shared_chars) AS docs_sharing
FROM documents LEFT JOIN n USING (doc_id) GROUP BY 1"""
)
def p10_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each source's text stands elsewhere too."""
    docs = table(spark, sf_dir, "documents")
    return (
        docs.select("doc_id", "source", "n_chars")
        .join(spans.shared_length(docs), "doc_id", "left")
        .groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"))
        .agg(
            F.count("*").alias("docs"),
            F.sum("n_chars").alias("chars"),
            F.coalesce(F.sum("shared_chars"), F.lit(0)).alias("shared_chars"),
            F.count("shared_chars").alias("docs_sharing"),
        )
    )


@registry.query()
def p10_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ranges and records come by each of the three ways."""
    ranges = spans.shared_windows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return ranges.groupBy("way").agg(F.count("*").alias("ranges"), F.count_distinct("id").alias("records"))


_SCORED = "SELECT DISTINCT image_id, class_id, prediction_id, confidence FROM canonical_predictions WHERE image_id IS NOT NULL AND class_id IS NOT NULL AND confidence BETWEEN 0 AND 1"


@registry.query(f"""
SELECT image_id, class_id, CAST(r AS INTEGER) AS rank_no, prediction_id FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, class_id ORDER BY confidence DESC, prediction_id) AS r FROM ({_SCORED})
) WHERE r <= 3""")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "canonical_predictions").where("confidence BETWEEN 0 AND 1")
    return topn.top_n(scored, ["image_id", "class_id"], "confidence", "prediction_id", 3).drop("confidence")


@registry.query(f"""
SELECT class_id, CAST(r AS INTEGER) AS rank_no, prediction_id, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY confidence DESC, prediction_id) AS r
  FROM (SELECT DISTINCT class_id, prediction_id, confidence FROM ({_SCORED}))
) WHERE r <= 100""")
def p7_top_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few giant groups instead of many small ones."""
    scored = table(spark, sf_dir, "canonical_predictions").where("confidence BETWEEN 0 AND 1 AND image_id IS NOT NULL")
    return topn.top_n(scored, ["class_id"], "confidence", "prediction_id", 100)


_NAME = "nullif(trim(regexp_replace({}, '^.*[/\\\\]', '')), '')"
_PAIRS_SQL = f"""
WITH RECURSIVE p AS (SELECT DISTINCT {_NAME.format("file_a")} AS a, {_NAME.format("file_b")} AS b FROM duplicate_review WHERE lower(trim(likely_same_source)) = 'yes'),
e AS (SELECT a, b FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b),
r AS (SELECT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
g AS (SELECT n AS file_name, min(m) AS group_file FROM r GROUP BY n)
"""


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = table(spark, sf_dir, "duplicate_review").where("lower(trim(likely_same_source)) = 'yes'")
    return review.select(names.bare_name(F.col("file_a")).alias("a"), names.bare_name(F.col("file_b")).alias("b"))


@registry.query(_PAIRS_SQL + "SELECT file_name, group_file FROM g")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(review_pairs(spark, sf_dir)).select(F.col("node").alias("file_name"), F.col("root").alias("group_file"))


@registry.query(_PAIRS_SQL + "SELECT files, count(*) AS groups FROM (SELECT group_file, count(*) AS files FROM g GROUP BY 1) GROUP BY 1")
def p5_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = graph.components(review_pairs(spark, sf_dir)).groupBy("root").agg(F.count("*").alias("files"))
    return sizes.groupBy("files").agg(F.count("*").alias("groups"))


_GROUPS_SQL = f"""
WITH RECURSIVE l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY confirmed_at DESC, files DESC) AS r FROM confirmed_duplicate_groups WHERE group_id IS NOT NULL) WHERE r = 1),
x AS (SELECT group_id, unnest(string_split(files, ';')) AS f FROM l),
gf AS (SELECT DISTINCT group_id, {_NAME.format("f")} AS f FROM x WHERE {_NAME.format("f")} IS NOT NULL),
h AS (SELECT group_id, f, min(f) OVER (PARTITION BY group_id) AS m FROM gf),
e AS (SELECT f AS a, m AS b FROM h UNION SELECT m, f FROM h),
r AS (SELECT a AS n, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
c AS (SELECT n AS f, min(m) AS root FROM r GROUP BY n),
s AS (SELECT DISTINCT {_NAME.format("file_name")} AS f, CASE lower(trim(split)) WHEN 'valid' THEN 'val' ELSE lower(trim(split)) END AS split FROM source_images),
t AS (SELECT root FROM c JOIN s USING (f) WHERE split IN ('train', 'val', 'test') GROUP BY root HAVING count(DISTINCT split) > 1)
"""


def confirmed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, file): the entries of the last row of each group, each once."""
    groups = table(spark, sf_dir, "confirmed_duplicate_groups").where("group_id IS NOT NULL").groupBy("group_id").agg(F.max(F.struct("confirmed_at", "files")).alias("last"))
    return groups.select("group_id", F.explode(F.split("last.files", ";")).alias("entry")).select("group_id", names.bare_name(F.col("entry")).alias("file")).dropna().distinct()


def image_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_images").select("image_id", names.bare_name(F.col("file_name")).alias("file"), names.split_name(F.col("split")).alias("split")).distinct()


@registry.query(_GROUPS_SQL + "SELECT DISTINCT group_id FROM gf JOIN c USING (f) WHERE root IN (SELECT root FROM t)")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = confirmed_files(spark, sf_dir)
    roots = Stages(spark).write(splits.related(files, "file", "group_id"), "roots")
    torn = splits.torn(roots, image_splits(spark, sf_dir), "file", "split")
    return files.join(roots.join(torn, "root", "left_semi"), files["file"] == roots["node"], "left_semi").select("group_id").distinct()


PARTS = {"train": 0.76, "val": 0.14, "test": 0.10}


@registry.query()
def p2_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every image: 76 % train, 14 % val, 10 % test."""
    images = image_splits(spark, sf_dir).select("image_id", "file").distinct()
    new = splits.assign_splits(images, "file", confirmed_files(spark, sf_dir), "file", "group_id", PARTS)
    return images.join(new, "file").select("image_id", "split")


@registry.query(
    _GROUPS_SQL
    + f""", i AS (SELECT DISTINCT image_id, {_NAME.format("file_name")} AS f FROM source_images WHERE image_id IS NOT NULL)
SELECT count(DISTINCT image_id) AS images, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS torn_groups, (SELECT count(DISTINCT group_id) FROM gf JOIN i USING (f)) AS groups, true AS in_proportion FROM i"""
)
def p2_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a right assignment comes to: every image in one split, no group of files in two, and shares of the images within
    5 points, and four standard deviations of a draw by image, of those wanted."""
    stages = Stages(spark)
    new = stages.write(p2_assigned(spark, sf_dir), "assigned")
    each = new.groupBy("image_id").agg(F.count("*").alias("n"), F.first("split").alias("split"))
    shares = each.agg(F.count("*").alias("images"), F.count_if(F.col("n") > 1).alias("twice"), *(F.avg((F.col("split") == s).cast("int")).alias(s) for s in PARTS))
    files = confirmed_files(spark, sf_dir).join(image_splits(spark, sf_dir).select("image_id", "file").distinct(), "file").join(each, "image_id")
    groups = files.groupBy("group_id").agg((F.min("split") != F.max("split")).alias("torn")).agg(F.count("*").alias("groups"), F.count_if("torn").alias("torn_groups"))
    near = F.lit(True)
    for s, part in PARTS.items():
        near = near & (F.abs(F.col(s) - part) < 0.05 + 4 * F.sqrt(F.lit(part * (1 - part)) / F.col("images")))
    return shares.join(F.broadcast(groups)).select("images", "twice", "torn_groups", "groups", near.alias("in_proportion"))  # a row each


CAPACITY = 4096


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.counted_with(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return packing.fill_containers(sizes, "doc_id", "tokens", CAPACITY)


# SQL can't count tokens. In these tables the texts of more than 4,096 tokens have more than 20,000 characters, and no other has 5,000.
@registry.query("SELECT doc_id FROM documents WHERE length(text) > 10000")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to divide."""
    return packed_documents(spark, sf_dir).where("piece > 0").select("doc_id").distinct()


@registry.query()
def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(spark, sf_dir)


@registry.query()
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the least possible number, and the share of room left over."""
    every = packed_documents(spark, sf_dir).agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("tokens"))
    least = F.ceil(F.col("tokens") / CAPACITY)
    return every.select("containers", "tokens", least.alias("least_possible"), (1 - F.col("tokens") / (F.col("containers") * CAPACITY)).alias("room_left"))


@registry.query("""SELECT count(DISTINCT doc_id) AS docs, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS with_gaps, true AS tight FROM documents""")
def p8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a right packing comes to: every document there, no container over its capacity, none divided that fits, pieces that follow each other, and at most 1 % and two containers more than the least number."""
    packed = Stages(spark).write(packed_documents(spark, sf_dir), "packed")
    fill = packed.groupBy("container").agg(F.sum("size").alias("fill"))
    bins = fill.agg(F.count_if(F.col("fill") > CAPACITY).alias("overfull"), F.count("*").alias("bins"), F.sum("fill").alias("tokens"))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("piece").alias("last"), F.count_distinct("piece").alias("pieces"), F.sum("size").alias("size"))
    each = docs.agg(F.count("*").alias("docs"), F.count_if(F.expr(f"n > 1 AND size <= {CAPACITY}")).alias("torn"), F.count_if(F.expr("n <> pieces OR last + 1 <> pieces")).alias("with_gaps"))
    tight = F.col("bins") <= F.ceil(F.col("tokens") / CAPACITY) * 1.01 + 2
    return each.join(F.broadcast(bins)).select("docs", "overfull", "torn", "with_gaps", tight.alias("tight"))  # a row each


def mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


# SQL can't count tokens; with bytes for sizes the same sources fall short, as none comes near its limit
@registry.query("""WITH s AS (SELECT lower(trim(source)) AS k, sum(octet_length(encode(text))) AS size FROM documents GROUP BY 1)
SELECT m.source FROM mix_targets m LEFT JOIN s ON s.k = lower(trim(m.source)) WHERE m.max_repeats * coalesce(s.size, 0) < m.weight * (SELECT sum(size) FROM s)""")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, sf_dir).report().where("NOT reachable").select("source")


@registry.query()
def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, sf_dir).uses()


@registry.query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, sf_dir).reached()


@registry.query("SELECT count(*) AS sources, CAST(0 AS BIGINT) AS off_share, CAST(0 AS BIGINT) AS too_often, CAST(0 AS BIGINT) AS twice FROM mix_targets")
def p9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a right mix comes to: shares within 0.5 % of those planned, or a longest record, no record used more often than allowed and none in two rows."""
    plan = mix(spark, sf_dir)
    uses = Stages(spark).write(plan.uses(), "uses")
    docs = uses.groupBy("source", "doc_id").agg(F.count("*").alias("rows"), F.max("uses").alias("uses"), F.sum(F.col("size") * F.col("uses")).alias("used"))
    got = docs.groupBy("source").agg(F.sum("used").alias("used"), F.max("uses").alias("most_uses"), F.count_if(F.col("rows") > 1).alias("twice"))
    longest = plan.sized.groupBy("key").agg(F.max("size").alias("longest"))
    both = plan.report().join(F.broadcast(got), "source", "left").withColumn("key", mixing.source_key(F.col("source"))).join(longest, "key", "left")  # a row a source
    both = both.fillna(0, ["used", "most_uses", "twice", "longest"])
    off = F.abs(F.col("used") - F.col("given")) > F.greatest(0.005 * F.col("given"), F.col("longest"))
    return both.agg(F.count("*").alias("sources"), F.count_if(off).alias("off_share"), F.count_if(F.col("most_uses") > F.col("max_repeats")).alias("too_often"), F.sum("twice").alias("twice"))


_IMAGES_SQL = """
WITH i AS (SELECT DISTINCT image_id, CASE WHEN lower(trim(split)) = 'valid' THEN 'val' WHEN lower(trim(split)) IN ('train', 'val', 'test') THEN lower(trim(split)) END AS split,
  nullif(regexp_extract(lower(sha256), '^(?:\\s*sha-?256\\s*[:=]?)?\\s*([0-9a-f]{64})\\s*$', 1), '') AS sha, dhash, dataset_source FROM source_images WHERE image_id IS NOT NULL),
p AS (SELECT e.image_id AS e_id, t.image_id AS t_id, e.split, e.dataset_source, coalesce(e.sha = t.sha, false) AS exact FROM i e JOIN i t
  ON e.split IN ('val', 'test') AND t.split = 'train' AND (e.sha = t.sha OR bit_count(xor(e.dhash, t.dhash)) <= 4))
"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "source_images").select("image_id", names.split_name(F.col("split")).alias("split"), names.sha_digits(F.col("sha256")).alias("sha"), "dhash")
    return cosine.split_overlaps(images, "image_id", "split", "sha", "dhash")


@registry.query(_IMAGES_SQL + "SELECT DISTINCT least(e_id, t_id) AS image_id_a, greatest(e_id, t_id) AS image_id_b FROM p")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(spark, sf_dir).select(F.least("held_out", "training").alias("image_id_a"), F.greatest("held_out", "training").alias("image_id_b"))


@registry.query(
    _IMAGES_SQL
    + """, b AS (SELECT e_id, split, dataset_source, bool_or(exact) AS exact FROM p GROUP BY ALL)
SELECT i.split, coalesce(i.dataset_source, '') AS dataset_source, count(DISTINCT i.image_id) AS images, count(DISTINCT b.e_id) AS overlapping, count(DISTINCT CASE WHEN b.exact THEN b.e_id END) AS exactly
FROM i LEFT JOIN b ON i.image_id = b.e_id WHERE i.split IN ('val', 'test') GROUP BY 1, 2"""
)
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "source_images").select("image_id", names.split_name(F.col("split")).alias("split"), F.coalesce("dataset_source", F.lit("")).alias("dataset_source")).distinct()
    hit = overlaps(spark, sf_dir).groupBy(F.col("held_out").alias("image_id")).agg(F.min("how").alias("how"))
    return (
        images.where("split IN ('val', 'test') AND image_id IS NOT NULL")
        .join(hit, "image_id", "left")
        .groupBy("split", "dataset_source")
        .agg(F.count("*").alias("images"), F.count("how").alias("overlapping"), F.count_if(F.coalesce(F.col("how") == "exact", F.lit(False))).alias("exactly"))
    )


def image_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, split, kind, features): the kind within the split weighs 1; each category 0.05, so little that a kind not yet there always comes first.

    With ten names there are at most 10 such weights: a present kind gains at most 0.42 + 10 * 0.05 from one more image, an absent one at least 1.
    """
    plain = names.plain_words
    known = F.broadcast(table(spark, sf_dir, "category_names").select("name", plain(F.col("name")).alias("plain")))  # a fixed list
    images = table(spark, sf_dir, "source_images").select("image_id", names.split_name(F.col("split")).alias("split"), "original_categories").where("split IS NOT NULL").distinct()
    each = images.select("image_id", "split", F.explode(F.split("original_categories", "[;,]")).alias("word"))
    each = each.select("image_id", "split", plain(F.col("word")).alias("plain")).join(known, "plain")
    kinds = each.groupBy("image_id", "split").agg(F.array_sort(F.collect_set("name")).alias("names"))
    feature = lambda what, mass: F.struct(F.concat(F.col("split"), F.lit("|"), what).alias("feature"), F.lit(mass).alias("mass"))
    kind = F.array_join("names", " + ")
    return kinds.select("image_id", "split", kind.alias("kind"), F.concat(F.array(feature(F.concat(F.lit("="), kind), 1.0)), F.transform("names", lambda n: feature(n, 0.0025))).alias("features"))


SUBSET_SIZE = 4096  # above 3 splits * (2 ** 10 - 1) kinds, so that every kind finds room; half of the images where they are fewer than twice as many


def chosen_images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(image_id, split, kind, features) of the images with a kind, and of the chosen ones."""
    features = Stages(spark).write(image_features(spark, sf_dir), "features")
    return features, subset.varied_subset(features, "image_id", "features", min(SUBSET_SIZE, features.count() // 2)).join(features, "image_id")


_KINDS_SQL = """
WITH n AS (SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS plain FROM category_names),
i AS (SELECT DISTINCT image_id, CASE lower(trim(split)) WHEN 'valid' THEN 'val' ELSE lower(trim(split)) END AS split, original_categories AS o FROM source_images),
x AS (SELECT image_id, split, unnest(string_split_regex(o, '[;,]')) AS c FROM i WHERE split IN ('train', 'val', 'test')),
k AS (SELECT image_id, split, string_agg(DISTINCT name, ' + ' ORDER BY name) AS kind FROM x JOIN n ON n.plain = trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) GROUP BY ALL)
"""


@registry.query(_KINDS_SQL + "SELECT DISTINCT split, kind FROM k")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_images(spark, sf_dir)[1].select("split", "kind").distinct()


@registry.query()
def p1_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_images(spark, sf_dir)[1].select("image_id")


@registry.query(
    _KINDS_SQL
    + f"""SELECT split, count(DISTINCT kind) AS kinds, count(DISTINCT kind) AS covered, true AS fair, CAST((SELECT least({SUBSET_SIZE}, count(*) // 2) FROM k) AS BIGINT) AS chosen FROM k GROUP BY split"""
)
def p1_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a right choice comes to: every kind is there, all the room is used, and no kind has more than twice as many and one as a kind of which some were left."""
    every, chosen = chosen_images(spark, sf_dir)
    have = every.groupBy("split", "kind").agg(F.count("*").alias("all"))
    got = Stages(spark).write(have.join(chosen.groupBy("split", "kind").agg(F.count("*").alias("got")), ["split", "kind"], "left").fillna(0, ["got"]), "got")
    whole = got.agg(F.sum("got").alias("chosen"), F.min(F.when(F.col("got") < F.col("all"), F.col("got"))).alias("least"))  # one row
    by_split = got.groupBy("split").agg(F.count("*").alias("kinds"), F.count_if(F.col("got") > 0).alias("covered"), F.max("got").alias("most"))
    return by_split.join(F.broadcast(whole)).select("split", "kinds", "covered", F.coalesce(F.col("most") <= 2 * F.col("least") + 1, F.lit(True)).alias("fair"), "chosen")
