"""COCO documents: one JSON document a split, read to three tables and written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..stage import as_list

IMAGE = "struct<id:bigint,file_name:string,width:int,height:int,source_split:string,source_image_id:bigint,sha256:string>"
ANNOTATION = "struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,area:double,iscrowd:int,source_annotation_id:bigint>"
CATEGORY = "struct<id:int,name:string,supercategory:string>"
DOCUMENT = f"info struct<description:string,seed:int>, images array<{IMAGE}>, annotations array<{ANNOTATION}>, categories array<{CATEGORY}>"


def read(spark: SparkSession, documents: dict[str, str]) -> dict[str, DataFrame]:
    """images, annotations and categories of the documents {split: path}, each row with its split, `valid` being `val`.

    Fields that a raw document lacks are null. Annotations keep their position in the document, which orders ties.
    """
    whole = None
    for split, path in documents.items():
        one = spark.read.schema(DOCUMENT).option("multiLine", "true").json(path).withColumn("split", names.split_name(F.lit(split)))
        whole = one if whole is None else whole.unionByName(one)
    if whole is None:
        raise ValueError("no document")
    return {
        "images": whole.select("split", F.inline("images")),
        "annotations": whole.select("split", F.posexplode("annotations").alias("position", "a")).select("split", "position", "a.*"),
        "categories": whole.select("split", F.inline("categories")),
    }


def missing_files(images: DataFrame, listing: DataFrame) -> DataFrame:
    """(split, file_name) of images without a file of that name in a listing."""
    return images.select("split", "file_name").join(listing.select(names.bare_name(F.col("path")).alias("file_name")), "file_name", "left_anti")


def with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Images with the array of their annotations in document order; an image without any has an empty one. Ids are unique within a split only."""
    own = annotations.groupBy("split", "image_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "category_id", "bbox"))).alias("items"))
    joined = images.join(own.withColumnRenamed("image_id", "id"), ["split", "id"], "left")
    return joined.withColumn("items", F.coalesce("items", F.array().cast(own.schema["items"].dataType)))


def unknown_categories(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations whose category the document doesn't list."""
    return annotations.join(as_list(categories.select("split", F.col("id").alias("category_id"))), ["split", "category_id"], "left_anti")  # a class list


def to_source(derived: DataFrame, raw: DataFrame) -> DataFrame:
    """Derived images with the raw image that each was made from."""
    r = raw.select(F.col("split").alias("source_split"), F.col("id").alias("source_image_id"), F.col("file_name").alias("source_file_name"))
    return derived.join(r, ["source_split", "source_image_id"], "left")


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame, split: str) -> DataFrame:
    """One row with the JSON text of a split's document. For documents of a size that a COCO file may have; larger sets stay in tables."""
    fields = lambda df: F.struct(*(c for c in df.columns if c not in ("split", "position")))
    listed = lambda df, name: df.where(F.col("split") == split).agg(F.array_sort(F.collect_list(fields(df))).alias(name))
    row = listed(images, "images").join(listed(annotations, "annotations")).join(listed(categories, "categories"))  # one row each
    return row.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))
