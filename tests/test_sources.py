import json

import pytest
from pyspark.sql import functions as F

from curatrix.sources import coco, files, labels, tabular


def test_coco_round_trip(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 10, "height": 20}], "annotations": [{"id": 5, "image_id": 1, "category_id": 3, "bbox": [1, 2, 3, 4]}, {"id": 6, "image_id": 1, "category_id": 9, "bbox": []}], "categories": [{"id": 3, "name": "Acne"}]}
    (tmp_path / "valid.json").write_text(json.dumps(doc, indent=1))
    t = coco.read(spark, {"valid": str(tmp_path / "valid.json")})
    both = {r["file_name"]: r["items"] for r in coco.with_annotations(t["images"], t["annotations"]).collect()}
    assert [i["id"] for i in both["a.jpg"]] == [5, 6] and both["b.jpg"] == []
    assert [r["split"] for r in t["images"].select("split").distinct().collect()] == ["val"]
    assert [r["id"] for r in coco.unknown_categories(t["annotations"], t["categories"]).collect()] == [6]
    listing = spark.createDataFrame([("x/a.jpg",)], "path string")
    assert [r["file_name"] for r in coco.missing_files(t["images"], listing).collect()] == ["b.jpg"]
    back = json.loads(coco.document(t["images"], t["annotations"], t["categories"], "val").first()["value"])
    assert [i["id"] for i in back["images"]] == [1, 2] and back["annotations"][0]["bbox"] == [1.0, 2.0, 3.0, 4.0]


def test_labels_round_trip(spark, tmp_path):
    images = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "c")], "split string, stem string")
    rows = spark.createDataFrame([("train", "a", 2, "1 .5 .5 .1 .1"), ("train", "a", 1, "0 .5 .5 .1 .1"), ("val", "c", 1, "x")], "split string, stem string, position int, line string")
    assert labels.write(labels.contents(rows, images), str(tmp_path / "labels")) == 3
    assert (tmp_path / "labels/train/a.txt").read_text() == "0 .5 .5 .1 .1\n1 .5 .5 .1 .1\n" and (tmp_path / "labels/train/b.txt").read_text() == ""
    got = sorted((r["split"], r["stem"], r["line_no"], r["class_id"], r["width"]) for r in labels.boxes(labels.read(spark, str(tmp_path / "labels"))).collect())
    assert got == [("train", "a", 1, 0, 0.1), ("train", "a", 2, 1, 0.1), ("val", "c", 1, None, None)]


def test_manifest_copy_and_guards(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.JPG").write_bytes(b"1")
    (tmp_path / "in/sub/b.txt").write_bytes(b"2" * 1000)
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    assert files.listing(spark, root, files.IMAGE_SUFFIXES).count() == 1
    m = files.manifest(spark, root).cache()
    assert sorted(r["path"] for r in m.collect()) == ["a.JPG", "sub/b.txt"]
    assert sorted(map(tuple, files.copy_files(m, root, out).collect())) == sorted(map(tuple, m.collect()))
    files.assert_unchanged(m, files.manifest(spark, out))
    (tmp_path / "out/a.JPG").write_bytes(b"3")
    (tmp_path / "out/new").write_bytes(b"")
    (tmp_path / "out/sub/b.txt").unlink()
    spark.catalog.clearCache()
    assert sorted(map(tuple, files.manifest_changes(m, files.manifest(spark, out)).collect())) == [("a.JPG", "changed"), ("new", "added"), ("sub/b.txt", "removed")]
    with pytest.raises(FileExistsError):
        files.refuse_if_exists(spark, out)
    with pytest.raises(PermissionError):
        files.overwrite_only(spark, str(tmp_path), out)
    assert not files.exists(spark, files.overwrite_only(spark, out, out))
    assert files.free_space_suffices(str(tmp_path), 0) and not files.free_space_suffices(str(tmp_path), 1 << 60)


def test_empty_files_and_changed_copies(spark, tmp_path):
    for name in ("in/e", "in/a/e1", "in/a/b/e2", "in/a/b/_hidden", "in/c/.e3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "in/a/full").write_bytes(b"1")
    root = str(tmp_path / "in")
    assert sorted(r["path"].rpartition("/")[2] for r in files.empty_files(spark, root).collect()) == ["e", "e1", "e2"]
    assert [r["path"].rpartition("/")[2] for r in files.empty_files(spark, root, recursive=False).collect()] == ["e"]
    wrong = files.manifest(spark, root).where("path = 'a/full'").withColumn("sha256", F.lit("0" * 64))
    with pytest.raises(Exception, match="isn't what was to be copied"):
        files.copy_files(wrong, root, str(tmp_path / "out")).collect()


def test_csv(spark, tmp_path):
    schema = "pair_id string, notes string, human_decision string"
    df = spark.createDataFrame([("D1", 'say "a", b', "PENDING"), ("D2", None, "PENDING"), ("D3", "two\nlines", "PENDING")], schema)
    path = str(tmp_path / "review")
    assert tabular.write_checked(df, path, schema, ("human_decision", "PENDING")) == 3
    assert sorted(map(tuple, tabular.read_csv(spark, path, schema).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (tmp_path / "bom.csv").write_bytes(tabular.csv_bytes(df, ["pair_id", "human_decision"]))
    assert [r["pair_id"] for r in tabular.read_csv(spark, str(tmp_path / "bom.csv"), "pair_id string, human_decision string").collect()] == ["D1", "D2", "D3"]
    with pytest.raises(RuntimeError):
        tabular.write_checked(df, str(tmp_path / "other"), schema, ("human_decision", "DONE"))


def test_documents(spark, tmp_path):
    path = str(tmp_path / "r.json")
    tabular.write_json(spark, path, {"b": 1, "a": [None, "é"]}, exclusive=True)
    assert json.loads(open(path).read()) == {"a": [None, "é"], "b": 1}
    with pytest.raises(FileExistsError):
        tabular.write_json(spark, path, {}, exclusive=True)
    tabular.write_data_yaml(spark, str(tmp_path / "data.yaml"), "root", {1: "wrinkle", 0: "acne"})
    assert (tmp_path / "data.yaml").read_text().splitlines()[-2:] == ["  0: acne", "  1: wrinkle"]
    assert "| a |" in tabular.markdown(spark.createDataFrame([(1.5,)], "a double"), "t") and "1.5" in tabular.markdown(spark.createDataFrame([(1.5,)], "a double"), "t")
    assert tabular.summary({"images": 3}) == "images  3"


def test_class_config(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("canonical_classes:\n  0: acne\n  1: wrinkle\napproved_source_mapping:\n  Acne: acne\n  Wrinkles: wrinkle\nexcluded_source_classes:\n  - Eyebags\n")
    mapping, excluded = tabular.class_config(spark, str(tmp_path / "c.yaml"))
    assert sorted(map(tuple, mapping.collect())) == [("Acne", 0, "acne"), ("Wrinkles", 1, "wrinkle")] and excluded == ["Eyebags"]
