import os

import oracle
import pytest

from curatrix.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_as_its_sql(spark, con, name):
    oracle.agree(spark, con, queries.queries()[name], queries.oracle_sql()[name])


def test_chosen_images_are_of_the_size_wanted(spark):
    rows = queries.p1_chosen(spark, oracle.DATA).collect()
    images = queries.image_features(spark, oracle.DATA).count()
    assert len(rows) == len(set(rows)) == min(queries.SUBSET_SIZE, images // 2) > 0


def test_related_images_share_a_split(spark):
    split = {r["image_id"]: r["split"] for r in queries.p2_assigned(spark, oracle.DATA).collect()}
    images = {r["file"]: r["image_id"] for r in queries.image_splits(spark, oracle.DATA).collect()}
    assert set(split) == set(images.values())
    groups = {}
    for r in queries.confirmed_files(spark, oracle.DATA).collect():
        if r["file"] in images:
            groups.setdefault(r["group_id"], set()).add(split[images[r["file"]]])
    assert groups and all(len(s) == 1 for s in groups.values())


def test_packing_of_the_documents(spark):
    fill = queries.p8_fill(spark, oracle.DATA).first()
    assert fill["least_possible"] <= fill["containers"] <= fill["least_possible"] + 2
    divided = {r["doc_id"] for r in queries.p8_found(spark, oracle.DATA).collect()}
    large = queries.tokens.counted_with(queries.table(spark, oracle.DATA, "documents"), ["doc_id"], "text").where("tokens > 4096")
    assert divided == {r["doc_id"] for r in large.collect()}


def test_shares_of_the_mix(spark):
    report = {r["source"]: r for r in queries.p9_shares(spark, oracle.DATA).collect()}
    short = {r["source"] for r in queries.p9_found(spark, oracle.DATA).collect()}
    assert short == {s for s, r in report.items() if not r["reachable"]}
    assert sum(r["share"] for r in report.values()) == pytest.approx(1)
    for r in report.values():
        assert r["given"] <= r["size"] * r["max_repeats"] + 1e-6
