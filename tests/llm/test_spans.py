import random
from collections import defaultdict

import pytest

from curatrix.llm.automaton import SharedAutomaton
from curatrix.llm.spans import shared_length

SCHEMA = "doc_id bigint, text string, key string, content string, n int"


def brute(docs, least):
    owners = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            owners[t[i : i + least]].add(d)
    out = {}
    for d, t in docs:
        covered = {k for i in range(len(t or "") - least + 1) if len(owners[t[i : i + least]]) > 1 for k in range(i, i + least)}
        if covered:
            out[d] = len(covered)
    return out


def found(spark, docs, **how):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in docs], SCHEMA)  # columns named as the operator's own
    return {r["doc_id"]: r["shared_chars"] for r in shared_length(df, **how).collect()}


@pytest.mark.parametrize("shard_rows", [256, 1])
def test_as_brute_force(spark, shard_rows):
    rnd = random.Random(4)
    pieces = ["".join(rnd.choice("ab é𝄞") for _ in range(rnd.randint(5, 90))) for _ in range(10)]
    docs = [(d, "".join(rnd.choice(pieces)[rnd.randint(0, 20) :] for _ in range(rnd.randint(0, 5)))) for d in range(90)]
    docs += [(100, None), (101, ""), (102, "a" * 60), (103, "a" * 45), (104, "ab" * 30), (105, "ba" * 30)]
    docs += [(106, docs[3][1]), (107, docs[3][1])]
    assert found(spark, docs, least=20, shard_rows=shard_rows) == brute(docs, 20)


def test_very_long_text_and_null_id(spark):
    long = "".join(random.Random(1).choices("abcdefgh", k=300_000))
    docs = [(1, long), (2, long[1000:2000]), (None, long[:500]), (3, "z" * 20_000), (4, "z" * 300)]
    assert found(spark, docs) == {1: 1000, 2: 1000, 3: 20_000, 4: 300}


def test_a_passage_twice_in_one_record_is_not_shared(spark):
    passage = "".join(random.Random(2).choices("abcdefgh", k=250))
    assert found(spark, [(1, passage + "--" + passage), (2, passage[:199])]) == {}
    assert found(spark, [(1, passage), (1, passage)]) == {}


def test_no_rows(spark):
    assert found(spark, []) == {}


def test_statistics_of_a_text_outside():
    a = SharedAutomaton([("abcd", 1, 1), ("xbcy", 2, 2)])
    assert list(a.statistics("zbcd")) == [0, 1, 2, 0]
    assert a.spans("zbcd", 2) == [(1, 2)]
