import random
from collections import defaultdict

from curatrix.llm import packing, tokens


def test_local_search_beats_its_start_and_keeps_the_rules():
    rnd = random.Random(7)
    sizes = [rnd.randint(1, 900) for _ in range(3000)]
    start = packing._Bins(4096, 0.995)
    start.next_fit(sizes)
    bins = packing.pack(sizes, 4096)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in b) for b in bins) <= 4096
    least = -(-sum(sizes) // 4096)
    assert len(bins) < len(start.items) and len(bins) <= least * 1.02 + 1


def test_exchanges_empty_a_bin():
    # next fit leaves 6+3 | 5+4 | 4+6 | 2 of 12; two bins less than that are never enough, one less is
    assert len(packing.pack([6, 3, 5, 4, 4, 6, 2], 12, 1.0)) == 3


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, tokens bigint, container string, size int")
    return packing.fill_containers(df, "doc_id", "tokens", **how).collect()


def test_containers(spark):
    rnd = random.Random(8)
    rows = [(k, rnd.randint(0, 120)) for k in range(700)] + [(1000, 1000), (1001, 100), (1002, None), (1003, -5), (None, 7)]
    rows += [rows[0], rows[0]]
    out = run(spark, rows, capacity=100, shard_items=200)
    fill, pieces = defaultdict(int), defaultdict(list)
    for r in out:
        fill[r["container"]] += r["size"]
        pieces[r["doc_id"]].append(r)
    assert max(fill.values()) <= 100
    assert sum(r["size"] for r in pieces[1000]) == 1000 and sorted(r["first"] for r in pieces[1000]) == list(range(0, 1000, 100))
    assert [r["size"] for r in pieces[1002]] == [0] and [r["size"] for r in pieces[1003]] == [0]
    assert None not in pieces and len(pieces[1001]) == 1
    want = defaultdict(set)
    for d, t in rows:
        if d is not None:
            want[d].add(max(t or 0, 0))
    assert {d: sum(v) for d, v in want.items()} == {d: sum(r["size"] for r in v) for d, v in pieces.items()}
    least = -(-sum(fill.values()) // 100)
    assert len([f for f in fill.values() if f]) <= least * 1.08


def test_no_rows(spark):
    assert run(spark, []) == []


def test_token_counts(spark):
    texts = [(1, "a b c"), (2, ""), (3, None), (4, "x" * 20_000), (5, "<|endoftext|> é𝄞")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.counted_with(df, ["doc_id"], "text").collect()}
    encode = tokens.encoding(tokens.vocabulary_path()).encode_ordinary
    assert got == {d: len(encode(t)) if t else 0 for d, t in texts}
