"""Long exact spans shared between records (problem 10).

A window of `least` characters occurs in another record or it doesn't; a record's shared characters are those in such windows.
Windows meet by their rarest-hash gram: of all grams of `gram` characters in a window, the one of least hash is the same wherever the
window stands. Runs of windows with the same least gram form a snippet. Snippets of one gram form a reference shard, if they are of more than one
record: a suffix automaton of the shard is built and each of its snippets is streamed through it for matching statistics.
Equal snippets are one row before that, so copies, however many, cost one row a shard.

The automata aren't broadcast: all of them together grow as the texts do, and every record would have to meet every one.
Instead, a shard goes to the only records that can match it. A gram with more than `shard_rows` different snippets or `shard_chars`
characters in them (long boilerplate before different texts) would need an automaton larger than a worker's memory should hold; its windows
are counted one by one by their 128-bit hash instead, which is exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stages
from .automaton import SharedAutomaton

_U = np.uint64


def _chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k elements, from hashes of runs of 1, 2, 4 and so on."""
    out, have, power, size = None, 0, h, 1
    while True:
        step = _U(0x94D049BB133111EB + 2 * size)
        if k & size:
            if out is None:
                out, have = power, size
            else:
                out = out[: len(power) - have] * step + power[have:]
                have += size
        if size * 2 > k:
            return out
        power = power[:-size] * step + power[size:]
        size *= 2


def _least_in_windows(g: np.ndarray, width: int) -> np.ndarray:
    m, size = g, 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(g) - width + 1], m[width - size :])


def snippet_runs(texts: list[str], least: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts of `least` characters or more: text number, gram hash, snippet hash, first window, windows of each run."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    starts, stops = ends - lengths, ends - least + 1
    h = (points.astype(_U) + _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    g = _chained(h, gram)
    g = (g ^ (g >> _U(31))) * _U(0xD6E8FEB86659FD93)
    g ^= g >> _U(32)
    m = _least_in_windows(g, least - gram + 1)
    cuts = np.unique(np.concatenate([np.flatnonzero(m[1:] != m[:-1]) + 1, starts, stops]))
    first, after = cuts[:-1], cuts[1:]
    which = np.searchsorted(starts, first, side="right") - 1
    inside = first < stops[which]
    first, after, which = first[inside], after[inside], which[inside]
    raw = memoryview(points).cast("B")
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(raw[4 * a : 4 * (b + least - 1)]) for a, b in zip(first.tolist(), after.tolist())), dtype=_U, count=len(first))
    return which, m[first].view(np.int64), content.view(np.int64), (first - starts[which]).astype(np.int32), (after - first).astype(np.int32)


def _find_runs(least: int, gram: int, chars: int = 1 << 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            rows = [i for i, t in enumerate(texts) if t is not None and len(t) >= least]
            at = 0
            while at < len(rows):
                end, size = at, 0
                while end < len(rows) and (end == at or size + len(texts[rows[end]]) <= chars):
                    size += len(texts[rows[end]])
                    end += 1
                part = rows[at:end]
                which, key, content, first, n = snippet_runs([texts[i] for i in part], least, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(content), ids.take(pa.array(np.asarray(part)[which])), pa.array(first), pa.array(n)],
                    names=["key", "content", "id", "first", "n"],
                )
                at = end

    return run


def _cut(least: int, whole: bool, rows: int = 20_000):
    """From texts with the runs asked of them, the snippets, or the hashes of their windows; some `rows` of them a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = _owner_types(batch.schema)
            held: list[list] = [[] for _ in range(len(owner) + (1 if whole else 2))]
            types = [*owner.values(), pa.string()] if whole else [pa.binary(), *owner.values(), pa.int32()]
            names = [*owner, "snippet"] if whole else ["window", *owner, "at"]

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types)], names=names)  # noqa: B023
                for c in held:  # noqa: B023
                    c.clear()
                return out

            for text, runs in zip(batch.column("text"), batch.column("runs").to_pylist()):
                text = text.as_py()
                for r in runs:
                    if whole:
                        for c, v in zip(held, [*(r[k] for k in owner), text[r["first"] : r["first"] + r["n"] + least - 1]]):
                            c.append(v)
                    else:
                        windows = range(r["n"])
                        held[0] += [xxhash.xxh3_128_digest(text[r["first"] + i : r["first"] + i + least].encode("utf-8", "surrogatepass")) for i in windows]
                        for c, k in zip(held[1:], owner):
                            c += [r[k]] * r["n"]
                        held[-1] += windows
                    if len(held[0]) >= rows:
                        yield flush()
            if held[0]:
                yield flush()

    return run


def _owner_types(schema: pa.Schema) -> dict[str, pa.DataType]:
    fields = {f.name: f.type for f in schema.field("runs").type.value_type}
    return {k: fields[k] for k in ("key", "content", "low", "high")}


def _match(least: int):
    """Rows come sorted by gram; a shard is held until its last snippet is there."""

    def spans(key: int, shard: list[tuple]) -> list[tuple[int, int, int, int]]:
        automaton = SharedAutomaton((snippet, low, high) for _, low, high, snippet in shard)
        return [(key, content, a, b) for content, _, _, snippet in shard for a, b in automaton.spans(snippet, least)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["key", "content", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "content", "low", "high", "snippet")]
            for key, *row in zip(*columns):
                if key != now:
                    if shard:
                        out += spans(now, shard)
                    now, shard = key, []
                    if len(out) > 10_000:
                        yield table(out)
                        out = []
                shard.append(tuple(row))
        if shard:
            out += spans(now, shard)
        yield table(out)

    return run


def shared_windows(docs: DataFrame, id_col: str, text_col: str, least: int = 200, gram: int | None = None, shard_rows: int = 256, shard_chars: int = 1 << 17) -> DataFrame:
    """(id, start, stop, way): character ranges of each record that occur in another record, each `least` long or longer, and how they were found: AUTOMATON, or
    WINDOW, by the hash of each window in a shard too large for an automaton.

    Ranges of one record may overlap or touch. Nulls and texts shorter than `least` have none. A passage twice in one record isn't shared
    by that. Rows with a null id have no ranges; the same id in several rows counts as one record and as its rows' texts each.
    """
    gram = gram or (least + 1) // 2
    spark = docs.sparkSession
    stages = Stages(spark)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= least))
    kind = src.schema["id"].dataType.simpleString()
    runs = stages.write(src.mapInArrow(_find_runs(least, gram), f"key long, content long, id {kind}, first int, n int"), "runs")
    keys = runs.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    mine = stages.write(runs.join(keys, "key").select("key", "content", "id", "first", "n"), "met")
    stages.drop(runs)
    snippets = mine.groupBy("key", "content").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("n").alias("n"))
    size = snippets.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.col("n") + least).alias("chars"))
    wide = size.select("key", ((F.col("m") > shard_rows) | (F.col("chars") > shard_chars)).alias("wide"))
    places = mine.groupBy("key", "content", "id").agg(F.min("first").alias("first"))
    asked = snippets.join(places.withColumnRenamed("id", "low"), ["key", "content", "low"]).join(wide, "key")
    asked = asked.groupBy(F.col("low").alias("id"), "wide").agg(F.collect_list(F.struct("key", "content", "low", "high", "first", "n")).alias("runs"))
    cut = stages.write(src.join(asked, "id").select("text", "runs", "wide"), "asked")
    owner = f"key long, content long, low {kind}, high {kind}"
    pieces = cut.where(~F.col("wide")).select("text", "runs").mapInArrow(_cut(least, True), f"{owner}, snippet string")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, else small snippets, costly to match, end in one task
    spans = pieces.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_match(least), "key long, content long, a int, b int")
    windows = cut.where("wide").select("text", "runs").mapInArrow(_cut(least, False), f"window binary, {owner}, at int")
    twice = windows.groupBy("window").agg(F.min("low").alias("lo"), F.max("high").alias("hi")).where("lo <> hi").select("window")
    single = windows.join(twice, "window").select("key", "content", F.col("at").alias("a"), (F.col("at") + 1).alias("b"))
    ranges = spans.withColumn("way", F.lit("AUTOMATON")).unionByName(single.withColumn("way", F.lit("WINDOW")))
    return mine.join(ranges, ["key", "content"]).select("id", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") + least - 1).alias("stop"), "way")


def shared_length(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, **how) -> DataFrame:
    """(id_col, shared_chars): for each record with a shared span, its characters that lie in one, each counted once."""
    ranges = shared_windows(docs, id_col, text_col, least, **how)
    order = Window.partitionBy("id").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("stop") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))
    return ranges.select("id", "start", "stop", F.greatest(new, F.lit(0)).alias("new")).groupBy("id").agg(F.sum("new").cast("bigint").alias("shared_chars")).withColumnRenamed("id", id_col)
