"""Mixing sources to target weights (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stages, as_list


BUCKETS = 4096


def water_fill(sources: list[tuple[float, float, float]], total: float) -> list[float]:
    """The size that each source (weight, size, most repetitions) gives to a mix of the given total.

    Sources whose share exceeds their most are clamped to it; what they can't give is divided among the others in proportion to their weights,
    and so on until nobody exceeds it. If all are clamped, the mix stays smaller. Each step clamps a source or ends.
    """
    given = [0.0] * len(sources)
    open_ = {k for k, (weight, size, most) in enumerate(sources) if weight > 0 and size > 0 and most > 0}
    left = total
    while open_ and left > 0:
        weight = sum(sources[k][0] for k in open_)
        over = {k for k in open_ if sources[k][0] / weight * left > sources[k][1] * sources[k][2]}
        for k in over or open_:
            given[k] = sources[k][1] * sources[k][2] if over else sources[k][0] / weight * left
        if not over:
            break
        left -= sum(given[k] for k in over)
        open_ -= over
    return given


def source_key(column):
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


class Mix:
    """A plan to mix sized records by source.

    `sized` has a row (id, source, size) for every record; `targets` a row (source, weight, max_repeats) for each source to use, as few as sources
    are. Only their totals come to the driver, a row for each row of `targets`. Case and outer blanks of a source don't matter. Null sizes count
    as 0, null weights or repetitions as 0; a source in two rows of `targets` is an error. `total` is the size of the mix, by default that of all records.
    """

    def __init__(self, sized: DataFrame, id_col: str, source_col: str, size_col: str, targets: DataFrame, total: float | None = None, seed: int = 5):
        self.spark = sized.sparkSession
        self.id_col, self.seed = id_col, seed
        self.sized = sized.select(F.col(id_col).alias("id"), source_key(F.col(source_col)).alias("key"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("size"))
        wanted = targets.select(F.col("source").alias("name"), source_key(F.col("source")).alias("key"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("most"))
        by_key = self.sized.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("records"))
        known = as_list(wanted.where("key IS NOT NULL"))
        matched = by_key.join(known, "key", "left").groupBy("name", "key", "weight", "most").agg(F.sum("size").alias("size"), F.sum("records").alias("records"))
        # unlisted sources, however many, become one row, for the size of all
        totals = matched.groupBy("name", F.when(F.col("name").isNotNull(), F.col("key")).alias("key")).agg(F.sum("size").alias("size"), F.sum("records").alias("records")).collect()
        self.targets = wanted.collect()
        if len({t["key"] for t in self.targets}) < len(self.targets):
            raise ValueError("a source stands twice in the targets")
        have = {r["key"]: (r["size"], r["records"]) for r in totals if r["name"] is not None}
        self.all = sum(r["size"] for r in totals)
        self.total = self.all if total is None else total
        self.have = [have.get(t["key"], (0, 0)) for t in self.targets]
        self.given = water_fill([(t["weight"], h[0], t["most"]) for t, h in zip(self.targets, self.have)], self.total)

    def report(self) -> DataFrame:
        """A row for each target: what it has, may give and gives, its repetitions and share, and whether its own weight can be reached."""
        mix = sum(self.given) or 1.0
        rows = [
            (t["name"], float(t["weight"]), int(t["most"]), int(size), int(n), float(g), g / size if size else 0.0, g / mix, bool(t["most"] * size >= t["weight"] * self.total))
            for t, (size, n), g in zip(self.targets, self.have, self.given)
        ]
        return self.spark.createDataFrame(rows, "source string, weight double, max_repeats int, size bigint, records bigint, given double, repetitions double, share double, reachable boolean")

    def uses(self) -> DataFrame:
        """(id, source, size, uses): how often each record of a target source is used, if at all.

        A source repeated r times uses each of its records floor(r) times, and some once more: in the order of their hashes with the seed, those up to the size that
        is left to give, so the share reached is as planned but for part of one record. No record is used more than max_repeats times.
        Sums by bucket of the hash tell which buckets are taken whole; only of the one bucket of a source in which its size is reached are records put in order.
        """
        rows = []
        for t, (size, _), given in zip(self.targets, self.have, self.given):
            if t["key"] is not None:
                whole = min(int(t["most"]), int(given / size + 1e-9)) if size else 0
                rows.append((t["key"], t["name"], whole, max(0.0, given - whole * size) if whole < t["most"] else 0.0))
        plan = F.broadcast(self.spark.createDataFrame(rows, "key string, source string, whole int, more double"))  # as many rows as there are target sources
        hashed = self.sized.join(plan, "key").withColumn("h", F.xxhash64("id", "key", F.lit(self.seed))).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)))
        sums = hashed.groupBy("key", "bucket").agg(F.sum("size").alias("s"))
        ends = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("key").orderBy("bucket")))  # at most BUCKETS rows a source
        placed = hashed.join(F.broadcast(ends), ["key", "bucket"])  # at most BUCKETS rows a source
        inside = F.col("upto") - F.col("s") + F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
        cut = (F.col("upto") > F.col("more")) & (F.col("upto") - F.col("s") < F.col("more"))
        clear = placed.where(~cut).withColumn("extra", (F.col("upto") <= F.col("more")).cast("int"))
        parted = placed.where(cut).withColumn("extra", (inside - F.col("size") / 2 <= F.col("more")).cast("int"))
        used = clear.unionByName(parted).withColumn("uses", F.col("whole") + F.col("extra") * (F.col("more") > 0).cast("int")).where("uses > 0")
        return used.select(F.col("id").alias(self.id_col), "source", "size", "uses")

    def reached(self) -> DataFrame:
        """The shares that the uses really give, by source, of the sizes used."""
        used = self.uses().groupBy("source").agg(F.sum(F.col("size") * F.col("uses")).alias("used"), F.sum("uses").cast("bigint").alias("records_used"))
        whole = used.agg(F.sum("used").alias("mix"))
        got = used.join(F.broadcast(whole)).select("source", "used", "records_used", F.try_divide("used", "mix").alias("reached"))  # one row
        return self.report().join(F.broadcast(got), "source", "left").fillna(0, ["used", "records_used"]).fillna(0.0, ["reached"])


def mix_documents(docs: DataFrame, targets: DataFrame, tokenizer: str | None = None) -> Mix:
    """Documents by source, sized in tokens, counted once and written."""
    from .tokens import counted_with

    sized = Stages(docs.sparkSession).write(counted_with(docs, ["doc_id", "source"], "text", tokenizer), "sized")
    return Mix(sized, "doc_id", "source", "tokens", targets)
