"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exclusive_sums, own_columns, partitions_for, row_struct


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Exact draw: the good ones among n taken without return; totals may be of any size.

    Inverts the distribution over twelve deviations about its mode (beyond them lies less than 1e-30).
    """
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    spread = int(12 * math.sqrt(max(1.0, n / total * good * (bad / total) * ((total - n) / max(1, total - 1))))) + 24
    low, high = max(low, mode - spread), min(high, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    weight = np.concatenate(([0.0], np.cumsum(steps)))
    mass = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def split_counts(rng: np.random.Generator, room: list[int], taken: int) -> list[int]:
    """How many of `taken` rows go to each column that has `room`: a multivariate hypergeometric draw."""
    left, out = sum(room), []
    for r in room:
        got = hypergeometric(rng, r, left - r, taken)
        out.append(got)
        left, taken = left - r, taken - got
    return out


def matrix_row(sizes: list[int], room: list[int], row: int, seed: int | list[int]) -> list[int]:
    """Row `row` of the communication matrix with row sums `sizes` and column sums `room`.

    Rows are halved again and again; each half's share of the columns is one draw, seeded by its range, so
    any task finds its own row in O(columns * log rows) and no one holds the matrix.
    """
    seed = [seed] if isinstance(seed, int) else seed
    lo, hi, sums = 0, len(sizes), np.concatenate(([0], np.cumsum(np.array(sizes, dtype=object))))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        upper = split_counts(np.random.default_rng([*seed, lo, hi]), room, int(sums[mid] - sums[lo]))
        if row < mid:
            room, hi = upper, mid
        else:
            room, lo = [r - u for r, u in zip(room, upper, strict=True)], mid
    return room


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def matrix(sizes: list[int], room: list[int], seed: list[int]) -> list[list[int]]:
    """All rows of the communication matrix, drawn along the same halves as matrix_row draws one."""
    sums, out = np.concatenate(([0], np.cumsum(np.array(sizes, dtype=object)))), [room] * len(sizes)
    todo = [(0, len(sizes), room)] if sizes else []
    while todo:
        lo, hi, room = todo.pop()
        if hi - lo == 1:
            out[lo] = room
            continue
        mid = (lo + hi) // 2
        upper = split_counts(np.random.default_rng([*seed, lo, hi]), room, int(sums[mid] - sums[lo]))
        todo += [(lo, mid, upper), (mid, hi, [r - u for r, u in zip(room, upper, strict=True)])]
    return out


class Deal:
    """Who gets what: which shard each row of an input partition goes to, and the random number that orders it there.

    Partitions form about sqrt(partitions) groups. The counts from groups to shards are drawn once, by the driver; a task
    draws its partition's row from its group's counts alone, in shards * log(partitions of a group) steps."""

    def __init__(self, sizes: list[int], per_shard: list[int], seed: int):
        self.sizes, self.seed = np.array(sizes, np.int64), seed
        self.width = max(1, math.isqrt(len(sizes)))
        groups = [int(x) for x in np.add.reduceat(self.sizes, np.arange(0, len(sizes), self.width))] if sizes else []
        self.rooms = matrix(groups, per_shard, [seed, 2])

    def rows(self, partition: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and random number of each row of a partition: the same in every pass."""
        if partition >= len(self.sizes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        group, place = divmod(partition, self.width)
        own = self.sizes[group * self.width : (group + 1) * self.width].tolist()
        row = matrix_row(own, self.rooms[group], place, [self.seed, 3, group])
        rng = np.random.default_rng([self.seed, 1, partition])
        return rng.permutation(np.repeat(np.arange(len(row)), row)), rng.integers(0, 2**62, sum(row))


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 20, cell_rows: int = 1 << 11, max_cells: int | None = None) -> DataFrame:
    """docs with columns __shard (0 to n_shards - 1) and __slot (gapless from 0 in each shard): a uniformly
    random arrangement in which shard sizes differ by one at most.

    A first pass counts the rows of each input partition. The counts from partitions to shards are drawn from the exact
    law; each partition deals its rows in random order to fill its row of the matrix, rows move once, and each shard is
    ordered by random numbers. A shard is cut into even ranges of those numbers, of cell_rows rows or so, each a unit of
    work whose place follows from the counts of the ranges before it; so no task holds a shard, at any size. docs must have
    stable partitions, as a scan or a written table has: a task whose partition changed between the passes raises and
    nothing is misdealt. max_cells limits nothing any more: no number of ranges costs a task more draws.

    Every row counts, with null or equal values too; equal texts are dealt like any others. An empty table
    gives an empty one. All columns stay, whatever their names, but those named __shard or __slot, which are replaced.
    """
    spark = docs.sparkSession
    docs = docs.select(*[c for c, n in zip(own_columns(docs), docs.columns, strict=True) if n not in ("__shard", "__slot")])
    if not docs.columns:
        docs = docs.withColumn("__none", F.lit(True))
    counted = docs.groupBy(F.spark_partition_id().alias("p")).count().collect()  # one number for each partition
    sizes = [0] * (max((r["p"] for r in counted), default=-1) + 1)
    for r in counted:
        sizes[r["p"]] = r["count"]
    total = sum(sizes)
    if not total:
        return docs.withColumns({"__slot": F.lit(0).cast("bigint"), "__shard": F.lit(0)}).where("false")
    per_shard = even(total, n_shards)
    ranges = -(-per_shard[0] // cell_rows)
    plan = spark.sparkContext.broadcast(Deal(sizes, per_shard, seed))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, order = _own(plan)
        used = 0
        for batch in batches:
            own = slice(used, used + batch.num_rows)
            used += batch.num_rows
            if used > len(shard):
                raise RuntimeError("a partition has more rows than were counted: write the input to a table first")
            part = [shard[own], order[own] // -(-(2**62) // ranges), order[own]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in part)], ["row", "shard", "range", "order"])
        if used < len(shard):
            raise RuntimeError("a partition has fewer rows than were counted: write the input to a table first")

    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(n, T.LongType()) for n in ("shard", "range", "order"))])
    dealt = docs.select(row_struct(docs).alias("row")).mapInArrow(deal, schema)
    tie = F.xxhash64(*[F.col(f"row.{'`' + c.replace('`', '``') + '`'}") for c, t in docs.dtypes if "map<" not in t] or [F.lit(0)])
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy("order", tie)) - 1
    if ranges > 1:
        dealt = dealt.repartition(partitions_for(spark, n_shards * ranges, 1), "shard", "range")
    ranked = dealt.withColumn("rank", rank)
    if ranges > 1:
        counts = docs.select(F.lit(1).alias("one")).mapInArrow(_counter(plan, ranges), "shard bigint, range bigint, n bigint").groupBy("shard", "range").agg(F.sum("n").alias("n"))
        before = exclusive_sums(counts, "range", "n", "before", by="shard").select("shard", "range", "before")
        ranked = ranked.join(before, ["shard", "range"]).withColumn("rank", F.col("before") + F.col("rank"))
    return ranked.select("row.*", F.col("rank").cast("bigint").alias("__slot"), F.col("shard").cast("int").alias("__shard")).drop("__none")


def _own(plan: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    task = TaskContext.get()
    return plan.value.rows(task.partitionId() if task else 0)


def _counter(plan: Broadcast, ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows by shard and range, from the draws alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        shard, order = _own(plan)
        key, n = np.unique(shard * ranges + order // -(-(2**62) // ranges), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key // ranges), pa.array(key % ranges), pa.array(n)], ["shard", "range", "n"])

    return count
