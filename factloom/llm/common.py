"""Shared helpers: reliable intermediate tables, range buckets and distributed offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.tables import materialize, shared_dir, table

__all__ = ["NULL_KEY", "as_struct", "bucket_of", "exclusive_sums", "let", "map_rows", "materialize", "own_columns", "partitions_for", "row_struct", "range_bounds", "shared_dir", "table"]

#: Stands for a null id where rows are put in order: nulls come first ascending, last descending.
NULL_KEY = -(2**63)


def own_columns(df: DataFrame) -> list[Column]:
    """All columns of df, also those whose names hold dots or other signs."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: the planner cannot put its expression in the place of each use, which inside a
    function of an array would compute it again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_struct(df: DataFrame) -> Column:
    """A row of df as one struct, in which names cannot clash with others."""
    return F.struct(*own_columns(df))


def map_rows(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """df with each Arrow batch of its rows changed where it is; columns keep their types and names, whatever these are."""

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = each(pa.RecordBatch.from_struct_array(batch.column(0)))
            yield pa.RecordBatch.from_arrays([as_struct(out)], ["row"])

    rows = df.select(row_struct(df).alias("row"))
    return rows.mapInArrow(changed, rows.schema).select("row.*")


def as_struct(batch: pa.RecordBatch) -> pa.Array:
    return pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))


def partitions_for(spark: SparkSession, rows: int, rows_per_partition: int) -> int:
    """Partitions so that one holds about rows_per_partition rows, never fewer than the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_partition), 1)


def range_bounds(df: DataFrame, key: Column, rows_per_bucket: int, max_buckets: int = 1 << 16) -> list[int]:
    """Ascending upper bounds (keys that occur in df) which part df into runs of about rows_per_bucket rows.

    The driver gets the bounds alone: max_buckets numbers at most. Beyond max_buckets * rows_per_bucket
    rows the buckets grow instead; they are sorted with spilling, so they need not fit in memory.
    """
    keyed = df.select(key.alias("k"))
    n, top = keyed.agg(F.count(F.lit(1)), F.max("k")).first()
    if not n:
        return []
    buckets = min(max_buckets, -(-n // rows_per_bucket))
    if buckets == 1:
        return [top]
    cuts = [i / buckets for i in range(1, buckets)]
    found = keyed.agg(F.percentile_approx("k", cuts, max(10_000, 20 * buckets))).first()[0]
    return sorted({*found, top})


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """Index of the first bound >= key, by a binary search inside a JVM expression."""
    if len(bounds) <= 1:
        return F.lit(0)
    among = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds) - 1).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.shiftright(at["lo"] + at["hi"], 1)
        below = F.get(among, mid) < key
        return F.struct(F.when(below, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, start, halve, lambda at: F.least(at["lo"], F.lit(len(bounds) - 1)))


def exclusive_sums(sizes: DataFrame, order: str, amount: str, name: str, block: int = 4096, by: str | None = None) -> DataFrame:
    """Add column `name`: the sum of `amount` over all rows with a smaller integer `order` (unique; within `by`, if given).

    Two levels: blocks of `block` consecutive orders are summed first, so no task sees more than one block
    or one row for each block.
    """
    own = [by] if by else []
    cut = sizes.withColumn("__block", F.floor(F.col(order) / block))
    totals = cut.groupBy(*own, "__block").agg(F.sum(amount).alias("__total"))
    before = Window.partitionBy(*own).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__base", F.coalesce(F.sum("__total").over(before), F.lit(0))).drop("__total")
    inner = Window.partitionBy(*own, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("__in", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .join(totals, [*own, "__block"])
        .withColumn(name, F.col("__base") + F.col("__in"))
        .drop("__block", "__base", "__in")
    )
