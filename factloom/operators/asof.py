"""As-of join: each row meets the latest record of its key that is not later than it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def asof_join(rows: DataFrame, records: DataFrame, key: str, at: str, into: str, width: float) -> DataFrame:
    """rows with the struct `into`: the record (of records, which has the columns key and at) that has the row's key and the
    greatest `at` that is not greater than the row's; null without one. Rows without a key or time meet none. Of records at
    the same time the greatest counts, by their columns in order.

    Time is cut into stretches of `width`. A row looks among the records of its own stretch, and else takes the last
    record of the stretches before; so a key with most of the rows is as many pieces of work as it has stretches, and
    only one record for each stretch is looked at over a key's whole time.
    """
    names = [c for c in records.columns if c not in (key, at)]
    record = F.struct(F.col(at).alias("at"), *names)
    stretch = F.floor(F.col(at) / width)
    known = records.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.col(at).alias("__at"), stretch.alias("__stretch"), record.alias("__record"))
    known = known.groupBy("__key", "__at", "__stretch").agg(F.max("__record").alias("__record"))
    row = F.struct(*rows.columns)
    asked = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), stretch.alias("__stretch"), row.alias("__row"))

    last = known.groupBy("__key", "__stretch").agg(F.max_by("__record", "__at").alias("__record"))
    wanted = asked.select("__key", "__stretch").distinct().where("__key is not null")
    both = last.unionByName(wanted, allowMissingColumns=True).groupBy("__key", "__stretch").agg(F.max("__record").alias("__record"), F.max(F.col("__record").isNull()).alias("__asked"))
    before = Window.partitionBy("__key").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("__before", F.last("__record", ignorenulls=True).over(before)).where("__asked").select("__key", "__stretch", "__before")

    within = Window.partitionBy("__key", "__stretch").orderBy("__at", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = known.unionByName(asked, allowMissingColumns=True).withColumn("__own", F.last("__record", ignorenulls=True).over(within)).where("__row is not null")
    found = met.join(carried, ["__key", "__stretch"], "left")
    usable = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    return found.select("__row.*", F.when(usable, F.coalesce("__own", "__before")).alias(into))


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first condition that holds; null if none does."""
    out: Column | None = None
    for condition, name in checks:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return F.lit(None).cast("string") if out is None else out
