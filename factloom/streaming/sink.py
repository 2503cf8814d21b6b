"""The job sink: what a finished job writes to several tables appears at once, or not at all.

A batch of puts is written table by table, each under its batch number, and counts only when the ledger has an entry for
it, which is one file and the last thing written. A batch that comes again after that changes nothing; one that was
interrupted before is written again over what it left. Readers take committed batches alone, so they never see a job
without its snapshots, its completed claim or its part of the metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.store import STATES

PUT = (
    "seq bigint, tenant string, job_id string, idem string, request_hash string, owner string, created_at string, result string, pages_fetched bigint, "
    "fields array<struct<field_name:string,state:string>>, snapshots array<struct<snapshot_hash:string,raw:binary,encoding:string,content_type:string>>"
)
_DELTA = ", ".join(["tenant string", "jobs bigint", "pages_fetched bigint", *(f"{s}_fields bigint" for s in STATES)])
#: Tables in the order in which a batch writes them, with their columns; what comes later is derived from `outcomes`.
TABLES = {
    "outcomes": "seq bigint, tenant string, job_id string, idem string, request_hash string, owner string, accepted boolean, error string",
    "jobs": "tenant string, job_id string, idem string, request_hash string, created_at string, result string",
    "snapshots": "tenant string, job_id string, snapshot_hash string, raw binary, encoding string, content_type string",
    "completions": "tenant string, idem string, request_hash string, owner string",
    "metrics": _DELTA,
}
Claims = Callable[[SparkSession], DataFrame]


def create(spark: SparkSession, root: str) -> None:
    """An empty sink below root, a folder that all executors share; one that is there stays as it is."""
    for name, schema in (*TABLES.items(), ("ledger", "puts bigint")):
        spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/batch=-1")


def _all(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/{name}")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(batch, puts) of committed batches."""
    return _all(spark, root, "ledger", "puts bigint")


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's rows of committed batches."""
    return _all(spark, root, name, TABLES[name]).join(ledger(spark, root).select("batch"), "batch", "left_semi")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    """Counters of each tenant: the sum of what each committed batch added, whatever was deleted since."""
    names = [c.split()[0] for c in _DELTA.split(", ")][1:]
    return committed(spark, root, "metrics").groupBy("tenant").agg(*[F.sum(c).alias(c) for c in names])


def _decided(puts: DataFrame, claims: DataFrame, done: DataFrame) -> DataFrame:
    """puts with accepted and error. A put needs the pending claim of its request and owner; of several that have it the
    first completes it, and the claim of an earlier batch is complete already: all others have lost it."""
    key = ["tenant", "idem", "request_hash", "owner"]
    held = claims.where("state = 'pending'").join(done, key, "left_anti").select(*key, F.lit(True).alias("held")).distinct()
    first = F.row_number().over(Window.partitionBy(*key).orderBy("seq", "job_id")) == 1
    out = puts.join(held, key, "left").withColumn("accepted", F.coalesce("held", F.lit(False)) & first).drop("held")
    return out.withColumn("error", F.when(~F.col("accepted"), "CLAIM_LOST"))


def _is(state: str) -> Callable[[Column], Column]:
    return lambda s: s == state


def commit(batch: DataFrame, number: int, root: str, claims: Claims, written: Callable[[str], None] = lambda _: None) -> bool:
    """Write one batch of puts (PUT) under its number; whether it was new. claims gives the claims (tenant, idem,
    request_hash, owner, state) as they stand. `written` is called after each table, for tests that stop in between.

    Puts without a claim leave their outcome alone. A batch without puts is committed, too. Null fields or snapshots
    count as none; a job's repeated snapshots are stored once. Batches are decided one after another, as a stream's are."""
    spark = batch.sparkSession
    if ledger(spark, root).where(F.col("batch") == number).count():
        return False

    def write(name: str, rows: DataFrame) -> DataFrame:
        rows.select(*[c.split(" ")[0] for c in TABLES[name].split(", ")]).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        written(name)
        return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}/batch={number}")

    decided = write("outcomes", _decided(batch, claims(spark), committed(spark, root, "completions")))
    # what was decided is read again, so that all tables follow one decision
    stored = batch.join(decided.where("accepted").select("seq", "tenant", "job_id"), ["seq", "tenant", "job_id"], "left_semi")
    write("jobs", stored)
    write("snapshots", stored.select("tenant", "job_id", F.inline("snapshots")).dropDuplicates(["tenant", "job_id", "snapshot_hash"]))
    write("completions", stored)
    states = F.transform(F.coalesce("fields", F.array().cast("array<struct<field_name:string,state:string>>")), lambda f: f["state"])
    counts = [F.sum(F.size(F.filter(states, _is(own)))).cast("bigint").alias(f"{own}_fields") for own in STATES]
    write("metrics", stored.groupBy("tenant").agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.coalesce("pages_fetched", F.lit(0))).alias("pages_fetched"), *counts))
    decided.agg(F.count(F.lit(1)).alias("puts")).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger/batch={number}")
    return True


def start(puts: DataFrame, root: str, checkpoint: str, claims: Claims, written: Callable[[str], None] = lambda _: None, **trigger: object) -> StreamingQuery:
    """A stream of puts into the sink."""

    def each(batch: DataFrame, number: int) -> None:
        commit(batch, number, root, claims, written)

    return puts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
