"""Tables: input tables by name, and intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "factloom.shared.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, over all cores if it comes in fewer splits than there are: such a table is small, but work on
    its rows need not be. A larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, as in tests, a temporary folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.conf.get(OWN_DIR, None)
    if not named:
        named = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set(OWN_DIR, named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Bytes that a file of an intermediate table should have, by the planner's estimate, if there are enough for all cores.
FILE_BYTES, TASKS_A_CORE = 16 << 20, 4


def compact(df: DataFrame) -> DataFrame:
    """df in no more partitions than give each core TASKS_A_CORE of them or a file FILE_BYTES, so that a small table
    is not written as hundreds of tiny files; a large one stays as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.coalesce(max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, -(-size // FILE_BYTES)) if size < 1 << 44 else 1 << 30)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends in files that every executor
    sees, so a lost executor costs a re-read, and later readers prune columns."""
    path = f"{shared_dir(df.sparkSession)}/factloom/{tag}-{uuid.uuid4().hex}"
    compact(df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
