"""What several operators need from the session."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set, as in tests on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage, so that a lost executor costs a read and not a recomputation."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # so that Spark's cleaner drops the shuffle files of lineages that were cut before
    return out


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function over the batches of a task; behind it what Arrow and the C library hold free goes back to the machine, as an executor's workers wait side by side for the next task."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim is not None:
                trim(0)

    return task


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what is read several times by few of its columns."""
    at = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def numbered(df: DataFrame, keep: list[str], *others: Column) -> tuple[DataFrame, list[str]]:
    """The columns to keep under plain names, which functions over batches need, and others; and those names."""
    names = [f"k{i}" for i in range(len(keep))]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], *others), names


def widened(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df with further columns, given by their types."""
    return StructType([*df.schema.fields, *[StructField(name, StructType.fromDDL(f"c {kind}")[0].dataType) for name, kind in kinds.items()]])


def refuse_columns(df: DataFrame, *names: str) -> None:
    """Columns that an operator adds must not be there before."""
    clash = sorted(c for c in df.columns if c.lower() in {n.lower() for n in names})
    if clash:
        raise ValueError(f"the table has columns that are about to be added: {', '.join(clash)}; rename them first")


def with_totals(df: DataFrame, totals: DataFrame, key: str, rows: int = 10_000, salts: int = 16) -> DataFrame:
    """df with the other columns of ``totals``, which has one row for each value of ``key``, null among them.

    Up to ``rows`` values, counted first, go to every task; beyond that each value has ``salts`` rows and the rows of df that share it are dealt over them.
    """
    totals = checkpoint(totals)
    if totals.count() <= rows:
        right = F.broadcast(totals.withColumnRenamed(key, "__key"))
        return df.join(right, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    right = totals.withColumnRenamed(key, "__key").withColumn("__of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return left.join(right, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__of")), "left").drop("__key", "__salt", "__of")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the key and so the same in every run; all of them, if there are no more. Twice as many at most."""
    there = df.count()
    if there <= rows:
        return df
    share = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(share)) < F.lit(share * rows // there)).orderBy(F.xxhash64(F.col(key), F.lit(17)), key).limit(2 * rows)
