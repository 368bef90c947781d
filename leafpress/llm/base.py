"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets
    a temporary folder; a cluster has none that all its machines see, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="leafpress-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the shuffle files of finished jobs go: Spark's cleaner drops them when the driver collects its garbage. This works for
    what table() has written; a checkpoint holds on to the plan it came from."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Statements within drop their shuffle files as they end, whatever still refers to them: release() comes too early while
    Spark's listeners hold the plan. Before Spark 4.1 the setting is not known, and the files go with the driver's garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, had)


def table(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Scratch:
    """Tables of one call in a folder of their own below the shared one. What only other tables are made of can be dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top = spark, f"{shared_dir(spark)}/{name}-{uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df as a Parquet table, read again with df's schema."""
        df.write.parquet(f"{self.top}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.top}/{name}")

    def drop(self, *names: str) -> None:
        """Deletes tables that no later query reads, and lets the shuffle files behind them go."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            path = hadoop(f"{self.top}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        release(self.spark)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches hold at most so many rows, as a row can be a long document. A smaller setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def n_words(text: Column) -> Column:
    """Number of words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sealed(df: DataFrame, id_cols: dict[str, Column], outputs: list[str]) -> DataFrame:
    """One struct column __row with df's columns but those named in outputs, beside the working columns in id_cols: a name in
    df can't clash with a working name, and an output replaces an input column of its name."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in outputs] or [F.lit(None).alias("__none")]).alias("__row"), *[v.alias(k) for k, v in id_cols.items()])


def unsealed(df: DataFrame, *outputs: Column) -> DataFrame:
    fields = [c for c in df.schema["__row"].dataType.fieldNames() if c != "__none"]
    return df.select(*[F.col("__row").getField(c).alias(c) for c in fields], *outputs)


def plus(schema: T.StructType, ddl: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])
