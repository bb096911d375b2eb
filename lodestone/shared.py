"""Intermediate tables in the folder that the cluster shares.

Operators of several rounds cut their lineage by writing Parquet under
``spark.checkpoint.dir``: a lost executor then costs one task, not the
rounds before.  The files stay until the folder is cleared, because lazily
evaluated results may still read them, unless an operator discards a table
that only its own written tables have read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that Spark hands to a Python worker at once while a table is written.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temp folder only in local mode, where it may be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what is executed inside; the session's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` from a table written to the shared folder."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with bounded_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tasks at least that make pairs of rows.
TASKS = 64


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in so many partitions that the pairs of a few small files are not made by one task."""
    return df.repartition(max(TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose every reader has been written out itself."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/lodestone/" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
