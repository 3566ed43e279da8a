"""What the operators share: the folder all executors see, written tables, folds and Arrow batch sizes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text a Python worker is sent at once; bounds its memory whatever the table's size.
ROWS_PER_BATCH = 512
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where none is set and the master is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="wendgraph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read again: lineage ends there, so a lost
    executor costs at most the tasks that it was running."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table of new_path once what was made of it is itself written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def large_batches(spark: SparkSession, rows: int = 16384) -> Iterator[None]:
    """For an action inside over rows of a fixed small size: Arrow batches of `rows`. The session's bound comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Bounds Arrow batches by rows unless the session has been given a smaller bound, and lets Python workers
    that have the package at the driver's path import it (elsewhere, submit it with --py-files)."""
    known = spark.sparkContext.environment
    if ROOT not in known.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known.get("PYTHONPATH")]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out of all learning."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


#: Bytes of a table that may be broadcast, as counted by `hinted`.
BROADCAST_BYTES = 48 << 20


def hinted(small: DataFrame) -> DataFrame:
    """A table, marked for broadcast if its measured bytes (strings' and binaries' lengths, 8 for any other column, and 16 a
    row) are few; else joined by shuffle. It is scanned once for that: give it a written table."""
    size = F.lit(16)
    for name, kind in small.dtypes:
        size = size + (F.coalesce(F.octet_length(F.col(name)), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    total = small.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    return F.broadcast(small) if total <= BROADCAST_BYTES else small


def joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = 1 << 14) -> DataFrame:
    """left (a written table) joined with right on key, where one key may hold a third of left's rows. Keys that left has over
    `most` times are salted: their rows of right are copied once for each `most` rows of left. They are known to all
    tasks, as there is at most one for `most` rows."""
    hot = left.groupBy(key).agg(F.count("*").alias("salts")).where(F.col("salts") > most)
    hot = hot.select(key, F.ceil(F.col("salts") / most).cast("int").alias("salts"))
    if hot.isEmpty():
        return left.join(right, key, how)
    salts = F.coalesce("salts", F.lit(1))
    one = left.join(F.broadcast(hot), key, "left").withColumn("salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("salts")
    two = right.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return one.join(two, [key, "salt"], how).drop("salt")


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of df whose id isn't among ids (a written table)."""
    return df.join(hinted(ids.select(column)), column, "left_anti").select(df.columns)


def hashed_sample(df: DataFrame, rows: int, total: int, *columns: str) -> DataFrame:
    """At most `rows` rows, chosen by a hash of the columns. total: how many there are; of many, all but about twice the
    wanted number are passed over before the sort, so no task and no driver sees more than that."""
    h = F.xxhash64(*columns, F.lit("sample"))
    if total > 2 * rows:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * rows / total))
    return df.orderBy(h, *columns).limit(rows)


def release() -> None:
    """Gives freed memory back to the system at a task's end: a Python worker goes on to other tasks beside a JVM that
    needs it."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
