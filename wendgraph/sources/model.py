"""Schemas of a stored graph and the hybrid logical clock that stamps its writes."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

STAMP = StructType([StructField("wall_time", LongType()), StructField("logical", LongType()), StructField("node_id", LongType())])
NODES = StructType([StructField("uuid", StringType()), StructField("payload", StringType()), StructField("ts", STAMP)])
EDGES = StructType([StructField("src", StringType()), StructField("label", StringType()), StructField("weight", DoubleType()), StructField("dst", StringType()), StructField("props", StringType()), StructField("ts", STAMP)])


class Clock:
    """A hybrid logical clock: a later millisecond starts at logical 0; within one, and when the wall clock has gone
    back, logical counts up. Past 16 bits it takes the next millisecond (where a 16-bit counter would wrap), so stamps
    never repeat."""

    def __init__(self, node_id: int = 1, now: Callable[[], int] | None = None) -> None:
        self.node_id, self._now = node_id, now or (lambda: time.time_ns() // 1_000_000)
        self._wall, self._logical, self._lock = 0, 0, threading.Lock()

    def stamp(self) -> tuple[int, int, int]:
        with self._lock:
            now = self._now()
            if now > self._wall:
                self._wall, self._logical = now, 0
            elif self._logical < 0xFFFF:
                self._logical += 1
            else:
                self._wall, self._logical = self._wall + 1, 0
            return self._wall, self._logical, self.node_id

    def batch(self) -> int:
        """A millisecond for the rows of one batch alone: later than all stamps so far, earlier than all to come."""
        with self._lock:
            self._wall, self._logical = max(self._now(), self._wall + 1), 0xFFFF
            return self._wall


def typed(df: DataFrame) -> DataFrame:
    """The rows with their own stamps as STAMP has them."""
    if dict(df.dtypes).get("ts") in (None, STAMP.simpleString()):
        return df
    return df.withColumn("ts", F.col("ts").cast(STAMP))


def stamped(df: DataFrame, clock: Clock) -> DataFrame:
    """Rows with stamps keep them. The others get a millisecond of their own and, as logical part, all of
    monotonically_increasing_id, the partition's number and the row's in it: no two rows tie, a later row of a partition
    wins, and what is written once stays as it is."""
    if "ts" in df.columns:
        return typed(df)
    ts = F.struct(F.lit(clock.batch()).cast("long").alias("wall_time"), F.monotonically_increasing_id().alias("logical"), F.lit(clock.node_id).cast("long").alias("node_id"))
    return df.withColumn("ts", ts)
