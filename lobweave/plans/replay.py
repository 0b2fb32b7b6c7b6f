"""Replay: events in their order, with the moment each is due."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sequence import seeded
from ..schemas import KEYS, WINDOW_NS
from ..sources.capture import read_events, read_partition
from .features import feature_rows


def paced(events: DataFrame, speed: float = 1.0, keys=KEYS) -> DataFrame:
    """events with emit_offset_s: seconds from the first event at which each is due; waits are never negative, speed 0 waits nowhere."""
    w = Window.partitionBy(*keys).orderBy("session", "capture_seq")
    wait = F.greatest(F.lit(0), F.coalesce(F.col("received_ns") - F.lag("received_ns").over(w), F.lit(0)))
    rows = events.withColumn("_wait", wait if speed else F.lit(0))
    total = F.sum("_wait").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double") / 1e9
    return rows.withColumn("emit_offset_s", total / (speed or 1.0)).drop("_wait")


def replay(events: DataFrame, speed: float = 0.0, sleep=time.sleep) -> Iterator[Row]:
    """Rows one by one in order, held on the driver only a partition at a time; pacing changes when they come, never what comes."""
    rows = events.orderBy("session", "capture_seq")
    last = None
    for row in rows.toLocalIterator():
        if speed and last is not None and row["received_ns"] is not None:
            sleep(max(0, row["received_ns"] - last) / 1e9 / speed)
        last = row["received_ns"] if row["received_ns"] is not None else last
        yield row


def replay_partition(spark: SparkSession, root: str, exchange: str, symbol: str, date: str, speed: float = 0.0) -> Iterator[Row]:
    yield from replay(read_partition(spark, root, exchange, symbol, date), speed)


def replay_features(spark: SparkSession, root: str, exchange: str | None = None, symbol: str | None = None, dates: list[str] | None = None, window_ns: int = WINDOW_NS, as_arrived: bool = False) -> DataFrame:
    """Feature rows of recorded days; each day starts with an empty book, so days are independent partitions.

    as_arrived: the capture holds events as they came off the wire and not as a feed hands them on.
    """
    keys, rows = (*KEYS, "date"), read_events(spark, root, exchange, symbol, dates)
    return feature_rows(seeded(rows, keys) if as_arrived else rows, window_ns, keys)
