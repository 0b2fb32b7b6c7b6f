"""Range reads, pages, catalogue and export over captures."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import STREAMS, TYPES, struct
from ..sources import capture

# fixed values: limits of a page and the approximate size of its rows
DEFAULT_LIMIT, MAX_LIMIT, BYTE_BUDGET = 500, 5_000, 4 * 1024 * 1024
ROW_BYTES, LEVEL_BYTES = 200, 60


class BadRequest(ValueError):
    """A cursor, stream or limit that can't be served."""


@dataclass(frozen=True)
class Cursor:
    """Resume strictly after (session, capture_seq)."""

    session: int
    seq: int

    @classmethod
    def parse(cls, text: str) -> Cursor:
        m = re.fullmatch(r"(-?\d+):(-?\d+)", text)
        if not m:
            raise BadRequest(f"bad cursor {text!r}; session:seq is expected")
        return cls(int(m[1]), int(m[2]))

    def __str__(self) -> str:
        return f"{self.session}:{self.seq}"


def in_range(events: DataFrame, session: int | None = None, start_seq: int | None = None, end_seq: int | None = None, start_ns: int | None = None, end_ns: int | None = None, after: Cursor | None = None) -> DataFrame:
    """Inclusive ranges as plain predicates, which reach the scan (session prunes partitions)."""
    tests = [
        (session, F.col("session") == session), (start_seq, F.col("capture_seq") >= start_seq), (end_seq, F.col("capture_seq") <= end_seq),
        (start_ns, F.col("timestamp_ns") >= start_ns), (end_ns, F.col("timestamp_ns") <= end_ns),
    ]
    for value, test in tests:
        events = events.where(test) if value is not None else events
    if after is not None:
        events = events.where((F.col("session") >= after.session) & ((F.col("session") > after.session) | (F.col("capture_seq") > after.seq)))
    return events


def approx_size() -> Column:
    """About how many bytes of JSON an event is."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return (ROW_BYTES + LEVEL_BYTES * (size("bids") + size("asks"))).cast("bigint")


def page(events: DataFrame, limit: int = DEFAULT_LIMIT, byte_budget: int = BYTE_BUDGET) -> tuple[DataFrame, DataFrame]:
    """The first rows in the order of (session, capture_seq) within limit and budget, and one row with the next cursor (or null).

    A row is in while fewer than limit rows and under budget bytes come before
    it, so a page is never empty. Only limit + 1 rows are ordered in one task.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise BadRequest(f"limit must be from 1 to {MAX_LIMIT}")
    if byte_budget < 1:
        raise BadRequest("byte_budget must be positive")
    first = events.orderBy("session", "capture_seq").limit(limit + 1)
    w = Window.orderBy("session", "capture_seq")
    spent = F.coalesce(F.sum(approx_size()).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = first.withColumns({"_n": F.row_number().over(w), "_spent": spent})
    inside = (F.col("_n") <= limit) & (F.col("_spent") < byte_budget)
    stop = rows.where(~inside).agg(F.min_by(F.struct("session", (F.col("capture_seq") - 1).alias("seq")), "_n").alias("next"))
    return rows.where(inside).drop("_n", "_spent"), stop.select("next.session", "next.seq")


def event_json() -> Column:
    """One event as it goes on the wire: decimals as strings, levels as objects, nothing inferred, no capture_seq."""
    text = lambda c: F.col(c).cast("string").alias(c)
    levels = lambda c: F.transform(c, lambda x: F.struct(x["price"].cast("string").alias("price"), x["quantity"].cast("string").alias("quantity"))).alias(c)
    head = ["type", "session", "exchange", "symbol", "timestamp_ns", "received_ns"]
    trade = F.to_json(F.struct(*head, "trade_id", text("price"), text("quantity"), "aggressor"), {"ignoreNullFields": "false"})
    book = F.to_json(F.struct(*head, "last_seq", levels("bids"), levels("asks")), {"ignoreNullFields": "false"})
    update = F.to_json(F.struct(*head, "last_seq", "first_seq", levels("bids"), levels("asks")), {"ignoreNullFields": "false"})
    return F.when(F.col("type") == "trade", trade).when(F.col("type") == "snapshot", book).otherwise(update)


def catalogue(events: DataFrame, keys=("date", "session")) -> DataFrame:
    """Rows and ranges for each date, session and stream, and the session's events."""
    stream = F.create_map(*[F.lit(x) for pair in ((v, k) for k, v in TYPES.items()) for x in pair])
    rows = events.groupBy(*keys, stream[F.col("type")].alias("stream")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("capture_seq").alias("first_seq"), F.max("capture_seq").alias("last_seq"),
        F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
    )
    return rows.withColumn("events", F.sum("rows").over(Window.partitionBy(*keys)))


def catalogue_of(spark: SparkSession, root: str, exchange: str, symbol: str, date: str | None = None) -> DataFrame:
    """``catalogue`` of a capture with the bytes of each stream's files, from footers and file listings alone.

    Each stream is grouped by all its partition columns first, so counts and ranges are
    pushed into the scan, which answers them from the footers.
    """
    footers = spark.newSession()
    for name, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true"), ("spark.sql.session.timeZone", "UTC")):
        footers.conf.set(name, value)
    files = capture.sizes(footers, root)
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]*)/", 1)
    files = files.where((part("exchange") == exchange) & (part("symbol") == symbol.upper())).select(part("date").alias("date"), part("session").cast("bigint").alias("session"), F.regexp_extract("path", r"/(\w+)/exchange=", 1).alias("stream"), "bytes")
    sizes = files.groupBy("date", "session", "stream").agg(F.sum("bytes").alias("bytes"))
    counted = []
    for stream in TYPES:
        try:
            rows = footers.read.schema(struct(f"{STREAMS[stream]}, date STRING, session BIGINT, batch BIGINT")).parquet(f"{root}/{stream}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        rows = rows.where((F.col("exchange") == exchange) & (F.col("symbol") == symbol.upper()))
        rows = rows.where(F.col("date") == date) if date else rows
        found = rows.groupBy(*capture.PARTITIONS).agg(
            F.count(F.lit(1)).alias("n"),
            F.min("capture_seq").alias("s0"), F.max("capture_seq").alias("s1"),
            F.min("timestamp_ns").alias("t0"), F.max("timestamp_ns").alias("t1"),
        )
        counted.append(found.groupBy("date", "session", F.lit(stream).alias("stream")).agg(
            F.sum("n").alias("rows"), F.min("s0").alias("first_seq"), F.max("s1").alias("last_seq"), F.min("t0").alias("first_ns"), F.max("t1").alias("last_ns"),
        ))
    if not counted:
        raise capture.CaptureNotFound(root)
    rows = reduce(DataFrame.unionAll, counted).join(sizes, ["date", "session", "stream"], "left")
    return rows.withColumn("events", F.sum("rows").over(Window.partitionBy("date", "session")))


def export(events: DataFrame, stream: str, path: str, single: bool = True) -> None:
    """One stream merged in the order of (session, capture_seq), zstd; features are refused."""
    if stream not in TYPES:
        raise BadRequest(f"stream must be one of {', '.join(TYPES)}")
    rows = exported(events, stream)
    (rows.coalesce(1) if single else rows).write.option("compression", "zstd").mode("overwrite").parquet(path)


def exported(events: DataFrame, stream: str) -> DataFrame:
    names = [f.name for f in struct(STREAMS[stream])]
    return events.where(F.col("type") == TYPES[stream]).select("session", *names).orderBy("session", "capture_seq")
