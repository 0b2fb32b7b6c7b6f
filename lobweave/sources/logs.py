"""Text logs of capture runs, and verbatim frames as text."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

# fixed value: the format of a heartbeat line
HEARTBEAT = r"^([\d-]+ [\d:]+)\s+mid ([\d.]+).*?([\d,]+) events\s+([\d,]+) trades\s+(\d+) snapshot\(s\)\s+(\d+) rejected"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files (column line)."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def heartbeats(lines: DataFrame) -> DataFrame:
    """at, mid, events, trades, snapshots, rejected of each heartbeat line."""
    part = lambda k: F.regexp_extract("line", HEARTBEAT, k)
    number = lambda k: F.replace(part(k), F.lit(","), F.lit("")).cast("bigint")
    rows = lines.where(F.col("line").rlike(HEARTBEAT))
    return rows.select(F.to_timestamp(part(1), "yyyy-MM-dd HH:mm:ss").alias("at"), part(2).cast("decimal(18,8)").alias("mid"), number(3).alias("events"), number(4).alias("trades"), number(5).alias("snapshots"), number(6).alias("rejected"))


def heartbeat_lines(rows: DataFrame, every_s: int = 0, snapshots: str = "snapshots", rejected: str = "rejected") -> DataFrame:
    """Status lines (column line) for rows of timestamp_ns, midprice, events, trades, snapshots, rejected; the first of each every_s seconds, if given."""
    if every_s:
        slot = F.expr(f"timestamp_ns div {every_s * 1_000_000_000}")
        rows = rows.groupBy(slot.alias("_slot")).agg(F.min_by(F.struct(*rows.columns), "timestamp_ns").alias("r")).select("r.*")
    at = F.date_format(F.timestamp_seconds(F.expr("timestamp_ns div 1000000000")), "yyyy-MM-dd HH:mm:ss")
    mid = F.format_string("%.2f", F.col("midprice").cast("double"))
    text = F.concat(at, F.lit("  mid "), mid, F.lit("  |  "), F.format_number("events", 0), F.lit(" events  "), F.format_number("trades", 0), F.lit(" trades  "), F.col(snapshots).cast("string"), F.lit(" snapshot(s)  "), F.col(rejected).cast("string"), F.lit(" rejected"))
    return rows.where("midprice IS NOT NULL").select(text.alias("line"))


def log_summary(lines: DataFrame) -> DataFrame:
    """One row: heartbeats, first and last of them, range of mid and its span in percent, resyncs, rejected, errors."""
    beats = heartbeats(lines).agg(
        F.count(F.lit(1)).alias("heartbeats"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.max_by("events", "at").alias("events"), F.max_by("trades", "at").alias("trades"), F.min("mid").alias("mid_low"), F.max("mid").alias("mid_high"),
    ).withColumn("span_pct", F.round((F.col("mid_high") - F.col("mid_low")).cast("double") / F.col("mid_low").cast("double") * 100, 2))
    has = lambda *words: F.count_if(F.greatest(*[F.col("line").contains(w) for w in (*words, words[0])]))
    marks = lines.agg(F.count(F.lit(1)).alias("lines"), has("RESYNC").alias("resyncs"), has("!!").alias("rejected_lines"), has("Traceback", "Error").alias("errors"))
    return marks.join(beats)  # one row each


def write_frames(frames: DataFrame, path: str, column: str = "raw") -> None:
    """Verbatim frames, one a line."""
    frames.select(column).write.mode("append").text(path)


class Heartbeat(StreamingQueryListener):
    """Prints a status line of a running stream, at most one every so many seconds."""

    def __init__(self, every_s: float = 300.0, write=print, clock=time.monotonic):
        self.every_s, self.write, self.clock, self.last, self.rows = every_s, write, clock, None, 0

    def onQueryStarted(self, event) -> None:
        self.write(f"start {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        p, now = event.progress, self.clock()
        self.rows += p.numInputRows
        if self.last is None or now - self.last >= self.every_s:
            self.last = now
            self.write(f"{p.timestamp}  {self.rows:,} events  {p.processedRowsPerSecond or 0:,.0f} a second  batch {p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write(f"end {event.id}" + (f"  !! {event.exception}" if event.exception else ""))
