"""Captures: partitioned Parquet of the raw streams and of features, and ordered reads of them.

Layout of our own: ``<root>/<stream>/exchange=/symbol=/date=/session=``; date is
the UTC day of the event's timestamp. Files of the flat layout
``<root>/<exchange>/<symbol>/<date>/<stream>-<session>.parquet`` are read too.
Appends never touch what is there, and Spark's commit makes a write whole or
nothing, so there is no open file to lose. Below the session lies a level
``batch=``: a numbered batch that is written again replaces its own files alone.
When rows are flushed is the trigger of the stream that writes them; row groups
are Parquet's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numerics import stored, utc_date
from ..schemas import EVENTS, FEATURE_NAMES, FEATURES, STREAMS, TYPES, struct

ROLL_ROWS = 50_000
PARTITIONS = ("exchange", "symbol", "date", "session", "batch")


class CaptureNotFound(FileNotFoundError):
    """Nothing has been captured where a read looked."""


def checked(events: DataFrame, exchange: str | None = None, symbol: str | None = None) -> DataFrame:
    """events, failing on rows of a foreign instrument or an unknown type."""
    known = F.col("type").isin(*TYPES.values())
    for name, value in (("exchange", exchange), ("symbol", symbol)):
        known = known & (F.col(name) == value) if value is not None else known
    return events.where(F.when(F.coalesce(known, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("foreign or unknown event: "), F.coalesce("type", F.lit("null")), F.lit(" "), F.coalesce("symbol", F.lit("null"))))))


def with_capture_seq(events: DataFrame, by: tuple[str, ...], arrival: tuple[str, ...], last: DataFrame | None = None) -> DataFrame:
    """capture_seq: dense over the raw streams of each capture, in order of arrival; it goes on from last (by, last_capture_seq)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*arrival)).cast("bigint")
    if last is None:
        return events.withColumn("capture_seq", rank - 1)
    return events.join(F.broadcast(last), list(by), "left").withColumn("capture_seq", rank + F.coalesce("last_capture_seq", F.lit(-1).cast("bigint"))).drop("last_capture_seq")  # last: one row for each instrument


def rolled(events: DataFrame, roll_rows: int = ROLL_ROWS) -> DataFrame:
    """Events of one capture with the session moved on by one after every roll_rows of them; capture_seq goes on."""
    return events.withColumn("session", F.col("session") + F.expr(f"capture_seq div {roll_rows}"))


def write_events(events: DataFrame, root: str, roll_rows: int = ROLL_ROWS, batch: int | None = None) -> None:
    """Write each stream under root; files hold at most roll_rows rows, and a stream without rows makes no file.

    Unknown types fail. Without a batch number rows are appended; with one they
    replace what that batch wrote before.
    """
    events = checked(events)
    for stream, kind in TYPES.items():
        names = [f.name for f in struct(STREAMS[stream])]
        rows = events.where(F.col("type") == kind).select(*names, "session", utc_date("timestamp_ns").alias("date"), F.lit(batch or 0).cast("bigint").alias("batch"))
        writer = rows.sortWithinPartitions(*PARTITIONS, "capture_seq").write.partitionBy(*PARTITIONS).option("maxRecordsPerFile", roll_rows)
        writer = writer.mode("append") if batch is None else writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.parquet(f"{root}/{stream}")


def write_features(features: DataFrame, root: str, session: int = 0) -> None:
    """Append features, rounded half-even to 18 places; nulls stay."""
    kept = [stored(F.col(f.name)).alias(f.name) if f.name in FEATURE_NAMES else F.col(f.name) for f in struct(FEATURES)]
    rows = features.select(*kept).withColumns({"session": F.lit(session).cast("bigint"), "date": utc_date("timestamp_ns"), "batch": F.lit(0).cast("bigint")})
    rows.write.partitionBy(*PARTITIONS).mode("append").parquet(f"{root}/features")


def record(events: DataFrame, root: str, roll_rows: int = ROLL_ROWS) -> DataFrame:
    """Write events and hand them on unchanged."""
    write_events(events, root, roll_rows)
    return events


def _stream(spark: SparkSession, root: str, stream: str) -> DataFrame | None:
    schema = struct(f"{STREAMS[stream]}, date STRING, session BIGINT, batch BIGINT")
    try:
        rows = spark.read.schema(schema).parquet(f"{root}/{stream}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.withColumn("type", F.lit(TYPES[stream]))


def read_events(spark: SparkSession, root: str, exchange: str | None = None, symbol: str | None = None, dates: list[str] | None = None, batches_before: int | None = None) -> DataFrame:
    """The raw streams as tagged rows with date and session, pruned to what is asked for; unordered."""
    parts = [p for p in (_stream(spark, root, s) for s in STREAMS) if p is not None]
    if not parts:
        raise CaptureNotFound(root)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for name, value in (("exchange", exchange), ("symbol", symbol and symbol.upper())):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    rows = rows.where(F.col("date").isin(*dates)) if dates else rows
    rows = rows.where(F.col("batch") < batches_before) if batches_before is not None else rows
    names = [f.name for f in struct(EVENTS)]
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in struct(EVENTS) if f.name not in rows.columns]
    return rows.select("*", *missing).select(*names, "date")


def read_partition(spark: SparkSession, root: str, exchange: str, symbol: str, date: str) -> DataFrame:
    """All raw events of a UTC day in the order of (session, capture_seq); CaptureNotFound where there are none."""
    rows = read_events(spark, root, exchange, symbol, [date])
    if rows.isEmpty():
        raise CaptureNotFound(f"{root}: {exchange} {symbol} {date}")
    return rows.orderBy("session", "capture_seq")


def read_features(spark: SparkSession, root: str) -> DataFrame:
    schema = struct(f"{FEATURES}, date STRING, session BIGINT, batch BIGINT")
    return spark.read.schema(schema).parquet(f"{root}/features").select(*schema.names).drop("batch")


def write_flat(events: DataFrame, directory: str) -> None:
    """A day's events in the flat layout: one file for each stream and session, named after both."""
    spark = events.sparkSession
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsparkSession.sessionState().newHadoopConf()
    target = jvm.Path(directory)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    for stream, kind in TYPES.items():
        rows = events.where(F.col("type") == kind).select("session", *[f.name for f in struct(STREAMS[stream])])
        staged = f"{directory}/_staged-{stream}"
        rows.repartition("session").sortWithinPartitions("session", "capture_seq").write.partitionBy("session").mode("overwrite").parquet(staged)
        for found in fs.globStatus(jvm.Path(f"{staged}/session=*/part-*.parquet")) or ():  # one for each session
            session = found.getPath().getParent().getName().split("=")[1]
            fs.rename(found.getPath(), jvm.Path(f"{directory}/{stream}-{session}.parquet"))
        fs.delete(jvm.Path(staged), True)


def flat_files(spark: SparkSession, directory: str) -> DataFrame:
    """Session and stream of each file of a flat day directory; features and other names are left out."""
    files = spark.read.format("binaryFile").load(directory).select("path", F.col("length").alias("bytes"))
    return files.select("path", "bytes", *session_of("path")).where(F.col("session").isNotNull() & F.col("stream").isin(*STREAMS))


def session_of(column: str):
    """stream and session from a file name like trades-1788307200.parquet."""
    name = F.element_at(F.split(column, "/"), -1)
    return F.nullif(F.regexp_extract(name, r"^(\w+)-(\d+)\.parquet$", 1), F.lit("")).alias("stream"), F.nullif(F.regexp_extract(name, r"^(\w+)-(\d+)\.parquet$", 2), F.lit("")).cast("bigint").alias("session")


def read_flat(spark: SparkSession, directory: str) -> DataFrame:
    """A day of the flat layout as tagged rows, session from the file names."""
    parts = []
    for stream, kind in TYPES.items():
        try:
            rows = spark.read.option("pathGlobFilter", f"{stream}-*.parquet").schema(struct(STREAMS[stream])).parquet(directory)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            raise CaptureNotFound(directory) from e
        parts.append(rows.select("*", F.lit(kind).alias("type"), session_of("_metadata.file_path")[1]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tolerant_read(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files as far as they can be read: those without a footer are left out."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(*paths)


def sizes(spark: SparkSession, root: str) -> DataFrame:
    """path and bytes of each file under root, without opening any."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))


