"""The driver's queries: operators over the projections of the test tables, with the columns of ``oracle``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixtures import BOOK_WINDOW_NS, TRADE_WINDOW_NS, fx_book, fx_trades
from ..functions import features as f
from ..functions.numerics import to_ns, utc_date
from ..operators import book, reports, research, sequence
from ..operators.rolling import clock
from ..schemas import EVENTS, FEATURE_NAMES, LEVELS, struct
from ..session import work_path
from ..sources import capture, frames, logs
from . import features, replay


def dbl(name: str, column: Column | None = None, places: int | None = None) -> Column:
    c = (F.col(name) if column is None else column).cast("double")
    return (F.round(c + 1e-9, places) if places is not None else c).alias(name)  # the offset settles halves alike in both engines


def trades_by_aggressor(spark: SparkSession, d: str) -> DataFrame:
    return reports.by_aggressor(fx_trades(spark, d)).select("aggressor", "trades", dbl("quantity"))


def trades_ordered_page(spark: SparkSession, d: str) -> DataFrame:
    rows = research.in_range(fx_trades(spark, d).where("symbol = 'P3'"), after=research.Cursor.parse("1993:20"))
    rows = rows.withColumns({c: F.lit(None).cast("array<int>") for c in ("bids", "asks")})
    return research.page(rows, 500, 60_000)[0].select("session", "capture_seq", "trade_id", dbl("price"))


def trades_time_range(spark: SparkSession, d: str) -> DataFrame:
    rows = research.in_range(fx_trades(spark, d), start_seq=10, start_ns=788918400000000000, end_ns=804556800000000000)
    return rows.select("symbol", "session", "capture_seq", "timestamp_ns", dbl("price"))


def catalogue_sessions(spark: SparkSession, d: str) -> DataFrame:
    return research.catalogue(fx_trades(spark, d), ("symbol", "session"))


def capture_seq_assign(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("symbol"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("event_id"))
    kept = e.withColumn("rn", rn).where(~((F.col("rn") % 400 != 1) & (F.col("k") % 4 != 3) & (F.col("rn") % 1300 == 700)))
    return capture.with_capture_seq(kept, ("symbol",), ("event_id",)).select("symbol", "event_id", "capture_seq")


def partition_date(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(to_ns(F.col("l_shipdate")).alias("timestamp_ns"))
    return rows.groupBy(utc_date("timestamp_ns").alias("date")).agg(F.count(F.lit(1)).alias("trades"))


def replay_order_union(spark: SparkSession, d: str) -> DataFrame:
    return sequence.ordered(fx_book(spark, d)).select("symbol", "type", "session", "capture_seq", "ord")


def replay_pacing_offsets(spark: SparkSession, d: str) -> DataFrame:
    return replay.paced(fx_book(spark, d), 100.0).select("symbol", "capture_seq", dbl("emit_offset_s", places=6))


def export_merged(spark: SparkSession, d: str) -> DataFrame:
    path = work_path(spark, "export")
    research.export(fx_book(spark, d), "trades", path)
    return spark.read.parquet(path).select("session", "symbol", "capture_seq", "trade_id", dbl("price"))


def levels_long_form(spark: SparkSession, d: str) -> DataFrame:
    return reports.levels_long(fx_book(spark, d), "symbol", "capture_seq").select("symbol", "capture_seq", "side", dbl("price"), dbl("quantity"))


def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.sequence_gaps(fx_book(spark, d).where("type = 'book_update'"), ("symbol",)).select("symbol", "first_seq", "gap")


def sequence_span(spark: SparkSession, d: str) -> DataFrame:
    return sequence.sequence_span(fx_book(spark, d).where("type = 'book_update'"), ("symbol",))


def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.null_counts(fx_book(spark, d))


def latest_trades(spark: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("session"), F.desc("capture_seq")))
    rows = fx_book(spark, d).where("type = 'trade'").withColumn("n", n.cast("bigint")).where("n <= 50")
    return rows.select("symbol", "trade_id", dbl("price"), dbl("quantity"), "aggressor", "n")


def stale_gaps(spark: SparkSession, d: str) -> DataFrame:
    return sequence.stale(fx_book(spark, d), 1_800_000_000_000).select("symbol", "capture_seq", "silence_ns")


def snapshot_join(spark: SparkSession, d: str) -> DataFrame:
    rows = fx_book(spark, d)
    snapshots = rows.where("type = 'snapshot' AND capture_seq = 400")
    return sequence.joined_to_snapshot(snapshots, rows.where("type = 'book_update'")).select("symbol", "capture_seq", "first_seq", "too_old")


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return reports.percentiles(fx_trades(spark, d), "price", "symbol").select("symbol", "count", *[dbl(c) for c in ("p50", "p95", "p99", "worst")])


def session_from_filename(spark: SparkSession, d: str) -> DataFrame:
    """All trades written in the flat layout, a file for each session, and read back by the sessions in the names."""
    path = work_path(spark, "flat")
    names = [x.name for x in struct(EVENTS)]
    missing = {c: F.lit(None).cast(t) for c, t in (("first_seq", "bigint"), ("last_seq", "bigint"), ("bids", LEVELS), ("asks", LEVELS))}
    capture.write_flat(fx_trades(spark, d).withColumns(missing).select(names), path)
    files = capture.flat_files(spark, path).groupBy("session").agg(F.count(F.lit(1)).alias("files"))
    rows = capture.read_flat(spark, path).groupBy("session").agg(F.count(F.lit(1)).alias("trades"), F.min("capture_seq").alias("first_seq"), F.max("capture_seq").alias("last_seq"))
    return rows.join(files, "session")


def latest_ring(spark: SparkSession, d: str) -> DataFrame:
    """The last 100 trades of each instrument, newest first."""
    ring = features.last_trades(fx_book(spark, d))
    return ring.select("symbol", F.posexplode("trades").alias("n", "t")).select("symbol", "n", "t.trade_id", "t.timestamp_ns", "t.aggressor")


def book_event_json(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots and updates as JSON, and the size that pages count for each."""
    rows = fx_book(spark, d).where("type <> 'trade'")
    return rows.select("symbol", "capture_seq", research.event_json().alias("body"), research.approx_size().alias("size"))


def seeded_feed(spark: SparkSession, d: str) -> DataFrame:
    """Events put in the order of a feed that starts anew after each gap."""
    return sequence.seeded(fx_book(spark, d)).select("symbol", "attempt", "capture_seq", "type", "timestamp_ns", "last_seq", "trade_id")


def _applied(spark: SparkSession, d: str) -> DataFrame:
    return book.applied(sequence.ordered(fx_book(spark, d)))


def book_apply_result(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d).select("symbol", "capture_seq", "type", "result")


def book_result_counts(spark: SparkSession, d: str) -> DataFrame:
    return features.outcome_counts(fx_book(spark, d)).drop("exchange")


def book_touch(spark: SparkSession, d: str) -> DataFrame:
    rows = _applied(spark, d).where("result IN ('SEEDED', 'APPLIED')")
    b, a = f.best("bids"), f.best("asks")
    return rows.select("symbol", "capture_seq", dbl("best_bid", b["price"]), dbl("bid_quantity", b["quantity"]), dbl("best_ask", a["price"]), dbl("ask_quantity", a["quantity"]))


def book_top_levels(spark: SparkSession, d: str) -> DataFrame:
    rows = _applied(spark, d).where("result IN ('SEEDED', 'APPLIED')")
    side = lambda name: F.transform(F.slice(f"{name}s", 1, 5), lambda x, i: F.struct(F.lit(name).alias("side"), (i + 1).cast("bigint").alias("pos"), x["price"].cast("double").alias("price"), x["quantity"].cast("double").alias("quantity")))
    return rows.select("symbol", "capture_seq", F.inline(F.concat(side("bid"), side("ask"))))


def book_as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = fx_book(spark, d)
    moments = rows.select("exchange", "symbol").distinct().select("*", F.lit(1).cast("bigint").alias("session"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in (250, 777, 1500)])).alias("capture_seq"))
    found = book.book_as_of(rows, moments)
    return found.select("symbol", F.col("at.capture_seq").cast("int").alias("at"), "result", "last_seq", dbl("best_bid", f.best("bids")["price"]), dbl("best_ask", f.best("asks")["price"]))


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_rows(fx_book(spark, d), BOOK_WINDOW_NS)


def _picked(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("symbol", "capture_seq", *[dbl(n, places=6) for n in names])


def book_spread_mid_micro(spark: SparkSession, d: str) -> DataFrame:
    return _picked(_features(spark, d), "spread", "midprice", "microprice")


def book_depth_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return _picked(_features(spark, d), "bid_depth_10", "ask_depth_10", "imbalance_1", "imbalance_5", "imbalance_10")


def flow_clock(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.ordered(fx_trades(spark, d))
    return rows.withColumn("now", clock("timestamp_ns", "exchange", "symbol")).select("symbol", "session", "capture_seq", "now")


def _trade_features(spark: SparkSession, d: str) -> DataFrame:
    return features.trade_features(fx_trades(spark, d), TRADE_WINDOW_NS)


def flow_vwap(spark: SparkSession, d: str) -> DataFrame:
    return _trade_features(spark, d).select("symbol", "session", "capture_seq", dbl("volume"), dbl("vwap", places=6))


def flow_trade_imbalance(spark: SparkSession, d: str) -> DataFrame:
    return _trade_features(spark, d).select("symbol", "session", "capture_seq", dbl("trade_imbalance", places=6))


def flow_ofi(spark: SparkSession, d: str) -> DataFrame:
    return _picked(_features(spark, d), "order_flow_imbalance")


def flow_realised_vol(spark: SparkSession, d: str) -> DataFrame:
    return _picked(_features(spark, d), "realised_volatility")


def feature_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("symbol", "capture_seq", "timestamp_ns", *[dbl(n, places=6) for n in FEATURE_NAMES])


def latest_state(spark: SparkSession, d: str) -> DataFrame:
    return features.latest_state(fx_book(spark, d)).drop("exchange")


def parse_frames(spark: SparkSession, d: str) -> DataFrame:
    raw = frames.to_frames(fx_book(spark, d)).select("raw", "received_ns", "capture_seq")
    rows = frames.parse_stream(raw)
    return rows.where("error IS NULL").select("symbol", "type", "capture_seq", "timestamp_ns", "first_seq", "trade_id", dbl("price"), "aggressor", F.when(F.col("type") == "book_update", F.size("bids")).alias("n_bids"))


def parse_snapshot(spark: SparkSession, d: str) -> DataFrame:
    text = lambda x: F.transform(x, lambda l: F.array(l["price"].cast("string"), l["quantity"].cast("string")))
    raw = fx_book(spark, d).where("type = 'snapshot'").select("symbol", "capture_seq", "received_ns", F.to_json(F.struct(F.col("last_seq").alias("lastUpdateId"), text(F.col("bids")).alias("bids"), text(F.col("asks")).alias("asks"))).alias("raw"))
    rows = frames.parse_snapshots(raw)
    return rows.select("symbol", "capture_seq", "timestamp_ns", "last_seq", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), dbl("best_bid", F.col("bids")[0]["price"]))


def event_json(spark: SparkSession, d: str) -> DataFrame:
    rows = fx_trades(spark, d).withColumns({c: F.lit(None).cast("bigint") for c in ("first_seq", "last_seq")})
    rows = rows.withColumns({c: F.lit(None).cast("array<struct<price: decimal(38,18), quantity: decimal(38,18)>>") for c in ("bids", "asks")})
    return rows.select("trade_id", "capture_seq", "session", "symbol", research.event_json().alias("body"))


def contiguity_check(spark: SparkSession, d: str) -> DataFrame:
    rows = sequence.ordered(fx_book(spark, d)).where("type <> 'trade'")
    return sequence.contiguity(rows).where("type = 'book_update'").select("symbol", "capture_seq", "message")


def log_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows printed as heartbeat lines and read back."""
    rows = features.feature_rows(fx_book(spark, d), BOOK_WINDOW_NS)
    counts = features.outcome_counts(fx_book(spark, d)).select("symbol", "trades", "snapshots", "rejected")
    rows = rows.withColumn("events", F.col("capture_seq") + 1).join(counts, "symbol")
    return logs.log_summary(logs.heartbeat_lines(rows.select("timestamp_ns", "midprice", "events", "trades", "snapshots", "rejected")))


def stream_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """The feature rows of the stateful stream, fed in micro-batches."""
    from ..streaming import market

    names = [x.name for x in market.struct(market.EVENTS)]
    rows = fx_book(spark, d).select(*names)
    source, steps = work_path(spark, "stream-in"), 3
    cut = rows.agg(F.max("capture_seq")).first()[0] or 0
    for k in range(steps):
        rows.where((F.col("capture_seq") > cut * k // steps - (k == 0)) & (F.col("capture_seq") <= cut * (k + 1) // steps)).coalesce(1).write.mode("append").parquet(source)
    out = work_path(spark, "stream-out")
    market.run_to_table(market.feature_stream(market.event_stream(spark, source), BOOK_WINDOW_NS), out, work_path(spark, "stream-check"))
    return spark.read.schema(market.FEATURE_ROW).parquet(out).select("symbol", "capture_seq", "timestamp_ns", *[dbl(n, places=6) for n in FEATURE_NAMES])


QUERIES = {
    q.__name__: q
    for q in (
        trades_by_aggressor, trades_ordered_page, trades_time_range, catalogue_sessions, capture_seq_assign, partition_date, replay_order_union, replay_pacing_offsets,
        export_merged, levels_long_form, sequence_gaps, sequence_span, null_counts, latest_trades, stale_gaps, snapshot_join, latency_percentiles, session_from_filename,
        book_apply_result, book_result_counts, book_touch, book_top_levels, book_as_of, book_spread_mid_micro, book_depth_imbalance, flow_clock, flow_vwap,
        flow_trade_imbalance, latest_ring, book_event_json, seeded_feed, flow_ofi, flow_realised_vol, feature_snapshot, latest_state, parse_frames, parse_snapshot, event_json, contiguity_check, log_heartbeat, stream_equals_batch,
    )
}
