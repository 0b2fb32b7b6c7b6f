"""Projections of the analytics tables onto market events, deterministic in Spark and in SQL.

``fx_trades`` takes trades from lineitem, ``fx_book`` the full event stream of
five instruments from events: snapshots, updates (some stale, some missing, some
crossing) and trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.numerics import to_ns
from .schemas import D, LEVELS

DAY_NS = 86_400_000_000_000
TRADE_WINDOW_NS, BOOK_WINDOW_NS = 30 * DAY_NS, DAY_NS // 4


def fx_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ns = to_ns(F.col("l_shipdate"))
    t = t.withColumns({"symbol": F.concat(F.lit("P"), (F.col("l_partkey") % 7).cast("string")), "session": F.year("l_shipdate").cast("bigint"), "timestamp_ns": ns})
    order = Window.partitionBy("symbol", "session").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return t.select(
        F.lit("tpch").alias("exchange"), "symbol", "timestamp_ns", (F.col("timestamp_ns") + (F.col("l_orderkey") % 1000) * 1_000_000).alias("received_ns"),
        "session", (F.row_number().over(order).cast("bigint") - 1).alias("capture_seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").cast(D).alias("price"), F.col("l_quantity").cast("decimal(18,2)").cast(D).alias("quantity"),
        F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("aggressor"), F.lit("trade").alias("type"),
    )


def _level(price, quantity):
    return F.struct(price.cast(D).alias("price"), quantity.cast(D).alias("quantity"))


def fx_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.col("event_type").alias("symbol"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    w = Window.partitionBy("symbol").orderBy("event_id")
    e = e.withColumn("rn", F.row_number().over(w))
    kind = F.when(F.col("rn") % 400 == 1, "snapshot").when(F.col("k") % 4 == 3, "trade").otherwise("book_update")
    e = e.withColumn("type", kind).withColumn("seq0", F.sum((F.col("type") != "trade").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    update = F.col("type") == "book_update"
    e = e.where(~(update & (F.col("rn") % 1300 == 700)))
    e = e.withColumn("seq", F.when(update & (F.col("rn") % 350 == 349), F.col("seq0") - 5).otherwise(F.col("seq0")))
    cents = lambda x: (x.cast("decimal(10,0)") * F.expr("cast(0.01 as decimal(3,2))"))
    i = F.sequence(F.lit(0), F.lit(19))
    at = lambda base, sign, x: F.lit(base).cast("decimal(10,2)") + cents(x * sign)
    rn = F.col("rn")
    deep_bids = F.transform(i, lambda x: _level(at("100.00", -1, x), 1 + (7 * x + rn) % 17))
    deep_asks = F.transform(i, lambda x: _level(at("100.01", 1, x), 1 + (5 * x + rn) % 17))
    qty = F.when(F.col("k") % 5 == 0, 0).otherwise(F.col("k"))
    crossing = (rn % 900 == 450) & (F.col("k") % 2 == 0) & (qty > 0)
    step = F.col("user_id") % 20
    bid = F.when(crossing, F.lit("100.50").cast("decimal(10,2)")).otherwise(at("100.00", -1, step))
    none = F.array().cast(LEVELS)
    is_bid = F.col("k") % 2 == 0
    bids = F.when(F.col("type") == "snapshot", deep_bids).when(update & is_bid, F.array(_level(bid, qty))).when(update, none)
    asks = F.when(F.col("type") == "snapshot", deep_asks).when(update & ~is_bid, F.array(_level(at("100.01", 1, step), qty))).when(update, none)
    trade = F.col("type") == "trade"
    ns = to_ns(F.col("ts"))
    return e.select(
        "type", F.lit("tpch").alias("exchange"), "symbol", ns.alias("timestamp_ns"), (ns + 5_000_000 - 1000 * (F.col("event_id") % 3)).alias("received_ns"),
        F.lit(1).cast("bigint").alias("session"), (rn - 1).cast("bigint").alias("capture_seq"),
        F.when(update, F.col("seq")).alias("first_seq"), F.when(~trade, F.col("seq")).alias("last_seq"), bids.cast(LEVELS).alias("bids"), asks.cast(LEVELS).alias("asks"),
        F.when(trade, F.col("event_id")).alias("trade_id"), F.when(trade, at("100.00", 1, F.col("k") % 10)).cast(D).alias("price"), F.when(trade, 1 + F.col("k") % 13).cast(D).alias("quantity"),
        F.when(trade, F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell")).alias("aggressor"),
    )
