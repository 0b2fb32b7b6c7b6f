"""From market events to book states and feature rows; batch form of the stateful operator in ``streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features as f
from ..functions.numerics import RATIO_PLACES, narrowed, ratio, stored, to_units
from ..operators import book, flow
from ..operators.rolling import clock, windowed_sums
from ..operators.sequence import ordered
from ..schemas import FEATURE_NAMES, KEYS, WINDOW_NS


def trade_windows(observed: DataFrame, window_ns: int = WINDOW_NS, keys=KEYS) -> DataFrame:
    """observed (type, timestamp_ns, ord, now, price, quantity, aggressor) with volume, notional, bought and sold of the window.

    Trades leave in the order they came: a late one stays until those before it
    expire, so its clock is the largest trade timestamp so far. One that comes
    in too late for the window is never in it.
    """
    trade = F.col("type") == "trade"
    rows = observed.withColumn("_eff", F.max(F.when(trade, F.col("timestamp_ns"))).over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.coalesce(trade & (F.col("_eff") >= F.col("now") - window_ns), F.lit(False))
    p, q = narrowed(F.col("price")), narrowed(F.col("quantity"))
    values = {"volume": q, "notional": p * q, "bought": F.when(F.col("aggressor") == "buy", q), "sold": F.when(F.col("aggressor") == "sell", q)}
    return windowed_sums(rows, list(keys), "now", window_ns, entry, "_eff", values).drop("_eff")


def trade_features(trades: DataFrame, window_ns: int = WINDOW_NS, keys=KEYS) -> DataFrame:
    """Trades alone: each with now, volume, vwap and trade_imbalance of the window that ends with it."""
    rows = ordered(trades.withColumn("type", F.lit("trade")), keys)
    rows = rows.withColumn("now", clock("timestamp_ns", *keys))
    rows = trade_windows(rows, window_ns, keys)
    return rows.withColumns({"vwap": ratio(F.col("notional"), F.col("volume")), "trade_imbalance": ratio(F.col("bought") - F.col("sold"), F.col("bought") + F.col("sold"))})


def feature_rows(events: DataFrame, window_ns: int = WINDOW_NS, keys=KEYS) -> DataFrame:
    """One row for each APPLIED update: keys, session, capture_seq, timestamp_ns and all features in computing types.

    Three shuffles: by instrument for the order, by instrument and epoch for the
    books, by instrument again for the windows. Trades, SEEDED snapshots and APPLIED
    updates count.
    """
    every = book.states(ordered(events, keys), keys=keys).where("result IN ('TRADE', 'SEEDED', 'APPLIED')")
    instant = [build().alias(name) for name, build in f.INSTANT.items()]  # taken here, so no later sort carries the levels
    bid, ask = f.best("bids"), f.best("asks")
    units = {"_price": F.col("price"), "_quantity": F.col("quantity"), "_bid": bid["price"], "_bid_size": bid["quantity"], "_ask": ask["price"], "_ask_size": ask["quantity"]}
    names = [*keys, "session", "capture_seq", "timestamp_ns", "ord"]
    rows = every.select(*names, "type", "aggressor", *instant, *[to_units(x).alias(n) for n, x in units.items()])
    out = flow.flow_rows(rows, window_ns, keys, [*names, *f.INSTANT])
    rounded = lambda c: F.round(c, RATIO_PLACES)
    return out.select(
        *names, *f.INSTANT, rounded("_vwap").alias("vwap"), rounded("_trade_imbalance").alias("trade_imbalance"),
        (F.col("_flow").cast("decimal(19,0)") * F.expr("cast(0.00000001 as decimal(8,8))")).alias("order_flow_imbalance"), F.col("_volatility").alias("realised_volatility"),
    )


def stored_features(rows: DataFrame) -> DataFrame:
    """Feature rows as they are kept: decimals of 18 places, nulls where undefined."""
    return rows.select("exchange", "symbol", "timestamp_ns", *[stored(F.col(n)).alias(n) for n in FEATURE_NAMES])


def outcome_counts(events: DataFrame, keys=KEYS) -> DataFrame:
    """events, trades, snapshots, applied, rejected for each instrument; rejected is every update that wasn't applied."""
    done = book.states(ordered(events, keys), keys=keys)
    count = lambda *names: F.count_if(F.col("result").isin(*names))
    return done.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        count("TRADE").alias("trades"),
        count("SEEDED", "INVALID").alias("snapshots"),
        count("APPLIED").alias("applied"),
        count("DUPLICATE", "GAP", "CROSSED", "NOT_SYNCED").alias("rejected"),
    )


def last_trades(events: DataFrame, n: int = 100, keys=KEYS) -> DataFrame:
    """trades: the last n of each instrument, newest first; each task keeps n before rows are shuffled."""
    place = Window.partitionBy(*keys).orderBy(F.desc("session"), F.desc("capture_seq"))
    rows = events.where("type = 'trade'").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= n)
    one = F.struct("_n", "session", "capture_seq", "timestamp_ns", "trade_id", "price", "quantity", "aggressor")
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("trades"))


def latest_state(events: DataFrame, keys=KEYS) -> DataFrame:
    """What a live reader would see at the end: state, last_seq, number of events and snapshots, last trade and whether features are known.

    Features are known while the last observed book row is an applied update and
    nothing has invalidated the book since.
    """
    rows = ordered(events, keys)
    books = book.applied(rows, keys=keys)
    order = F.when(~F.col("result").isin("DUPLICATE"), F.col("ord"))
    last = books.groupBy(*keys).agg(F.max_by("result", order).alias("result"), F.max_by("last_seq", F.when(F.col("result").isin("SEEDED", "APPLIED", "CROSSED"), F.col("ord"))).alias("last_seq"))
    state = F.when(F.col("result") == "SEEDED", "SEEDED").when(F.col("result") == "APPLIED", "SYNCED").when(F.col("ep") == 0, "EMPTY").otherwise("INVALID")
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.max("ep").alias("ep"), F.max_by("trade_id", F.when(F.col("type") == "trade", F.col("ord"))).alias("last_trade_id"))
    return totals.join(last, list(keys), "left").select(*keys, "events", F.col("ep").alias("snapshots"), F.coalesce(state, F.lit("EMPTY")).alias("state"), "last_seq", "last_trade_id", F.coalesce(F.col("result") == "APPLIED", F.lit(False)).alias("has_features"))
