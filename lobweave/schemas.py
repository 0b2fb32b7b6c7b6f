"""Schemas of the stored streams and of the tagged union of events."""

from __future__ import annotations

from pyspark.sql import types as T

D = "DECIMAL(38,18)"  # at rest
C = "DECIMAL(18,8)"  # in computations: products and sums of it stay exact
LEVELS = f"ARRAY<STRUCT<price: {D}, quantity: {D}>>"

_IDENTITY = "exchange STRING, symbol STRING, timestamp_ns BIGINT, received_ns BIGINT, capture_seq BIGINT"
STREAMS = {
    "trades": f"{_IDENTITY}, trade_id BIGINT, price {D}, quantity {D}, aggressor STRING",
    "book_updates": f"{_IDENTITY}, first_seq BIGINT, last_seq BIGINT, bids {LEVELS}, asks {LEVELS}",
    "snapshots": f"{_IDENTITY}, last_seq BIGINT, bids {LEVELS}, asks {LEVELS}",
}
TYPES = {"trades": "trade", "book_updates": "book_update", "snapshots": "snapshot"}
FEATURE_NAMES = (
    "best_bid", "best_ask", "spread", "midprice", "microprice", "imbalance_1", "imbalance_5", "imbalance_10",
    "bid_depth_10", "ask_depth_10", "vwap", "trade_imbalance", "order_flow_imbalance", "realised_volatility",
)
FEATURES = "exchange STRING, symbol STRING, timestamp_ns BIGINT, " + ", ".join(f"{n} {D}" for n in FEATURE_NAMES)
EVENTS = f"type STRING, session BIGINT, {_IDENTITY}, first_seq BIGINT, last_seq BIGINT, bids {LEVELS}, asks {LEVELS}, trade_id BIGINT, price {D}, quantity {D}, aggressor STRING"

KEYS = ("exchange", "symbol")
WINDOW_NS = 60_000_000_000


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def names(ddl: str) -> list[str]:
    """Column names of a DDL string."""
    out, depth = [], 0
    for part in ddl.split(", "):
        if not depth:
            out.append(part.split()[0])
        depth += part.count("<") + part.count("(") - part.count(">") - part.count(")")
    return out
