"""Wire frames to events: JSON text columns in, typed rows out.

Fixed values of the venue's format: event names ``depthUpdate`` and ``trade``,
the envelope ``{"stream", "data"}`` and one-letter field names; times are
milliseconds, prices and quantities strings, ``m`` true when the buyer was the
maker (the aggressor sold).

Malformed rows get a text in ``error`` and null fields; ``strict=True`` raises
for them instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import ms_to_ns
from ..schemas import D, LEVELS

EXCHANGE = "binance"
_FRAME = "e STRING, E BIGINT, s STRING, U BIGINT, u BIGINT, b ARRAY<ARRAY<STRING>>, a ARRAY<ARRAY<STRING>>, t BIGINT, p STRING, q STRING, T BIGINT, m BOOLEAN"
_SNAPSHOT = "lastUpdateId BIGINT, bids ARRAY<ARRAY<STRING>>, asks ARRAY<ARRAY<STRING>>, code BIGINT, msg STRING"


def _levels(x: Column) -> Column:
    return F.transform(x, lambda l: F.struct(l[0].cast(D).alias("price"), l[1].cast(D).alias("quantity"))).cast(LEVELS)


def _checked(rows: DataFrame, error: Column, columns: dict[str, Column], keep: tuple[str, ...], strict: bool) -> DataFrame:
    rows = rows.withColumn("error", F.when(error.isNotNull(), F.raise_error(error)).otherwise(F.lit(None).cast("string")) if strict else error)
    fine = F.col("error").isNull()
    return rows.select(*keep, *[F.when(fine, c).alias(n) for n, c in columns.items()], "error")


def _parsed(raw: DataFrame, column: str, schema: str) -> tuple[DataFrame, dict[str, Column]]:
    """raw with the JSON object as a map (whose keys keep their case), and its fields in their types; null where they don't fit."""
    kinds = dict(x.split(" ", 1) for x in schema.split(", "))
    rows = raw.withColumn("_json", F.from_json(F.col(column), "MAP<STRING, STRING>", {"mode": "PERMISSIVE"}))
    at = lambda n: F.try_element_at("_json", F.lit(n))
    return rows, {n: F.from_json(at(n), kind) if kind.startswith("ARRAY") else at(n).try_cast(kind) for n, kind in kinds.items()}


def _depth(f: dict[str, Column], received: Column) -> dict[str, Column]:
    return {
        "exchange": F.lit(EXCHANGE), "symbol": f["s"], "timestamp_ns": ms_to_ns(f["E"]), "received_ns": received,
        "first_seq": f["U"], "last_seq": f["u"], "bids": _levels(f["b"]), "asks": _levels(f["a"]),
    }


def _trade(f: dict[str, Column], received: Column) -> dict[str, Column]:
    return {
        "exchange": F.lit(EXCHANGE), "symbol": f["s"], "timestamp_ns": ms_to_ns(f["T"]), "received_ns": received,
        "trade_id": f["t"], "price": f["p"].cast(D), "quantity": f["q"].cast(D), "aggressor": F.when(f["m"], "sell").otherwise("buy"),
    }


def parse_depth(raw: DataFrame, column: str = "raw", strict: bool = False) -> DataFrame:
    """raw, received_ns (where there is one) -> book updates; zero quantities stay."""
    rows, f = _parsed(raw, column, _FRAME)
    received = F.col("received_ns") if "received_ns" in raw.columns else F.lit(None).cast("bigint")
    error = F.when(f["e"].isNull() | (f["e"] != "depthUpdate"), F.concat(F.lit("not a depthUpdate: "), F.coalesce(f["e"], F.lit("none"))))
    error = error.when(f["u"].isNull() | f["U"].isNull() | f["b"].isNull() | f["a"].isNull(), F.lit("incomplete depthUpdate"))
    return _checked(rows, error, _depth(f, received), tuple(c for c in raw.columns if c not in (column, "received_ns")), strict)


def parse_trades(raw: DataFrame, column: str = "raw", strict: bool = False) -> DataFrame:
    """raw, received_ns (where there is one) -> trades, stamped at the match."""
    rows, f = _parsed(raw, column, _FRAME)
    received = F.col("received_ns") if "received_ns" in raw.columns else F.lit(None).cast("bigint")
    error = F.when(f["e"].isNull() | (f["e"] != "trade"), F.concat(F.lit("not a trade: "), F.coalesce(f["e"], F.lit("none"))))
    error = error.when(f["t"].isNull() | f["p"].isNull() | f["q"].isNull(), F.lit("incomplete trade"))
    return _checked(rows, error, _trade(f, received), tuple(c for c in raw.columns if c not in (column, "received_ns")), strict)


def parse_stream(raw: DataFrame, column: str = "raw", strict: bool = False) -> DataFrame:
    """Enveloped frames -> tagged rows (type, all columns of all kinds).

    A snapshot comes under a stream name like ``btcusdt@snapshot``, with the body
    that the venue answers with, and is stamped on receipt.
    """
    inner = raw.withColumn("_data", F.get_json_object(column, "$.data"))
    rows, f = _parsed(inner, "_data", f"{_FRAME}, {_SNAPSHOT}")
    received = F.col("received_ns") if "received_ns" in raw.columns else F.lit(None).cast("bigint")
    is_trade, is_snapshot = F.coalesce(f["e"] == "trade", F.lit(False)), f["e"].isNull() & f["lastUpdateId"].isNotNull()
    error = F.when(F.col("_data").isNull(), F.lit("no data in the frame")).when(~is_snapshot & (f["e"].isNull() | ~f["e"].isin("depthUpdate", "trade")), F.concat(F.lit("unknown event: "), F.coalesce(f["e"], f["msg"], F.lit("none"))))
    name = F.upper(F.substring_index(F.get_json_object(column, "$.stream"), "@", 1))
    error = error.when(is_snapshot & (received.isNull() | name.isNull()), F.lit("a snapshot without stream or time of receipt"))
    depth, trade = _depth(f, received), _trade(f, received)
    snapshot = _snapshot(f, name, received)
    columns = {"type": F.when(is_trade, "trade").when(is_snapshot, "snapshot").otherwise("book_update")}
    for name in dict.fromkeys((*depth, *trade)):
        none = F.lit(None)
        columns[name] = F.when(is_trade, trade.get(name, none)).when(is_snapshot, snapshot.get(name, none)).otherwise(depth.get(name, none))
    return _checked(rows, error, columns, tuple(c for c in raw.columns if c not in (column, "received_ns")), strict)


def _snapshot(f: dict[str, Column], symbol: Column, received: Column) -> dict[str, Column]:
    return {
        "exchange": F.lit(EXCHANGE), "symbol": symbol, "timestamp_ns": received, "received_ns": received,
        "last_seq": f["lastUpdateId"], "bids": _levels(f["bids"]), "asks": _levels(f["asks"]),
    }


def parse_snapshots(raw: DataFrame, column: str = "raw", strict: bool = False) -> DataFrame:
    """raw, symbol, received_ns -> snapshots, stamped on receipt; an error body gives its message."""
    rows, f = _parsed(raw, column, _SNAPSHOT)
    columns = _snapshot(f, F.upper("symbol"), F.col("received_ns"))
    error = F.when(f["lastUpdateId"].isNull(), F.coalesce(f["msg"], F.lit("not a snapshot")))
    return _checked(rows, error, columns, tuple(c for c in raw.columns if c not in (column, "symbol", "received_ns")), strict)


def to_frames(events: DataFrame) -> DataFrame:
    """Trades and updates as enveloped JSON frames in column raw, with all other columns of events kept: the inverse of ``parse_stream``."""
    text = lambda x: F.transform(x, lambda l: F.array(l["price"].cast("string"), l["quantity"].cast("string")))
    ms = lambda c: F.expr(f"{c} div 1000000")
    depth = F.to_json(F.struct(F.lit("depthUpdate").alias("e"), ms("timestamp_ns").alias("E"), F.col("symbol").alias("s"), F.col("first_seq").alias("U"), F.col("last_seq").alias("u"), text(F.col("bids")).alias("b"), text(F.col("asks")).alias("a")))
    trade = F.to_json(F.struct(F.lit("trade").alias("e"), ms("timestamp_ns").alias("E"), F.col("symbol").alias("s"), F.col("trade_id").alias("t"), F.col("price").cast("string").alias("p"), F.col("quantity").cast("string").alias("q"), ms("timestamp_ns").alias("T"), (F.col("aggressor") == "sell").alias("m")))
    data = F.when(F.col("type") == "trade", trade).otherwise(depth)
    name = F.concat(F.lower("symbol"), F.when(F.col("type") == "trade", "@trade").otherwise("@depth"))
    return events.where("type <> 'snapshot'").withColumn("raw", F.concat(F.lit('{"stream":"'), name, F.lit('","data":'), data, F.lit("}")))
