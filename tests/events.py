"""Builders of event rows, and random event sequences."""

import random
from decimal import Decimal as Dec

from lobweave.schemas import EVENTS, names, struct

NAMES = names(EVENTS)


def levels(*pairs):
    return [{"price": Dec(str(p)), "quantity": Dec(str(q))} for p, q in pairs]


def event(kind, seq, ts, symbol="BTCUSDT", session=1, **more):
    row = dict.fromkeys(NAMES) | {"type": kind, "exchange": "binance", "symbol": symbol, "session": session, "capture_seq": seq, "timestamp_ns": ts, "received_ns": ts}
    return row | more


def snapshot(seq, ts, last, bids, asks, **more):
    return event("snapshot", seq, ts, last_seq=last, bids=levels(*bids), asks=levels(*asks), **more)


def update(seq, ts, first, last, bids=(), asks=(), **more):
    return event("book_update", seq, ts, first_seq=first, last_seq=last, bids=levels(*bids), asks=levels(*asks), **more)


def trade(seq, ts, price, quantity, aggressor="buy", **more):
    return event("trade", seq, ts, price=Dec(str(price)), quantity=Dec(str(quantity)), aggressor=aggressor, trade_id=seq, **more)


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in rows], struct(EVENTS))


def random_events(seed, symbols=6, n=60, unit=10**9):
    """Forced ties, late events, gaps, duplicates, crossed books and snapshots, repeated prices in one update."""
    rng, rows = random.Random(seed), []
    for s in range(symbols):
        ts, last = 1000, 0
        for k in range(n):
            ts += rng.choice([0, 0, 1, 2, 7])
            at = (ts - rng.choice([0, 0, 0, 3, 30])) * unit
            roll = rng.random()
            price = lambda side: 100 + (-1 if side == "bid" else 1) * rng.randint(0, 4) + (0.5 if side == "ask" else 0)
            side_levels = lambda side, m: [(price(side), rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(0, m))]
            if roll < 0.12:
                last = max(1, last + rng.randint(-3, 8))
                asks = side_levels("ask", 4)
                if rng.random() < 0.1:
                    asks.append((99, 3))
                rows.append(snapshot(k, at, last, side_levels("bid", 4), asks, symbol=f"S{s}", session=1 + k // 40))
            elif roll < 0.4:
                rows.append(trade(k, at, rng.randint(90, 110), rng.randint(1, 9), rng.choice(["buy", "sell"]), symbol=f"S{s}", session=1 + k // 40))
            else:
                first = last + rng.choice([1, 1, 1, 1, 1, 1, 1, 0, 2, -4])
                end = first + rng.randint(0, 3)
                bids = side_levels("bid", 3)
                if rng.random() < 0.03:
                    bids.append((105, 1))
                rows.append(update(k, at, first, end, bids, side_levels("ask", 3), symbol=f"S{s}", session=1 + k // 40))
                last = max(last, end)
    return rows
