"""Instantaneous features as columns over best-first level arrays (bids, asks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numerics import ratio

HALF = "cast(0.5 as decimal(2,1))"


def best(side: Column | str) -> Column:
    """The best level of a side, or null."""
    return F.try_element_at(F.col(side) if isinstance(side, str) else side, F.lit(1))


def spread(bid: Column, ask: Column) -> Column:
    return ask["price"] - bid["price"]


def midprice(bid: Column, ask: Column) -> Column:
    """Exact half of the sum, null where a side is empty."""
    return (bid["price"] + ask["price"]) * F.expr(HALF)


def microprice(bid: Column, ask: Column) -> Column:
    """Each price weighted by the other side's size."""
    weighted = bid["price"] * ask["quantity"] + ask["price"] * bid["quantity"]
    return ratio(weighted, bid["quantity"] + ask["quantity"])


def depth(side: Column | str, n: int) -> Column:
    """Size of the best n levels; an empty side is zero."""
    side = F.col(side) if isinstance(side, str) else side
    return F.aggregate(F.slice(side, 1, n), F.expr("cast(0 as decimal(28,8))"), lambda a, x: (a + x["quantity"]).cast("decimal(28,8)"))


def imbalance(bids: Column | str, asks: Column | str, n: int) -> Column:
    """Share of bids less share of asks over n levels; null only if both sides are empty."""
    b, a = depth(bids, n), depth(asks, n)
    return ratio(b - a, b + a)


#: Named builders over columns bids and asks; a further feature is one more entry.
INSTANT = {
    "best_bid": lambda: best("bids")["price"],
    "best_ask": lambda: best("asks")["price"],
    "spread": lambda: spread(best("bids"), best("asks")),
    "midprice": lambda: midprice(best("bids"), best("asks")),
    "microprice": lambda: microprice(best("bids"), best("asks")),
    "imbalance_1": lambda: imbalance("bids", "asks", 1),
    "imbalance_5": lambda: imbalance("bids", "asks", 5),
    "imbalance_10": lambda: imbalance("bids", "asks", 10),
    "bid_depth_10": lambda: depth("bids", 10),
    "ask_depth_10": lambda: depth("asks", 10),
}
