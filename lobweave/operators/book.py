"""Level-2 books: the outcome of every update and the best levels after it.

Epochs, from one snapshot to the next, are independent, so rows are dealt by
instrument and epoch, put in order, and passed once through a book kernel by way
of Arrow. A task holds one book and one batch of rows, however long the epoch is
and however many levels stand; a row costs its own levels and the depth asked for.
Prices and sizes travel as whole numbers of 1e-8, so nothing is rounded.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numerics import from_units, to_units
from ..schemas import KEYS
from .sequence import ordered

DEPTH = 10
_UNITS = "array<struct<price:bigint,quantity:bigint>>"


def flattened(events: DataFrame, *columns: str) -> DataFrame:
    """Long form: one row for each level as it is stored, with side, price and quantity."""
    level = lambda side: F.transform(F.col(f"{side}s"), lambda x: F.struct(F.lit(side).alias("side"), x["price"].alias("price"), x["quantity"].alias("quantity")))
    return events.select(*columns, F.inline(F.concat(F.coalesce(level("bid"), F.array()), F.coalesce(level("ask"), F.array()))))


class Book:
    """One epoch's book in units; ``snapshot`` and ``update`` say what came of a row."""

    def __init__(self) -> None:
        self.status, self.last = "EMPTY", 0
        self.size: tuple[dict, dict] = {}, {}
        self.prices: tuple[list, list] = [], []  # ascending; bids as negative prices, so the best of both sides come first

    def _put(self, side: int, prices: list[int], quantities: list[int]) -> None:
        size, order, sign = self.size[side], self.prices[side], 1 if side else -1
        for price, quantity in zip(prices, quantities):
            if price not in size:
                if quantity:
                    insort(order, sign * price)
                    size[price] = quantity
            elif quantity:
                size[price] = quantity
            else:
                del size[price]
                del order[bisect_left(order, sign * price)]

    def _crossed(self) -> bool:
        bids, asks = self.prices
        return bool(bids and asks and -bids[0] >= asks[0])

    def snapshot(self, last: int, sides: tuple) -> str:
        self.__init__()
        self.last = last
        for side, (prices, quantities) in enumerate(sides):
            kept = [(p, q) for p, q in zip(prices, quantities) if q > 0]  # zeros drop out before the book is built
            self._put(side, [p for p, _ in kept], [q for _, q in kept])
        self.status = "INVALID" if self._crossed() else "SEEDED"
        return self.status

    def update(self, first: int, last: int, sides: tuple) -> str:
        if self.status in ("EMPTY", "INVALID"):
            return "NOT_SYNCED"
        if last <= self.last:
            return "DUPLICATE"
        if not (first <= self.last + 1 if self.status == "SEEDED" else first == self.last + 1):
            self.status = "INVALID"
            return "GAP"
        for side, (prices, quantities) in enumerate(sides):
            self._put(side, prices, quantities)
        self.last = last
        self.status = "INVALID" if self._crossed() else "SYNCED"
        return "CROSSED" if self.status == "INVALID" else "APPLIED"

    def top(self, side: int, depth: int) -> tuple[list[int], list[int]]:
        prices = [abs(p) for p in self.prices[side][:depth]]
        return prices, [self.size[side][p] for p in prices]


def _lists(column: pa.ListArray) -> tuple[list[int], list[int], list[int]]:
    """Offsets, prices and quantities of a column of levels; null is empty."""
    levels = column.flatten()
    width = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(width)]).tolist(), levels.field("price").to_pylist(), levels.field("quantity").to_pylist()


def _kernel(depth: int, keys: list[str]):
    kind = pa.list_(pa.struct([("price", pa.int64()), ("quantity", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, at = Book(), None
        for batch in batches:
            sides = [_lists(batch[c]) for c in ("_bids", "_asks")]
            out: list[tuple[list, list, list]] = [([0], [], []) for _ in sides]
            results, nulls = [], []
            rows = zip(zip(*[batch[k].to_pylist() for k in keys]), *[batch[c].to_pylist() for c in ("type", "first_seq", "last_seq")])
            for i, (key, what, first, last) in enumerate(rows):
                if key != at:
                    book, at = Book(), key
                if what == "trade":
                    result = "TRADE"
                else:
                    levels = tuple((p[o[i] : o[i + 1]], q[o[i] : o[i + 1]]) for o, p, q in sides)
                    result = book.snapshot(last, levels) if what == "snapshot" else book.update(first, last, levels)
                results.append(result)
                readable = result in ("SEEDED", "APPLIED")
                nulls.append(not readable)
                for side, (offsets, prices, quantities) in enumerate(out):
                    if readable:
                        p, q = book.top(side, depth)
                        prices += p
                        quantities += q
                    offsets.append(len(prices))
            mask = pa.array(nulls, pa.bool_())
            tops = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.StructArray.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["price", "quantity"]), type=kind, mask=mask) for o, p, q in out]
            kept = [c for c in batch.schema.names if c not in ("_bids", "_asks")]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(results, pa.string()), *tops], names=[*kept, "result", "_bids", "_asks"])

    return run


def states(events: DataFrame, depth: int = DEPTH, keys=KEYS) -> DataFrame:
    """All rows with the outcome of each (result), and bids and asks after it where the book can be read.

    events: a market-event stream with ``ord`` and ``ep`` (``sequence.ordered``).
    Snapshots come out SEEDED or, crossed, INVALID; updates APPLIED, DUPLICATE,
    GAP, CROSSED or NOT_SYNCED; trades TRADE. After a gap or a crossed book nothing
    is readable until the next snapshot.
    """
    units = lambda c: F.transform(c, lambda x: F.struct(to_units(x["price"]).alias("price"), to_units(x["quantity"]).alias("quantity")))
    rest = [c for c in events.columns if c not in ("bids", "asks")]
    rows = events.select(*rest, units("bids").cast(_UNITS).alias("_bids"), units("asks").cast(_UNITS).alias("_asks"))
    schema = T.StructType([*rows.select(*rest).schema.fields, *T._parse_datatype_string(f"result string, _bids {_UNITS}, _asks {_UNITS}")])
    done = rows.repartition(*keys, "ep").sortWithinPartitions(*keys, "ep", "ord").mapInArrow(_kernel(depth, [*keys, "ep"]), schema)
    exact = lambda c: F.transform(c, lambda x: F.struct(from_units(x["price"]).alias("price"), from_units(x["quantity"]).alias("quantity")))
    return done.select(*rest, "result", exact("_bids").alias("bids"), exact("_asks").alias("asks"))


def applied(events: DataFrame, depth: int = DEPTH, keys=KEYS) -> DataFrame:
    """``states`` of snapshots and updates alone."""
    return states(events.where("type <> 'trade'"), depth, keys)


def book_as_of(events: DataFrame, moment: DataFrame, depth: int = DEPTH, keys=KEYS) -> DataFrame:
    """The readable book at or before each (keys, session, capture_seq) of moment; no row where the book is invalid then."""
    rows = ordered(events.where("type <> 'trade'"), keys)
    m = moment.select(*keys, F.struct("session", "capture_seq").alias("at"))
    until = F.struct("session", "capture_seq") <= F.col("at")
    epochs = rows.select(*keys, "session", "capture_seq", "ep").join(m, list(keys)).where(until).groupBy(*keys, "at").agg(F.max("ep").alias("ep"))
    wanted = rows.join(epochs.select(*keys, "ep").distinct(), [*keys, "ep"], "left_semi")  # the book starts anew with each epoch
    done = applied(wanted, depth, keys).join(epochs, [*keys, "ep"]).where(until)
    last = done.groupBy(*keys, "at").agg(F.max_by(F.struct("result", "last_seq", "bids", "asks"), "ord").alias("b"))
    return last.where("b.result IN ('SEEDED', 'APPLIED')").select(*keys, "at", "b.*")
