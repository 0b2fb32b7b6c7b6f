"""Rolling flow features of an instrument's observed events, in one ordered pass.

Rows are dealt by instrument and put in order; each goes once through a kernel
that keeps the entries of its windows and their totals, by way of Arrow. Totals
are whole numbers (sizes in units of 1e-8, squared returns in units of 1e-30), so
what falls out of a window leaves nothing behind. A task holds the entries of one
window and one batch of rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from math import log1p, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

UNIT = 10**8
SQUARE = 10**30
COLUMNS = ("type", "timestamp_ns", "_price", "_quantity", "aggressor", "_bid", "_bid_size", "_ask", "_ask_size")
OUT = "_vwap double, _trade_imbalance double, _flow bigint, _volatility double"


class Window:
    """Entries by clock, leaving from the front, with the totals of their values."""

    def __init__(self, width: int, values: int) -> None:
        self.width, self.entries, self.totals = width, deque(), [0] * values

    def add(self, clock: int, *values: int) -> None:
        self.entries.append((clock, values))
        for k, v in enumerate(values):
            self.totals[k] += v

    def expire(self, now: int) -> None:
        entries, edge = self.entries, now - self.width
        while entries and entries[0][0] < edge:
            for k, v in enumerate(entries.popleft()[1]):
                self.totals[k] -= v


class Flow:
    """The windows of one instrument. Its clock is the largest timestamp so far, and trades leave in the order they came."""

    def __init__(self, width: int) -> None:
        self.width, self.now, self.trade_clock, self.tracking, self.holed_until = width, 0, 0, False, None
        self.trades, self.moves, self.returns = Window(width, 4), Window(width, 1), Window(width, 1)
        self.touch: tuple | None = None

    def trade(self, timestamp: int, price: int, quantity: int, bought: bool) -> None:
        self.now, self.trade_clock = max(self.now, timestamp), max(self.trade_clock, timestamp)
        self.trades.add(self.trade_clock, quantity, price * quantity, quantity * bought, quantity * (not bought))

    def snapshot(self, timestamp: int, touch: tuple | None) -> None:
        """A new book: flow starts anew, and is unknown for a window if updates were seen before."""
        self.now = max(self.now, timestamp)
        if self.tracking:
            self.holed_until = self.now + self.width
        self.moves, self.returns, self.touch = Window(self.width, 1), Window(self.width, 1), touch

    def update(self, timestamp: int, touch: tuple | None) -> tuple:
        self.now, self.tracking, before = max(self.now, timestamp), True, self.touch
        if touch and before:
            self.moves.add(self.now, _move(before[:2], touch[:2]) - _move((-before[2], before[3]), (-touch[2], touch[3])))
            old, new = before[0] + before[2], touch[0] + touch[2]  # twice the mid prices
            if old != new:
                step = log1p(((new - old) / (2 * UNIT)) / (old / (2 * UNIT)))
                self.returns.add(self.now, round(step * step * SQUARE))
        self.touch = touch
        for window in (self.trades, self.moves, self.returns):
            window.expire(self.now)
        volume, notional, bought, sold = self.trades.totals
        holed = self.holed_until is not None and self.now < self.holed_until
        return (
            notional / UNIT**2 / (volume / UNIT) if volume else None,
            (bought - sold) / UNIT / ((bought + sold) / UNIT) if bought + sold else None,
            None if holed else self.moves.totals[0],
            None if holed or not self.returns.entries else sqrt(self.returns.totals[0] / SQUARE),
        )


def _move(old: tuple[int, int], new: tuple[int, int]) -> int:
    """Size that a side's best level gained between two touches; a better price counts whole, a worse one takes all that was there."""
    return (new[1] if new[0] >= old[0] else 0) - (old[1] if new[0] <= old[0] else 0)


def _kernel(width: int, keys: list[str], kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, at = Flow(width), None
        for batch in batches:
            chosen, out = [], []
            for i, (key, what, ts, price, quantity, aggressor, bid, bid_size, ask, ask_size) in enumerate(zip(zip(*[batch[k].to_pylist() for k in keys]), *[batch[c].to_pylist() for c in COLUMNS])):
                if key != at:
                    flow, at = Flow(width), key
                if what == "trade":
                    flow.trade(ts, price, quantity, aggressor == "buy")
                    continue
                touch = None if bid is None or ask is None else (bid, bid_size, ask, ask_size)
                if what == "snapshot":
                    flow.snapshot(ts, touch)
                else:
                    chosen.append(i)
                    out.append(flow.update(ts, touch))
            rows = batch.select(kept).take(pa.array(chosen, pa.int64()))
            values = list(zip(*out)) if out else [()] * 4
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v, k) for v, k in zip(values, kinds)]], names=[*kept, *[x.split()[0] for x in OUT.split(", ")]])

    return run


def flow_rows(rows: DataFrame, window_ns: int, keys, kept: list[str]) -> DataFrame:
    """The applied updates among observed rows (``COLUMNS`` and ord; prices and sizes in units), with the columns kept and ``OUT``."""
    schema = T.StructType([*rows.select(*kept).schema.fields, *T._parse_datatype_string(OUT)])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "ord").mapInArrow(_kernel(window_ns, list(keys), kept), schema)
