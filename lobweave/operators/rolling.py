"""Event-time windows by prefix sums.

The clock of a row is the largest timestamp so far; a window holds the entries
whose clock is at least the row's less the width. As both clocks never recede,
the sum over a window is the sum of all entries so far less the sum of those
that have fallen out, and the latter is one running sum over the entries merged
with the rows by (clock, kind). Sums are decimals or counts, so differences are
exact; the cost is two sorts whatever a window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clock(timestamp: str, *partition: str) -> Column:
    """The largest timestamp so far, in order of ord."""
    return F.max(timestamp).over(Window.partitionBy(*partition).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))


def windowed_sums(rows: DataFrame, partition: list[str], now: str, width: int, entry: Column, entry_clock: str, values: dict[str, Column]) -> DataFrame:
    """rows with a column for each value: its sum over the entries in the window of the row, itself included.

    entry says which rows are entries; entry_clock never recedes over them in
    order of ord. A window without entries has sum 0.
    """
    zero = {n: F.coalesce(F.when(entry, v), F.lit(0)) for n, v in values.items()}
    so_far = Window.partitionBy(*partition).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    staged = rows.withColumns({f"_{n}": v for n, v in zero.items()}).withColumn("_entry", entry)
    totals = staged.withColumns({f"_all_{n}": F.sum(f"_{n}").over(so_far) for n in values})
    # each row once as an anchor at the window's far edge, and once more as an entry if it is one: a single pass over rows
    kept = F.struct(*[F.col(c) for c in (*rows.columns, *[f"_all_{n}" for n in values])])
    kind = totals.select(kept.alias("r")).schema["r"].dataType
    zeros = [F.lit(None).cast(totals.schema[f"_{n}"].dataType).alias(f"_{n}") for n in values]
    anchor = F.struct((F.col(now) - width).alias("_key"), F.lit(0).alias("_kind"), *zeros, kept.alias("_row"))
    member = F.struct(F.col(entry_clock).alias("_key"), F.lit(1).alias("_kind"), *[F.col(f"_{n}") for n in values], F.lit(None).cast(kind).alias("_row"))
    both = totals.select(*partition, F.inline(F.when(F.col("_entry"), F.array(anchor, member)).otherwise(F.array(anchor))))
    merged = Window.partitionBy(*partition).orderBy("_key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({f"_out_{n}": F.sum(f"_{n}").over(merged) for n in values}).where("_kind = 0")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns], *[(F.col(f"_row._all_{n}") - F.coalesce(f"_out_{n}", F.lit(0))).alias(n) for n in values])
