"""The relational operators of the report scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import LEVELS
from .book import flattened

FRACTIONS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def levels_long(events: DataFrame, *columns: str) -> DataFrame:
    """One row for each level, in the order of capture_seq, side and price from high to low."""
    return flattened(events, *columns).orderBy("capture_seq", "side", F.desc("price"))


def by_aggressor(trades: DataFrame, *keys: str) -> DataFrame:
    """Number and total quantity of trades for each aggressor."""
    return trades.groupBy(*keys, "aggressor").agg(F.count(F.lit(1)).alias("trades"), F.sum("quantity").alias("quantity"))


def null_counts(rows: DataFrame) -> DataFrame:
    """column, nulls for the columns that have any."""
    one = rows.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in rows.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in rows.columns])
    return one.select(F.inline(pairs)).where("nulls > 0")


def percentiles(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, p50, p95, p99 and worst by rank without interpolation: the sample at index min(n - 1, int(n * fraction)).

    Ranks come from a count of distinct values, so no group is ever held in one
    row: values are summed up first, then ranked.
    """
    from pyspark.sql import Window

    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumns({"_to": F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})
    at = {n: F.least(F.col("_all") - 1, F.floor(F.col("_all") * f)) for n, f in FRACTIONS.items()}
    picked = {n: F.min(F.when(F.col("_to") > k, F.col(value))) for n, k in at.items()}
    return ranked.groupBy(*keys).agg(F.max("_all").alias("count"), *[c.alias(n) for n, c in picked.items()], F.max(value).alias("worst"))


def write_csv(events: DataFrame, path: str) -> None:
    """Events as CSV: levels in long form (side, price, quantity), decimals as text."""
    lists = [c for c in ("bids", "asks") if c in events.columns]
    if lists:
        own = [c for c in events.columns if c not in (*lists, "price", "quantity")]
        events = flattened(events.withColumns({c: F.lit(None).cast(LEVELS) for c in ("bids", "asks") if c not in lists}), *own)
    events.select([F.col(c).cast("string") if t.startswith("decimal") else F.col(c) for c, t in events.dtypes]).write.mode("overwrite").option("header", True).csv(path)
