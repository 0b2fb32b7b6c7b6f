"""How fast events become features and files, and what decimals cost."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import capture
from . import features


def _seconds(rows: DataFrame) -> float:
    began = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def storage(events: DataFrame, root: str) -> dict[str, float]:
    """Events written a second, and bytes that one takes."""
    n = events.count()
    began = time.perf_counter()
    capture.write_events(events, root)
    took = time.perf_counter() - began
    size = capture.sizes(events.sparkSession, root).where(F.col("path").endswith(".parquet")).agg(F.sum("bytes")).first()[0] or 0
    return {"events written a second": n / took, "bytes an event": size / max(n, 1)}


def decimal_cost(events: DataFrame) -> float:
    """How many times as long the products of decimals take as those of whole numbers, over the same rows."""
    trades = events.where("type = 'trade'").select(F.col("price").cast("decimal(18,8)").alias("p"), F.col("quantity").cast("decimal(18,8)").alias("q"))
    whole = trades.select(F.expr("cast(p as bigint)").alias("p"), F.expr("cast(q as bigint)").alias("q"))
    took = [_seconds(rows.select((F.col("p") * F.col("q")).alias("x")).agg(F.sum("x"))) for rows in (whole, trades)]
    return took[1] / took[0]


def measured(events: DataFrame, root: str) -> dict[str, float]:
    n = events.count()
    return {"events": float(n), "events to features a second": n / _seconds(features.feature_rows(events)), **storage(events, root), "decimal over whole": decimal_cost(events)}
