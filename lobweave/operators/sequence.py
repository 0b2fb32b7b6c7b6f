"""Order and continuity of events, as windows over each instrument.

``keys`` partition everything; a replay of one day adds ``date``, so a hot
instrument is dealt over its days. Epochs (from one snapshot to the next) are
independent and partition all book work below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEYS

STALE_NS = 30_000_000_000


def before(*partition: str) -> Window:
    """Rows of the partition that come earlier."""
    return Window.partitionBy(*partition).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)


def ordered(events: DataFrame, keys=KEYS) -> DataFrame:
    """ord: dense order of (session, capture_seq); ep: number of snapshots so far."""
    w = Window.partitionBy(*keys).orderBy("session", "capture_seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumns({"ord": F.row_number().over(w).cast("bigint"), "ep": F.sum((F.col("type") == "snapshot").cast("bigint")).over(so_far)})


def sequenced(rows: DataFrame, keys=KEYS) -> DataFrame:
    """Rows with dup, gap and live: whether the sequence alone lets a snapshot or update reach the book; trades pass by.

    Until the first gap of an epoch the largest last_seq so far is the book's
    own; after it nothing of the epoch counts. ep_end is the epoch's last order.
    """
    w = before(*keys, "ep")
    update = F.col("type") == "book_update"
    rows = rows.withColumns({"seen": F.max("last_seq").over(w), "ep_end": F.max("ord").over(Window.partitionBy(*keys, "ep"))})
    rows = rows.withColumn("dup", F.coalesce(update & (F.col("last_seq") <= F.col("seen")), F.lit(False)))
    rows = rows.withColumn("advanced", F.coalesce(F.sum((update & ~F.col("dup")).cast("int")).over(w), F.lit(0)))
    follows = F.when(F.col("advanced") == 0, F.col("first_seq") <= F.col("seen") + 1).otherwise(F.col("first_seq") == F.col("seen") + 1)
    rows = rows.withColumn("gap", F.coalesce(update & ~F.col("dup") & ~follows, F.lit(False)))
    broken = F.coalesce(F.max("gap").over(w), F.lit(False))
    return rows.withColumn("live", (F.col("type") != "trade") & (F.col("ep") > 0) & ~F.col("dup") & ~F.col("gap") & ~broken)


def joined_to_snapshot(snapshots: DataFrame, buffered: DataFrame, keys=KEYS) -> DataFrame:
    """Buffered updates that come after their instrument's snapshot, with too_old where the first of them leaves a hole.

    snapshots: one row for each key with last_seq.
    """
    s = snapshots.select(*keys, F.col("last_seq").alias("snapshot_seq"))
    kept = buffered.join(s, list(keys)).where("last_seq > snapshot_seq")
    first = F.first("first_seq").over(Window.partitionBy(*keys).orderBy("session", "capture_seq"))
    return kept.withColumn("too_old", first > F.col("snapshot_seq") + 1)


def seeded(events: DataFrame, keys=KEYS) -> DataFrame:
    """Events as they arrived, put in the order in which a feed hands them on.

    A session starts at the beginning and anew after each gap in the updates. It is
    seeded by its first snapshot that isn't too old for its first update; before
    that nothing counts. The snapshot comes first, then the trades that arrived
    before it, then those of the earlier updates that go on from it, then all that
    arrived later; updates that the snapshot covers drop out, and so do sessions
    without a snapshot. Rows that are in that order already stay as they are.
    ``attempt`` numbers the sessions; capture_seq is dense in the new order.
    """
    w = Window.partitionBy(*keys).orderBy("session", "capture_seq")
    update, book = F.col("type") == "book_update", F.col("type") == "snapshot"
    seen = F.max(F.when(update | book, F.col("last_seq"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(update & (F.col("first_seq") > seen + 1), F.lit(False))
    rows = events.withColumn("_gap", gap.cast("bigint"))
    rows = rows.withColumn("attempt", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")
    whole = Window.partitionBy(*keys, "attempt")
    rows = rows.withColumn("_from", F.min(F.when(update, F.col("first_seq"))).over(whole))
    place = F.struct("session", "capture_seq", "last_seq")
    rows = rows.withColumn("_seed", F.min(F.when(book & (F.col("last_seq") + 1 >= F.coalesce("_from", F.lit(0))), place)).over(whole))
    early = F.struct("session", "capture_seq") < F.struct("_seed.session", "_seed.capture_seq")
    is_seed = book & (F.col("session") == F.col("_seed.session")) & (F.col("capture_seq") == F.col("_seed.capture_seq"))
    rank = F.when(is_seed, 0).when(early & book, None).when(early & ~update, 1).when(update & (F.col("last_seq") <= F.col("_seed.last_seq")), None).when(early, 2).otherwise(3)
    rows = rows.withColumn("_rank", F.when(F.col("_seed").isNotNull(), rank)).where("_rank IS NOT NULL")
    order = Window.partitionBy(*keys).orderBy("attempt", "_rank", "session", "capture_seq")
    rows = rows.withColumns({"_n": F.row_number().over(order).cast("bigint") - 1, "session": F.min("session").over(whole)})
    return rows.withColumn("capture_seq", F.col("_n")).drop("_n", "_from", "_seed", "_rank")


def contiguity(updates: DataFrame, keys=KEYS) -> DataFrame:
    """Updates with expected (the number that should come first) and gap, message: as the feed checks them, epoch by epoch."""
    rows = sequenced(updates, keys)
    text = F.format_string("expected %d, got %d", F.col("seen") + 1, F.col("first_seq"))
    return rows.withColumns({"expected": F.col("seen") + 1, "message": F.when(F.col("gap"), text)})


def stale(events: DataFrame, timeout_ns: int = STALE_NS, keys=KEYS) -> DataFrame:
    """Events that came after a silence of more than the timeout, with silence_ns."""
    w = Window.partitionBy(*keys).orderBy("session", "capture_seq")
    return events.withColumn("silence_ns", F.col("received_ns") - F.lag("received_ns").over(w)).where(F.col("silence_ns") > timeout_ns)


def sequence_gaps(updates: DataFrame, keys=(), per_session: bool = False) -> DataFrame:
    """Updates by first_seq whose predecessor doesn't end right before them, with the gap.

    By default over all sessions of a key, so boundaries of sessions show too.
    """
    by = [*keys, *(["session"] if per_session else [])]
    w = Window.partitionBy(*by).orderBy("first_seq", "last_seq")
    return updates.withColumn("gap", F.col("first_seq") - F.lag("last_seq").over(w) - 1).where("gap <> 0")


def sequence_span(updates: DataFrame, keys=()) -> DataFrame:
    """Last last_seq less first first_seq, in order of first_seq."""
    order = F.struct("first_seq", "last_seq")
    return updates.groupBy(*keys).agg((F.max_by("last_seq", order) - F.min_by("first_seq", order)).alias("span"))
