"""Exact dedup against a minimal perfect hash over the digests seen before.

Texts are equal when identical after lower-casing A-Z; equality is held on
their SHA-256. The distinct digests of the history are dealt into shards by
prefix; each shard is one minimal perfect hash (levels of bit arrays; a key's
slot is the rank of its bit) whose slots hold the full digest, the winner's
doc_id and the number of rows. New rows are first grouped by digest (so a
digest that a third of all rows carry arrives as one row for each task), then
looked up: a slot whose digest agrees byte for byte is updated, all others form
groups of their own.

Null text counts as empty; a null doc_id is smaller than any other; repeated
rows (doc_id and text) count in group_size and are all marked like the winner,
while ``dedup`` leaves one of them; an empty table gives an empty result; extra
columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, mixed, saved

LEAST = -(2**63)
SHARD = 500_000  # digests of a shard
GAMMA, LEVELS = 2.0, 64
INDEX = "shard int, levels array<binary>, digests binary, winners binary, counts binary"
GROUPS = "digest binary, keep_id long, group_size long"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit pairs (rows of an n x 4 uint64 array of digests)."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # 0/1 bytes
        self.ranks = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in levels]
        self.before = np.concatenate([[0], np.cumsum([x.sum() for x in levels], dtype=np.int64)]) if levels else np.zeros(1, np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = keys[:, 0] ^ mixed(keys[:, 1] + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64))
        return (mixed(h) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("digests are not distinct")
            size = int(GAMMA * len(left)) + 1
            at = cls._at(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for keys that were not built in, any slot or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = self._at(keys[left], k, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id (null: the least), digest; one row for each row of docs."""
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST)).alias("id"), docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.sha2(lowered(F.coalesce(docs["text"], F.lit(""))).cast("binary"), 256)).alias("digest"))


def grouped(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct digests with their winner and number of rows, and their shard."""
    return rows.groupBy("digest").agg(F.max("id").alias("winner"), F.count(F.lit(1)).alias("n")).withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def build_index(groups: DataFrame) -> DataFrame:
    """One row for each shard: the hash's levels and the slots."""

    def build(table: pa.Table) -> pa.Table:
        keys = _keys(table["digest"])
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.slots(keys))
        cols = [[table["shard"][0].as_py()], [[np.packbits(x).tobytes() + len(x).to_bytes(8, "little") for x in mph.levels]], [keys[order].tobytes()]]
        cols += [[table[c].to_numpy()[order].astype(np.int64).tobytes()] for c in ("winner", "n")]
        return pa.table(dict(zip(("shard", "levels", "digests", "winners", "counts"), [pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.list_(pa.binary())), *[pa.array(c, pa.binary()) for c in cols[2:]]])))

    return groups.groupBy("shard").applyInArrow(build, INDEX)


def lookup(groups: DataFrame, index: DataFrame) -> DataFrame:
    """Groups of new rows against the index: every digest of either side with the row that stays and the number of rows."""

    def look(new: pa.Table, old: pa.Table) -> pa.Table:
        if old.num_rows:
            row = old.to_pylist()[0]
            bits = [np.unpackbits(np.frombuffer(x[:-8], np.uint8))[: int.from_bytes(x[-8:], "little")] for x in row["levels"]]
            mph = PerfectHash(bits)
            held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
            winners, counts = (np.frombuffer(row[c], np.int64).copy() for c in ("winners", "counts"))
        else:
            mph, held, winners, counts = PerfectHash([]), np.zeros((0, 4), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = _keys(new["digest"]) if new.num_rows else np.zeros((0, 4), np.uint64)
        winner, n = (new[c].to_numpy().astype(np.int64) if new.num_rows else np.zeros(0, np.int64) for c in ("winner", "n"))
        slot = mph.slots(keys)
        member = slot >= 0
        member[member] = (held[slot[member]] == keys[member]).all(axis=1)
        at = slot[member]
        winners[at] = np.maximum(winners[at], winner[member])
        counts[at] += n[member]
        every = np.concatenate([held, keys[~member]])
        return pa.table({
            "digest": pa.array([x.tobytes() for x in every], pa.binary()),
            "keep_id": pa.array(np.concatenate([winners, winner[~member]]), pa.int64()),
            "group_size": pa.array(np.concatenate([counts, n[~member]]), pa.int64()),
        })

    return groups.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(look, GROUPS)


def mark(docs: DataFrame, history: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    history: documents seen before, whose rows count but are not returned; by
    default the half of docs with the smaller doc_ids serves as the history and
    the other half is looked up in its index. The index has so many shards that
    none holds much more than ``SHARD`` digests.
    """
    rows = saved(digests(docs), "exact-digests")
    if history is None:
        middle = rows.agg(F.percentile_approx("id", 0.5, 1000)).first()[0] or 0
        old, new = rows.where(F.col("id") <= middle), rows.where(F.col("id") > middle)
    else:
        old, new = digests(history), rows
    shards = shards or max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-(rows.count() if history is None else history.count()) // SHARD))
    index = saved(build_index(grouped(old, shards)), "exact-index")
    groups = lookup(grouped(new, shards), index)
    return rows.join(groups, "digest").select(
        "doc_id",
        F.when(F.col("keep_id") != LEAST, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """docs with the row of the largest doc_id of each group of equal texts, all columns as they are."""
    marks = saved(mark(docs).select(F.coalesce("doc_id", F.lit(LEAST)).alias("m1"), F.col("text_sha256").alias("m2"), "kept", "group_size"), "exact-marks")
    rows = docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(LEAST)).alias("k1"),
        F.sha2(lowered(F.coalesce(docs["text"], F.lit(""))).cast("binary"), 256).alias("k2"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )
    lost = marks.where("not kept").select("m1", "m2").distinct()
    left = rows.join(lost, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left_anti")
    repeats = marks.where("kept and group_size > 1").groupBy("m1", "m2").count().where("count > 1").limit(1).count()
    if repeats:
        left = left.dropDuplicates(["k1", "k2"])
    return left.select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = {
    "op6_exact_dedup": """
    WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
