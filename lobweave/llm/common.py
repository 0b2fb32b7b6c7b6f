"""Helpers that the operators of this subpackage share.

Working tables go to the folder that the cluster names in
``spark.checkpoint.dir``; nothing is written to a machine's own disk unless the
master is local and no folder is named, as in tests.

Rows are told apart by ``row_keys``: ``k1`` is doc_id (null sorts last), ``k2``
a hash of the text. Rows that agree in both are repeats of one document and
share its result.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = 2**63 - 1
TASK = 128 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PACKED = "kind int, part int, bucket int, a binary, b binary, c binary, d binary, e binary, f binary"
_PACKED = pa.schema([(n, pa.int32()) for n in ("kind", "part", "bucket")] + [(n, pa.binary()) for n in "abcdef"])


def work_dir(spark: SparkSession) -> str:
    """The shared folder for working tables; set to a temporary one only for a local master without any."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lobweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: a cut in the lineage that outlives any executor."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``saved`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def partitions(texts: DataFrame) -> int:
    """How many partitions the work on texts is dealt over: those that the session names, or more where a task would get over ``TASK`` bytes of text."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // TASK))


def lowered(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def row_keys(docs: DataFrame) -> DataFrame:
    """k1, k2 and text alone: clashing or extra columns can't reach the operators. Null text is empty."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """All columns of docs in one struct beside k1 and k2, so that no name can clash."""
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("k1"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("k2"),
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
    )


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """task, whose worker gives freed memory back to the system when a partition ends: workers outlive their tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it, other C libraries don't
        if trim:
            trim(0)

    return run


def part_id() -> int:
    return TaskContext.get().partitionId()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def packed(rows: Iterable[tuple]) -> pa.RecordBatch:
    """(kind, part, bucket, a..f) tuples as one batch; missing blobs are null."""
    rows = [tuple(r) + (None,) * (9 - len(r)) for r in rows]
    cols = list(zip(*rows)) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _PACKED)], schema=_PACKED)


def dealt(kind: int, part: int, buckets: int, by: np.ndarray, *arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One packed row for each bucket (by % buckets) that has entries; arrays are cut alike."""
    if not len(by):
        return
    bucket = (by % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    cut = [np.ascontiguousarray(a[order]) for a in arrays]
    start = 0
    rows = []
    for k, end in enumerate(ends):
        if end > start:
            rows.append((kind, part, k, *[a[start:end].tobytes() for a in cut]))
        start = end
        if len(rows) >= 256:
            yield packed(rows)
            rows = []
    if rows:
        yield packed(rows)


def gathered(batches: Iterable[pa.RecordBatch]) -> dict[int, list[dict]]:
    """All packed rows of a partition by kind."""
    out: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            out.setdefault(row["kind"], []).append(row)
    return out


def joined_blobs(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), dtype=dtype)


def by_bucket(df: DataFrame, n: int) -> DataFrame:
    """Rows of one bucket in one of n partitions, buckets dealt evenly."""
    return df.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)))


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reached.

    Each round takes the least label of the neighbours and then that label's own
    label; both tables live in the shared folder. Hubs are met by Spark's split
    of skewed joins and by partial aggregation. Empty edges give no rows.
    Both directions come from one pass: edges that depend on the order of rows
    may be others in a second one, and an edge in one direction alone joins nothing.
    """
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    both = saved(both.where("a <> b").distinct(), f"{name}-edges")
    labels = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{name}-labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = saved(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), f"{name}-labels")
        moved = new.where("old <> label").limit(1).count()
        dropped(labels)
        labels = new.select("node", "label")
        if not moved:
            dropped(both)
            return labels
    raise RuntimeError(f"components: no fixed point after {rounds} rounds")
