"""Byte-level BPE by a segment tree over byte positions.

A pretoken's bytes are the leaves; a leaf holds the rank of the pair that starts
at its position, and each node the leftmost minimum below it. A merge takes the
root, joins the two parts through the list of live neighbours and makes point
updates for the joined pair, the pair before it and the pair that is gone, each
of logarithmic cost. Short pretokens of one size take their merges together as
rows of one array; long ones take theirs alone, in O(n log n).

Each match of the pattern is encoded separately; ids are the ranks. Null text is
empty and has no ids; texts of any length are whole; there are no special
tokens; an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import Ids

NONE = np.iinfo(np.int64).max
SHORT = 32  # bytes; longer pretokens are merged alone


class Bpe:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of: dict[int, bytes] = {r: b for b, r in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {self.ranks[t[:k]] << 32 | self.ranks[t[k:]]: r for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.texts = Ids(self._words, pattern)

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...] | None] = [None] * len(words)
        by_size: dict[int, list[int]] = {}
        data = [w.encode(errors="surrogatepass") for w in words]
        for i, b in enumerate(data):
            if (r := self.ranks.get(b)) is not None:
                out[i] = (r,)
            elif len(b) > SHORT:
                out[i] = tuple(self.merge(b))
            else:
                by_size.setdefault(1 << (len(b) - 1).bit_length(), []).append(i)
        for size, at in by_size.items():
            for i, ids in zip(at, self._together([data[i] for i in at], size)):
                out[i] = ids
        return out

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pretoken."""
        n = len(data)
        size = 1 << max(1, (n - 1).bit_length())
        ids = self.single[np.frombuffer(data, np.uint8)].tolist()
        get = self.pairs.get
        none = 1 << 62
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (r := get(ids[i] << 32 | ids[i + 1])) is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            at += size
            tree[at] = value
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                tree[at] = a if a < b else b

        while (top := tree[1]) < none:
            at, ids_at = top & 0xFFFFFFFF, top >> 32
            ids[at] = ids_at
            gone = after[at]
            end = after[gone]
            after[at] = end
            put(gone, none)
            r = None
            if end < n:
                before[end] = at
                r = get(ids_at << 32 | ids[end])
            put(at, none if r is None else r << 32 | at)
            if (left := before[at]) >= 0:
                r = get(ids[left] << 32 | ids_at)
                put(left, none if r is None else r << 32 | left)
        out, at = [], 0
        while at < n:
            out.append(ids[at])
            at = after[at]
        return out

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[found] == key) & (left >= 0) & (right >= 0), self.pair_ranks[found] << 32 | at, NONE)

    def _together(self, data: list[bytes], size: int) -> Iterator[tuple[int, ...]]:
        """The same for pretokens of at most size bytes, all at once."""
        rows = len(data)
        lengths = np.array([len(b) for b in data])
        raw = np.frombuffer(b"".join(b.ljust(size, b"\0") for b in data), np.uint8).reshape(rows, size)
        live = np.arange(size)[None, :] < lengths[:, None]
        ids = np.full((rows, size + 1), -1, np.int64)  # the last column stays -1: no neighbour
        ids[:, :size][live] = self.single[raw[live]]
        tree = np.full((rows, 2 * size), NONE, np.int64)
        tree[:, size:] = self._leaf(ids[:, :-1], ids[:, 1:], np.arange(size)[None, :])
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        after = np.minimum(np.arange(1, size + 1)[None, :].repeat(rows, 0), size)
        after = np.concatenate([after, np.full((rows, 1), size)], axis=1)
        before = np.arange(-1, size)[None, :].repeat(rows, 0)
        flat = tree.reshape(-1)

        def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            base = row * (2 * size)
            at = at + size
            flat[base + at] = value
            while size > 1 and at[0] > 1:
                at >>= 1
                node = base + 2 * at
                flat[base + at] = np.minimum(flat[node], flat[node + 1])

        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            top = tree[row, 1]
            at, rank = top & 0xFFFFFFFF, top >> 32
            gone = after[row, at]
            end = after[row, gone]
            ids[row, at] = rank
            ids[row, gone] = -1
            after[row, at] = end
            before[row, end] = at
            put(row, gone, np.full(len(row), NONE))
            put(row, at, self._leaf(rank, ids[row, end], at))
            left = before[row, at]
            has = left >= 0
            if has.any():
                put(row[has], left[has], self._leaf(ids[row[has], left[has]], rank[has], left[has]))
            row = row[tree[row, 1] < NONE]
        kept = ids[:, :size] >= 0
        ends = np.cumsum(kept.sum(axis=1))
        every = ids[:, :size][kept].tolist()
        start = 0
        for end in ends.tolist():
            yield tuple(every[start:end])
            start = end

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        return self.texts(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(2)
def bpe(path: str) -> Bpe:
    """One for each worker and file."""
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = list(codec.encode([t or "" for t in part["text"].to_pylist()]))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, data (binary) for rows that ``encode`` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe(path)
        for batch in batches:
            data = [codec.decode(np.asarray(x.values.to_numpy())) for x in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of encoding and then decoding each text, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe(path)
        text_of = {i: str(i) for i in codec.bytes_of}.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for ids in codec.encode([t or "" for t in batch["text"].to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(text_of, ids.tolist())).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, out)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


SQL: dict[str, str] = {}
