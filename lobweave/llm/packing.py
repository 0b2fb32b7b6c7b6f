"""Packing of documents into token windows by the sum-of-squares rule.

Documents come in the order of their input partition and are placed at once.
Whole windows are cut off a long document; of the rest as many whole units of
``UNIT`` tokens as there are go to the fill level (a multiple of the unit) that
makes the sum of the squared counts of partially filled windows least; a new
window is one of the choices, and ties go to the fuller one. An array holds the
count of windows at each level. The few tokens beyond the last whole unit join
those of the documents before, and each unit that they fill is placed by the same
rule. A piece may also be cut so that it completes a window and its rest is
placed anew; that counts as ``CUT`` more squares, so it happens only where
windows pile up at a level, as with many documents of one length. So the levels
stay low, whatever the input, and the windows held open are bounded by the levels
and not by the partition.

At the end of a partition the windows still open stay as the rule filled them;
each ends as sequences whose lengths are powers of two, which need no padding.

No shuffle: each input partition packs its own documents and numbers its
sequences within its own range, so a lost task is redone with equal results.

A null text is empty and is the end token alone; texts of any length are encoded
whole; rows are packed one by one, repeats too; a null doc_id stays null; an empty
table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, part_id

LENGTH, END = 2048, 1
UNIT, CUT = 128, 16  # tokens of a level; squares that a cut counts as
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Online packing of (tag, start, ids) pieces into windows of a length; yields sequences as lists of pieces."""

    def __init__(self, length: int, unit: int = UNIT):
        if length & (length - 1) or length % unit:
            raise ValueError("the length must be a power of two and a multiple of the unit")
        self.length, self.unit, self.top = length, unit, length // unit
        self.level = [0] * (self.top + 1)  # windows at each fill in units; none are kept at 0 and at the top
        self.windows: list[list[list]] = [[] for _ in self.level]
        self.tail: list[tuple] = []  # pieces short of a unit
        self.tail_size = 0

    @property
    def open(self) -> int:
        return sum(self.level)

    def _whole(self, size: int, level: list[int]) -> tuple[int, int]:
        """(change of the sum of squares, level) of the best place for size units; level 0 is a new window."""
        best = None
        for at in range(self.top - size, -1, -1):
            if at and not level[at]:
                continue
            change = (1 - 2 * level[at] if at else 0) + (2 * level[at + size] + 1 if at + size < self.top else 0)
            if best is None or change < best[0]:
                best = (change, at)
        return best

    def _cut(self, size: int) -> tuple[int, int] | None:
        """(change, level) of the best window that a part of size units completes, its rest placed whole."""
        best = None
        for at in range(self.top - 1, self.top - size, -1):
            if self.level[at]:
                after = list(self.level)
                after[at] -= 1
                change = 1 - 2 * self.level[at] + self._whole(size - (self.top - at), after)[0] + CUT
                if best is None or change < best[0]:
                    best = (change, at)
        return best

    def best(self, size: int) -> tuple[int, int]:
        """(change, level) of the best place for size units; they are cut where the level has less room."""
        whole, cut = self._whole(size, self.level), self._cut(size)
        return cut if cut and cut[0] < whole[0] else whole

    def _put(self, pieces: list[tuple], size: int) -> Iterator[list]:
        _, at = self.best(size)
        if at + size > self.top:
            first, rest = self._split(pieces, (self.top - at) * self.unit)
            yield self._fill(at, first, self.top - at)
            pieces, size = rest, size - (self.top - at)
            at = self._whole(size, self.level)[1]
        if full := self._fill(at, pieces, size):
            yield full

    def _fill(self, at: int, pieces: list[tuple], size: int) -> list | None:
        window = self.windows[at].pop() if at else []
        window += pieces
        if at:
            self.level[at] -= 1
        if at + size == self.top:
            return window
        self.level[at + size] += 1
        self.windows[at + size].append(window)
        return None

    @staticmethod
    def _split(pieces: list[tuple], size: int) -> tuple[list[tuple], list[tuple]]:
        """Pieces cut after size tokens."""
        first = []
        for k, (tag, start, ids) in enumerate(pieces):
            if len(ids) > size:
                return first + [(tag, start, ids[:size])] * (size > 0), [(tag, start + size, ids[size:]), *pieces[k + 1 :]]
            first.append((tag, start, ids))
            size -= len(ids)
        return first, []

    def place(self, tag, ids: np.ndarray) -> Iterator[list]:
        cut = len(ids) // self.length * self.length
        for at in range(0, cut, self.length):
            yield [(tag, at, ids[at : at + self.length])]
        units, tail = divmod(len(ids) - cut, self.unit)
        if units:
            yield from self._put([(tag, cut, ids[cut : cut + units * self.unit])], units)
        if tail:
            self.tail.append((tag, len(ids) - tail, ids[len(ids) - tail :]))
            self.tail_size += tail
            if self.tail_size >= self.unit:
                unit, self.tail = self._split(self.tail, self.unit)
                self.tail_size -= self.unit
                yield from self._put(unit, 1)

    def close(self) -> Iterator[list]:
        """The windows still open as they stand, the fuller first, and the tail; each in sequences of powers of two."""
        left = [w for at in range(self.top - 1, 0, -1) for w in self.windows[at]] + [self.tail] * (self.tail_size > 0)
        self.__init__(self.length, self.unit)
        for window in left:
            size = sum(len(ids) for _, _, ids in window)
            while size:
                sequence, window = self._split(window, 1 << size.bit_length() - 1)
                size -= 1 << size.bit_length() - 1
                yield sequence


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest come from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenIds:
    """The ids that tokenizers gives with a byte-level BPE file.

    Where the file's merges are the order of its ids, tiktoken's merge engine
    gives the same ids several times faster; else, for texts that hold an added
    token's string, and for those that the engine refuses (over 500,000 spaces on
    end are more than its pattern can take), the tokenizer itself is called.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.added = [x["content"] for x in file["added_tokens"]]
        self.fast = self._engine(file)

    @staticmethod
    def _engine(file: dict):
        vocab, byte_of = file["model"]["vocab"], _byte_of()
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        made = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])]
        if file["normalizer"] or not plain.items() <= (file["pre_tokenizer"] or {}).items() or made != sorted(made):
            return None
        import tiktoken

        added = {x["content"] for x in file["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
        return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast and not any(x in text for x in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # the pattern's stack; the tokenizer has none
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def token_ids(path: str) -> TokenIds:
    """One for each worker and file."""
    return TokenIds(path)


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row for each piece of a document: where it lies in the document and in its sequence, and its ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokens, number = SumOfSquares(length), token_ids(path), part_id() << 36
        cols: list[list] = [[] for _ in range(7)]
        held = 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())], names=[x.split()[0] for x in PIECES.split(", ")])
            for c in cols:
                c.clear()
            return out

        def add(sequence: list) -> None:
            nonlocal number, held
            offset = 0
            for (doc, tokens), start, ids in sequence:
                for c, x in zip(cols, (doc, start, len(ids), tokens, number, offset, ids.astype("<u4").tobytes())):
                    c.append(x)
                offset += len(ids)
            held += offset
            number += 1

        for part in batches:
            names = part["doc_id"].to_pylist()
            for doc, text in zip(names, part["text"].to_pylist()):
                ids = np.append(tokens(text or ""), np.uint32(end))
                for sequence in packer.place((doc, len(ids)), ids):
                    add(sequence)
                if held > 1_000_000:
                    yield batch()
                    held = 0
        for sequence in packer.close():
            add(sequence)
        if cols[0]:
            yield batch()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(lean(run), PIECES)


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL: dict[str, str] = {}
