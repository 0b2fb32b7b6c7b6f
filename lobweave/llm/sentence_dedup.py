"""Removal of repeated runs of sentences.

A text is cut into sentences after runs of . ! ? ; : , and line ends (so a
clause counts as a sentence); the pieces together are the text. Sentences
without words only lie between others. Every run of ``RUN`` consecutive sentences
is a span, if it has at least ``WORDS`` words, so that three one-word sentences
don't match by chance. Spans are hashed (128 bits) over the words of each of
their sentences, A-Z lower-cased, and joined over the whole corpus; of equal
spans the first by doc_id and place stays, and every sentence that another one
covers is removed.

That is the rule of the query and its SQL (``whole=False``). By default the
operator tells more sentences apart: marks of other scripts end them, each
character of a script without spaces is a word, and a sentence of more than
``LONG`` words is cut after words chosen by their hash (so that equal passages
are cut alike), after ``LONG`` words at the latest and never into pieces of fewer
than ``LEAST``. The runs are the same.

Only the first span of a key leaves an input partition, later ones are settled
there; so a passage that a third of all rows hold is one row for each partition.

Null text is empty; a null doc_id comes after all others; a text with fewer
sentences or words than a span keeps everything; texts of any length are cut
whole; repeated rows (doc_id and text) are one document and share its result; rows
of one doc_id with different texts are ordered by a hash of the text; an empty
table gives an empty result; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PACKED, by_bucket, dealt, gathered, joined_blobs, keyed, packed, part_id, partitions, row_keys

RUN, WORDS = 3, 12
LONG, LEAST = 16, 4  # words of a sentence that isn't cut; words of a cut one's piece at least
ENDS = r".!?;:,\n"
_UNIT = re.compile(rf"[^{ENDS}]*[{ENDS}]+|[^{ENDS}]+".encode())
_MORE = r".!?;:,\n\u2026\u3002\u3001\uff01\uff1f\uff1b\uff1a\uff0c\uff0e\u061f\u061b\u060c\u06d4\u0964\u0965\u1362\u104b\u17d4"
_MORE_UNIT = re.compile(rf"[^{_MORE}]*[{_MORE}]+|[^{_MORE}]+")
_SPACE = "\t-\r "  # the white space of bytes.split
_WORD = re.compile(rf"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]|[^{_SPACE}\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_CUT = 6  # one word in so many ends a piece of an over-long sentence
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
ENTRY, LATER = 0, 1


def _pieces(text: str, long: int) -> list[tuple[int, list[bytes]]]:
    """Length in bytes and words of each sentence, over-long ones cut."""
    out = []
    for unit in _MORE_UNIT.findall(text):
        if unit.isascii():
            split = unit.encode().split()
            if len(split) <= long:
                out.append((len(unit), split))
                continue
        found = list(_WORD.finditer(unit))
        start, held = 0, []
        for i, w in enumerate(found):
            held.append(w.group().encode())
            if len(found) > long and LEAST <= min(len(held), len(found) - i - 1) and (len(held) >= long or zlib.crc32(held[-1]) % _CUT == 0):
                out.append((len(unit[start : w.end()].encode()), held))
                start, held = w.end(), []
        out.append((len(unit[start:].encode()), held))
    return out


class Sentences:
    """The sentences of a text (bytes) and the spans among them."""

    def __init__(self, data: bytes, run: int = RUN, words: int = WORDS, whole: bool = True):
        if whole:
            pieces = _pieces(data.lower().decode(), LONG)
            sizes, split = [k for k, _ in pieces], [w for _, w in pieces]
        else:
            units = _UNIT.findall(data.lower())
            sizes, split = [len(u) for u in units], [u.split() for u in units]
        self.ends = np.cumsum(np.array(sizes, np.int64))
        n = np.fromiter(map(len, split), np.int64, len(split))
        self.worded = np.flatnonzero(n)  # sentences without words lie between
        total = np.concatenate([[0], np.cumsum(n[self.worded])])
        self.first = np.flatnonzero(total[run:] - total[:-run] >= words)
        self.last = self.first + run - 1
        self.keys = np.zeros((len(self.first), 2), np.uint64)
        if len(self.first):
            digest = b"".join(hashlib.blake2b(b" ".join(split[i]), digest_size=16).digest() for i in self.worded)
            lanes = np.frombuffer(digest, np.uint64).reshape(-1, 2)
            for k in range(run):
                self.keys = self.keys * _POWER + lanes[self.first + k]

    def covered(self, spans: np.ndarray) -> np.ndarray:
        """Which sentences the spans of these numbers cover."""
        step = np.zeros(len(self.ends) + 1, np.int64)
        np.add.at(step, self.worded[self.first[spans]], 1)
        np.add.at(step, self.worded[self.last[spans]] + 1, -1)
        return np.cumsum(step[:-1]) > 0


def _later(h1, h2, k1, k2, at) -> tuple[np.ndarray, np.ndarray]:
    """Indices of each key's first span, and of the spans elsewhere that come after it."""
    order = np.lexsort((at, k2, k1, h2, h1))
    same = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    elsewhere = (k1[order] != k1[first]) | (k2[order] != k2[first]) | (at[order] != at[first])
    return order[~same], order[same & elsewhere]


def _spans(run: int, words: int, whole: bool, buckets: int):
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = part_id()
        keys, docs, counts = [], [], []
        for batch in batches:
            for a, b, text in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"].to_pylist()):
                s = Sentences(text.encode(), run, words, whole)
                if len(s.first):
                    keys.append(s.keys)
                    docs.append((a, b))
                    counts.append(len(s.first))
        if not docs:
            return
        key = np.concatenate(keys)
        k1, k2 = (np.repeat(np.array(x, np.int64), counts) for x in zip(*docs))
        at = np.concatenate([np.arange(n) for n in counts]).astype(np.int32)
        first, later = _later(key[:, 0], key[:, 1], k1, k2, at)
        if len(later):
            yield packed([(LATER, part, part % buckets, k1[later].tobytes(), k2[later].tobytes(), at[later].tobytes())])
        yield from dealt(ENTRY, part, buckets, key[first, 0], key[first, 0], key[first, 1], k1[first], k2[first], at[first])

    return spans


FOUND = "k1 long, k2 long, spans binary"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each document that come after an equal one, as far as a bucket knows."""
    rows = gathered(batches)
    found = [[np.frombuffer(r[c], t) for c, t in zip("abc", (np.int64, np.int64, np.int32))] for r in rows.get(LATER, [])]
    if entries := rows.get(ENTRY, []):
        h1, h2 = (joined_blobs(entries, c, np.uint64) for c in "ab")
        k1, k2, at = joined_blobs(entries, "c", np.int64), joined_blobs(entries, "d", np.int64), joined_blobs(entries, "e", np.int32)
        later = _later(h1, h2, k1, k2, at)[1]
        found.append([k1[later], k2[later], at[later]])
    if not found:
        return
    k1, k2, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, k2, k1))
    k1, k2, at = k1[order], k2[order], at[order]
    cut = np.flatnonzero(np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])) if len(k1) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(k1)]]) if len(cut) else cut
    yield pa.RecordBatch.from_arrays([pa.array(k1[cut]), pa.array(k2[cut]), pa.array([at[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], names=["k1", "k2", "spans"])


def removed(docs: DataFrame, run: int = RUN, words: int = WORDS, whole: bool = True) -> DataFrame:
    """docs' rows with row, n_sentences, n_removed, spans (array of start, length in bytes) and new (the text that stays)."""
    texts = row_keys(docs)
    n = partitions(texts)
    buckets = 4 * n
    met = by_bucket(texts.mapInArrow(_spans(run, words, whole, buckets), PACKED), n).mapInArrow(_meet, FOUND)
    found = met.groupBy("k1", "k2").agg(F.collect_list("spans").alias("found"))
    rows = keyed(docs).join(found.hint("merge"), ["k1", "k2"], "left")
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).schema["row"]
    schema = T.StructType([row, *T._parse_datatype_string("n_sentences long, n_removed long, spans array<struct<start:int,length:int>>, new string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, spans, new = [], [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
                data = (text or "").encode()
                if not found:
                    total.append(len(_pieces((text or "").lower(), LONG)) if whole else len(_UNIT.findall(data)))
                    gone.append(0)
                    spans.append([])
                    new.append(text or "")
                    continue
                s = Sentences(data, run, words, whole)
                covered = s.covered(np.unique(np.frombuffer(b"".join(found), np.int32)))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                starts = np.concatenate([[0], s.ends])
                runs = starts[edge].reshape(-1, 2).tolist()
                total.append(len(covered))
                gone.append(int(covered.sum()))
                spans.append([{"start": a, "length": b - a} for a, b in runs])
                edges = [0, *(x for r in runs for x in r), len(data)]
                new.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(new, pa.string())], names=["row", "n_sentences", "n_removed", "spans", "new"])

    return rows.select("row", F.col("row.text").alias("text"), "found").mapInArrow(cut, schema)


def dedup(docs: DataFrame, run: int = RUN, words: int = WORDS, whole: bool = True) -> DataFrame:
    """docs with the removed sentences cut from text; texts that become empty drop out; n_chars, where there is one, is set anew."""
    out = removed(docs, run, words, whole)
    cut = F.col("n_removed") > 0
    out = out.where(~(cut & (F.length("new") == 0)))
    value = {"text": F.when(cut, F.col("new")).otherwise(F.col("row.text")), "n_chars": F.when(cut, F.length("new")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[value.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op9_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs, whole=False).select("row.doc_id", "n_sentences", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("new").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op9_sentence_span_dedup": r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?;:,\n]*[.!?;:,\n]+|[^.!?;:,\n]+') AS s FROM documents),
    u AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS u, unnest(s) AS s FROM t),
    v AS (SELECT *, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM u),
    x AS (SELECT doc_id, u, array_to_string(w, ' ') AS w, len(w) AS n FROM v WHERE len(w) > 0),
    k AS (SELECT doc_id, u AS a, lead(u, 2) OVER p AS z, n + lead(n) OVER p + lead(n, 2) OVER p AS n, w || chr(10) || lead(w) OVER p || chr(10) || lead(w, 2) OVER p AS k FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY u)),
    l AS (SELECT doc_id, a, z FROM k WHERE n >= 12 QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, a) > 1),
    c AS (SELECT DISTINCT doc_id, unnest(range(a, z + 1)) AS u FROM l),
    m AS (SELECT u.doc_id, u.u, u.s, c.u IS NOT NULL AS gone FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.u = u.u),
    n AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY u), false) AS new FROM m),
    r AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (gone) AS n_removed, count(*) FILTER (new) AS n_spans, coalesce(string_agg(s, '' ORDER BY u) FILTER (NOT gone), '') AS kept FROM n GROUP BY doc_id)
    SELECT documents.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents LEFT JOIN r USING (doc_id)"""
}
