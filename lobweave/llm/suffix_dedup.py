"""Removal of repeated byte strings by prefix-free parsing.

Each text (UTF-8 bytes) is parsed at triggers: a position is one if the rolling
(Karp-Rabin) hash of the ``GRAM`` bytes from it on is among the lowest of one in
``MODULUS`` values; a phrase goes from a trigger to the end of the next one's bytes, so triggers are set
by content alone and no phrase is a prefix of another. A window of ``size`` bytes
belongs to its first trigger; a window without any among its first ``REACH``
positions lies in a long phrase and belongs to the first least hash there. Equal
windows so have their owner (anchor) at the same offset. A window is a suffix of
the phrase before its anchor, and the parse from the anchor on up to its end.

* The parse's first ``size + 1 - REACH`` bytes from the anchor lie in each of its
  windows. Their hash is the key by which anchors meet; keys that occur once in
  the corpus drop out after a shuffle of 12 bytes an anchor.
* The phrases and parses of the anchors that remain travel to the key's bucket. A
  bucket holds a whole share of the corpus order, since equal windows have equal
  keys. Its distinct phrases are the *dictionary*, whose suffixes are sorted into a
  suffix array (``dictionary_order``). What follows the anchors is parsed into
  ranks of phrases and sorted by ranks into the *parse's* suffix array
  (``parse_order``), which is the byte order as no phrase is another one's prefix;
  neighbours' common bytes are kept beside it. Windows in corpus order are those
  sorted by the place of their suffix in the one and of their anchor in the other;
  equal ones are neighbours there (``repeated``).

The first window of each class in (doc_id, start) stays, all others are
removed; bytes covered by a removed window go, judged on the input.

Copies of a whole text are settled by their digest and identical contexts of a
key within one input partition by the first of them, so a passage or document
in a third of all rows reaches its bucket once for each partition and not once
for each row. Keys with very many anchors (at the edges of such a passage every
context is another) are sent to all, a list of bounded length; their windows
travel by 128-bit hash instead, as one task could not hold such a key's anchors.
Within a bucket keys are worked on in slices of about ``SLICE`` anchors.

Null text is empty; a null doc_id comes after all others; texts under ``size``
bytes keep everything; texts of any length are parsed whole; repeated rows (doc_id
and text) are one document and share its result; rows that share a doc_id but not
the text are ordered by a hash of the text; an empty table gives an empty result;
other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PACKED, by_bucket, dealt, gathered, joined_blobs, keyed, lean, mixed, packed, part_id, partitions, row_keys, saved

SIZE, REACH, GRAM, MODULUS = 100, 50, 8, 48
SLICE, STRETCH = 10_000, 1 << 20  # anchors worked on at once; positions hashed at once
COPY, ENTRY, MANY, TABLE, HOT, REST = 0, 1, 2, 3, 4, 5  # kinds of packed rows
HOT_LEAST, HOT_SHARE, HOT_KEYS = 1_000, 1e-4, 1_000_000  # anchors, and anchors for each document, from which a key is hot; keys sent to all
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)
_KEEP_HIGH = np.uint64(0xFFFFFFFF00000000)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base up to n, and of its inverse."""
    one = np.arange(n) == 0
    return tuple(np.cumprod(np.where(one, np.uint64(1), x), dtype=np.uint64) for x in (_POWER, np.uint64(pow(int(_POWER), -1, 2**64))))


def rolled(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the GRAM bytes from each position on, finalised so that all its bits depend on all bytes."""
    out = []
    for at in range(0, len(data) - GRAM + 1, STRETCH):
        part = data[at : at + STRETCH + GRAM - 1]
        up, down = _powers(1 << (len(part) - 1).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)])
        out.append(mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def triggers(hashes: np.ndarray) -> np.ndarray:
    return hashes < np.uint64(2**64 // MODULUS)


def anchors(data: np.ndarray, size: int = SIZE, reach: int = REACH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that own windows of data (uint8), and the first and last window start of each."""
    n = len(data) - size + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 3
    m = n + reach - 1  # positions that are looked at; each has a whole gram, as size > reach + GRAM
    hashes = rolled(data[: m + GRAM - 1])
    least = (hashes & _KEEP_HIGH) | np.arange(m, dtype=np.uint64)
    width = 1
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[reach - width : reach - width + n])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    found = np.append(np.flatnonzero(triggers(hashes)), 2 * m + size)
    following = np.repeat(found, np.diff(found, prepend=-1))[:n]
    at = np.where(following < np.arange(n) + reach, following, at)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.concatenate([first[1:], [n]]) - 1


def _context_keys(data: np.ndarray, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the length bytes from each position on."""
    out = np.full(len(at), seed, np.uint64)
    for k in range(0, length - 7, 8):
        word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at + k]).view(np.uint64)[:, 0]
        out = mixed(out ^ word) * _POWER
    tail = length % 8
    if tail:
        word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)[at + length - 8]).view(np.uint64)[:, 0]
        out = mixed(out ^ word) * _POWER
    return mixed(out)


def _bytes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
    for a, b, text in zip(k1, k2, batch["text"].cast(pa.large_binary())):
        yield a, b, np.frombuffer(text.as_buffer(), np.uint8)


def _parse(size: int, reach: int, buckets: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, digests, keys, counts = part_id(), [], [], [], []
        for batch in batches:
            for a, b, data in _bytes(batch):
                at, _, _ = anchors(data, size, reach)
                docs.append((a, b))
                counts.append(len(at))
                keys.append(_context_keys(data, at, size + 1 - reach) if len(at) else np.zeros(0, np.uint64))
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
        if not docs:
            return
        k1, k2 = (np.array(x, np.int64) for x in zip(*docs))
        ends = np.cumsum(np.array(counts, np.int64))
        yield packed([(TABLE, part, part % buckets, k1.tobytes(), k2.tobytes(), ends.tobytes())])
        digest = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        has = np.array(counts) > 0
        yield from dealt(COPY, part, buckets, digest[has, 0], digest[has, 0], digest[has, 1], k1[has], k2[has], np.flatnonzero(has).astype(np.uint32))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        same = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        begin = np.flatnonzero(same)
        length = np.diff(np.concatenate([begin, [len(key)]]))
        once = order[begin[length == 1]]
        yield from dealt(ENTRY, part, buckets, key[once], key[once], once.astype(np.uint32))
        many = key[order[begin[length > 1]]]
        yield from dealt(MANY, part, buckets, many, many, length[length > 1].astype(np.int64))
        rest = np.sort(order[np.repeat(length > 1, length)]).astype(np.uint32)
        yield packed([(REST, part, part % buckets, rest.tobytes())])

    return parse


def _meet(hot_least: int):
    return lambda batches: _met(batches, hot_least)


def _met(batches: Iterator[pa.RecordBatch], hot_least: int) -> Iterator[pa.RecordBatch]:
    """Of each bucket: anchors whose key occurs again, and documents whose text a smaller one has."""
    rows = gathered(batches)
    for r in rows.get(TABLE, []):
        yield packed([(TABLE, r["part"], 0, r["a"], r["b"], r["c"])])
    if rows.get(MANY) or len(rows.get(ENTRY, [])) >= hot_least:  # else a key comes at most once from each of too few partitions
        once = joined_blobs(rows.get(ENTRY, []), "a", np.uint64)
        key = np.concatenate([joined_blobs(rows.get(MANY, []), "a", np.uint64), once])
        n = np.concatenate([joined_blobs(rows.get(MANY, []), "b", np.int64), np.ones(len(once), np.int64)])
        key, group = np.unique(key, return_inverse=True)
        total = np.bincount(group, n).astype(np.int64)
        hot = total >= hot_least
        if hot.any():
            yield packed([(HOT, 0, 0, key[hot].tobytes(), total[hot].tobytes())])
    for r in rows.get(REST, []):
        yield packed([(ENTRY, r["part"], 0, None, r["a"])])
    if entries := rows.get(ENTRY, []):
        key, at = joined_blobs(entries, "a", np.uint64), joined_blobs(entries, "b", np.uint32)
        part = np.repeat([r["part"] for r in entries], [len(r["b"]) // 4 for r in entries])
        many = joined_blobs(rows.get(MANY, []), "a", np.uint64)
        order = np.argsort(key, kind="stable")
        run = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        again = np.zeros(len(key), bool)
        group = np.cumsum(run) - 1
        again[order] = (np.bincount(group) > 1)[group]
        again |= np.isin(key, many)
        yield from _by_part(ENTRY, part[again], b=at[again])
    if copies := rows.get(COPY, []):
        d1, d2 = joined_blobs(copies, "a", np.uint64), joined_blobs(copies, "b", np.uint64)
        k1, k2 = joined_blobs(copies, "c", np.int64), joined_blobs(copies, "d", np.int64)
        doc = joined_blobs(copies, "e", np.uint32)
        part = np.repeat([r["part"] for r in copies], [len(r["e"]) // 4 for r in copies])
        order = np.lexsort((k2, k1, d2, d1))
        same = np.concatenate([[False], (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])])
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        first = order[start]
        later = order[same & ((k1[order] != k1[first]) | (k2[order] != k2[first]))]
        yield from _by_part(COPY, part[later], e=doc[later])


def _by_part(kind: int, part: np.ndarray, **arrays: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    parts, begin = np.unique(part[order], return_index=True)
    ends = np.concatenate([begin[1:], [len(part)]])
    out = []
    for p, a, b in zip(parts, begin, ends):
        blobs = {n: x[order[a:b]].tobytes() for n, x in arrays.items()}
        out.append((kind, int(p), 0, *[blobs.get(n) for n in "abcdef"]))
    if out:
        yield packed(out)


CANDIDATES = "hot boolean, k1 long, k2 long, whole boolean, ordinals binary"


def _to_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts' entries as one row for each document that has any; ordinals count its anchors (uint32).

    Rows marked hot are no documents but keys (k1) and their numbers of anchors (k2).
    """
    tables, entries, copies = {}, {}, {}
    for rows in gathered(batches).values():
        for r in rows:
            if r["kind"] == TABLE:
                tables[r["part"]] = r
            elif r["kind"] == HOT:
                key, n = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([True] * len(key)), pa.array(key), pa.array(n), pa.nulls(len(key), pa.bool_()), pa.nulls(len(key), pa.binary())], names=["hot", "k1", "k2", "whole", "ordinals"])
            else:
                (entries if r["kind"] == ENTRY else copies).setdefault(r["part"], []).append(r["b" if r["kind"] == ENTRY else "e"])
    for part, r in tables.items():
        k1, k2, ends = (np.frombuffer(r[c], np.int64) for c in "abc")
        at = np.sort(np.frombuffer(b"".join(entries.get(part, [])), np.uint32)).astype(np.int64)
        doc = np.searchsorted(ends, at, side="right")
        whole = np.zeros(len(k1), bool)
        whole[np.frombuffer(b"".join(copies.get(part, [])), np.uint32)] = True
        ordinal = (at - np.concatenate([[0], ends])[doc]).astype(np.uint32)
        cut = np.searchsorted(doc, np.arange(len(k1) + 1))
        some = np.flatnonzero(whole | (cut[1:] > cut[:-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([False] * len(some), pa.bool_()), pa.array(k1[some]), pa.array(k2[some]), pa.array(whole[some]), pa.array([b"" if whole[i] else ordinal[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())],
            names=["hot", "k1", "k2", "whole", "ordinals"],
        )


def _repeats(h1: np.ndarray, h2: np.ndarray, k1: np.ndarray, k2: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first window of each hash, and of those elsewhere that come after it."""
    order = np.lexsort((start, k2, k1, h2, h1))
    same = np.concatenate([[False], (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])])
    first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    elsewhere = (k1[order] != k1[first]) | (k2[order] != k2[first]) | (start[order] != start[first])
    return order[~same], order[same & elsewhere]


def _runs(k1: np.ndarray, k2: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows as runs of neighbouring starts: k1, k2, first, last."""
    order = np.lexsort((start, k2, k1))
    k1, k2, start = k1[order], k2[order], start[order]
    new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (start[1:] > start[:-1] + 1)]) if len(k1) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(k1)]]).astype(np.int64) - 1 if len(first) else first
    return k1[first], k2[first], start[first].astype(np.int32), start[last].astype(np.int32)


def _contexts(size: int, reach: int, buckets: int, hot_keys):
    """Left and right parts of the anchors that meet others, by bucket of their key; equal ones of a partition once.

    Of hot keys the windows themselves go, each hash once from a partition, by
    bucket of the hash: a key's anchors may be too many for one task, a window's
    are one for each partition.
    """
    span = reach - 1
    middle = size + 1 - reach

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = part_id()
        cols: list[list[np.ndarray]] = [[] for _ in range(7)]

        def flush() -> Iterator[pa.RecordBatch]:
            key, k1, k2, at, reachd, left, right = (np.concatenate(c) for c in cols)
            for c in cols:
                c.clear()
            whole = np.ascontiguousarray(np.concatenate([key.view(np.uint8).reshape(-1, 8), reachd.view(np.uint8).reshape(-1, 4), left, right], axis=1))
            tag = whole.view(f"V{whole.shape[1]}")[:, 0]
            order = np.lexsort((at, k2, k1))
            _, first, group = np.unique(tag[order], return_index=True, return_inverse=True)
            later = order[first[group] != np.arange(len(order))]
            lead = np.sort(order[first])
            if len(later):
                lo, hi, _ = _fields(reachd[later])
                yield packed([(1, part, part % buckets, k1[later].tobytes(), k2[later].tobytes(), (at[later] - hi).astype(np.int32).tobytes(), (at[later] - lo).astype(np.int32).tobytes())])
            ids = np.stack([k1[lead], k2[lead]], axis=1)
            yield from dealt(0, part, buckets, key[lead], key[lead], ids, at[lead].astype(np.int32), reachd[lead], left[lead], right[lead])

        hot, windows = hot_keys.value, [[] for _ in range(5)]

        def flush_windows() -> Iterator[pa.RecordBatch]:
            h1, h2, k1, k2, start = (np.concatenate(c) for c in windows)
            for c in windows:
                c.clear()
            first, later = _repeats(h1, h2, k1, k2, start)
            if len(later):
                yield packed([(1, part, part % buckets, *[x.tobytes() for x in _runs(k1[later], k2[later], start[later])])])
            yield from dealt(2, part, buckets, h1[first], h1[first], h2[first], np.stack([k1[first], k2[first]], axis=1), start[first].astype(np.int32))

        held = held_windows = 0
        seen = set()
        for batch in batches:
            wanted = batch["ordinals"]
            for i, (a, b, data) in enumerate(_bytes(batch)):
                chosen = np.frombuffer(wanted[i].as_py() or b"", np.uint32)
                if not len(chosen) or (a, b) in seen:  # a repeated row is the same document
                    continue
                seen.add((a, b))
                at, s_from, s_to = (x[chosen] for x in anchors(data, size, reach))
                key = _context_keys(data, at, middle)
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    if often.any():
                        width = (s_to - s_from + 1)[often]
                        start = np.repeat(s_from[often] - (np.cumsum(width) - width), width) + np.arange(width.sum())
                        for c, x in zip(windows, (_context_keys(data, start, size), _context_keys(data, start, size, 1), np.full(len(start), a), np.full(len(start), b), start)):
                            c.append(x)
                        held_windows += len(start)
                        at, s_from, s_to, key = (x[~often] for x in (at, s_from, s_to, key))
                        if held_windows > 2_000_000:
                            yield from flush_windows()
                            held_windows = 0
                    if not len(at):
                        continue
                low, high = at - s_to, at - s_from  # offsets of the trigger in its windows
                room = np.minimum(len(data) - (at + middle), span)
                wide = np.concatenate([np.zeros(span, np.uint8), data, np.zeros(span + 8, np.uint8)])
                view = np.lib.stride_tricks.sliding_window_view(wide, span)
                left = view[at].copy()  # the span bytes before the trigger
                left[np.arange(span)[None, :] < (span - high)[:, None]] = 0
                right = view[at + span + middle].copy()
                reachable = np.minimum(room, span - low)
                right[np.arange(span)[None, :] >= reachable[:, None]] = 0
                packed_ints = (low | high << 8 | reachable << 16).astype(np.uint32)
                n = len(at)
                for c, x in zip(cols, (key, np.full(n, a), np.full(n, b), at, packed_ints, left, right)):
                    c.append(x)
                held += n
            if held > 400_000:
                yield from flush()
                held = 0
        if held:
            yield from flush()
        if held_windows:
            yield from flush_windows()

    return contexts


def _fields(x: np.ndarray) -> tuple[np.ndarray, ...]:
    x = x.astype(np.int64)
    return x & 255, x >> 8 & 255, x >> 16


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and which of them in that order differ from the one before."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0], kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    return order, new


def _cut_out(rows: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """So many bytes of a row from a start on, filled up with zeros, with the length as the last byte."""
    n, width = rows.shape
    wide = np.concatenate([rows, np.zeros((n, width), np.uint8)], axis=1)
    out = np.empty((len(row), width + 1), np.uint8)
    out[:, :-1] = np.lib.stride_tricks.sliding_window_view(wide, width, axis=1)[row, start]
    out[:, :-1][np.arange(width, dtype=np.uint8) >= length[:, None].astype(np.uint8)] = 0
    out[:, -1] = length
    return out


def dictionary_order(phrases: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of a dictionary: rows of phrases (uint8, set to the right), of which the suffixes of least to most bytes are wanted.

    Returns phrase and length of each suffix in order, the place of each, equal
    ones sharing one, and where each phrase's places begin by length.
    """
    width = phrases.shape[1]
    count = np.maximum(most - least + 1, 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    phrase = np.repeat(np.arange(len(phrases)), count)
    length = np.arange(begin[-1]) - np.repeat(begin[:-1] - least, count)
    rows = _cut_out(phrases, phrase, width - length, length)
    order, new = _sorted(rows)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return phrase[order], length[order], place, begin[:-1] - least


def parse_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes as sequences of ranks of their phrases (1 and on in byte order, 0 after the last), and the distinct phrases by rank (last column: length)."""
    n, width = rows.shape
    hashes = np.zeros((n, max(width - GRAM + 1, 0)), np.uint64)
    for k in range(GRAM):
        hashes += rows[:, k : k + hashes.shape[1]] * np.uint64(pow(int(_POWER), k, 2**64))
    cut = np.concatenate([triggers(mixed(hashes)), np.zeros((n, width - hashes.shape[1]), bool)], axis=1)
    cut[:, 0] = True
    row, start = np.nonzero(cut)
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    end = np.where(last, width, np.minimum(np.append(start[1:], 0)[: len(row)] + GRAM, width))
    phrases = _cut_out(rows, row, start, end - start)
    order, new = _sorted(phrases)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    index = np.cumsum(cut, axis=1)[row, start] - 1
    ranks = np.zeros((n, int(index.max(initial=0)) + 1), np.int64)
    ranks[row, index] = rank
    return ranks, phrases[order[new]]


def parse_order(key: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a parse: the anchors in order of their key and of what follows it, and how many bytes each has in common with the one before (-1: another key)."""
    ranks, _ = parse_of(rows)
    order = np.lexsort((*ranks.T[::-1], key))
    step = rows[order[1:]] != rows[order[:-1]]
    common = np.where(step.any(axis=1), step.argmax(axis=1), rows.shape[1])
    common[key[order[1:]] != key[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])[: len(order)]


def repeated(key: np.ndarray, ids: np.ndarray, at: np.ndarray, fields: np.ndarray, left: np.ndarray, right: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, offsets) of the windows that an earlier anchor also has, for all anchors of some keys."""
    by_key = np.argsort(key, kind="stable")
    edge = np.append(np.flatnonzero(np.concatenate([[True], key[by_key][1:] != key[by_key][:-1]])), len(key))
    cuts = edge[np.unique(np.searchsorted(edge, np.append(np.arange(0, len(key), SLICE), len(key))))]
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = by_key[a:b]
        who, offset = _repeated(*(x[part] for x in (key, ids, at, fields, left, right)), reach)
        if len(who):
            yield part[who], offset


def _repeated(key, ids, at, fields, left, right, reach: int) -> tuple[np.ndarray, np.ndarray]:
    span = reach - 1
    low, high, room = _fields(fields)
    low = np.maximum(low, span - room)  # the window has offset bytes left of the anchor and span - offset bytes right of the context
    order, new = _sorted(np.concatenate([left, high[:, None].astype(np.uint8)], axis=1))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    lead = order[new]
    least = np.full(len(lead), reach)
    np.minimum.at(least, rank, low)
    _, _, place, begin = dictionary_order(left[lead], least, high[lead])
    r_order, common = parse_order(key, right)
    parse = np.empty((reach, len(key)), np.int64)  # the class of what follows, for each offset
    for offset in range(reach):
        parse[offset, r_order] = np.cumsum(common < span - offset)
    count = np.maximum(high - low + 1, 0)
    who = np.repeat(np.arange(len(key)), count)
    offset = np.arange(len(who)) - np.repeat(np.cumsum(count) - count - low, count)
    pair = place[begin[rank[who]] + offset] * np.int64(len(key) + 1) + parse[offset, who]
    when = np.empty(len(key), np.int64)
    when[np.lexsort((at, ids[:, 1], ids[:, 0]))] = np.arange(len(key))
    corpus = np.lexsort((when[who], pair))
    again = np.zeros(len(corpus), bool)
    again[1:] = pair[corpus[1:]] == pair[corpus[:-1]]
    return who[corpus[again]], offset[corpus[again]]


SPANS = "k1 long, k2 long, first int, last int"


def _resolve(reach: int):
    def emit(k1, k2, first, last) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["k1", "k2", "first", "last"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        for r in rows.get(1, []):
            yield emit(*(np.frombuffer(r[c], np.int64) for c in "ab"), *(np.frombuffer(r[c], np.int32) for c in "cd"))
        if windows := rows.get(2, []):
            h1, h2 = (joined_blobs(windows, c, np.uint64) for c in "ab")
            k = joined_blobs(windows, "c", np.int64).reshape(-1, 2)
            start = joined_blobs(windows, "d", np.int32).astype(np.int64)
            later = _repeats(h1, h2, k[:, 0], k[:, 1], start)[1]
            yield emit(*_runs(k[later, 0], k[later, 1], start[later]))
        if not (rows := rows.get(0, [])):
            return
        span = reach - 1
        key, ids = joined_blobs(rows, "a", np.uint64), joined_blobs(rows, "b", np.int64).reshape(-1, 2)
        at, fields = joined_blobs(rows, "c", np.int32).astype(np.int64), joined_blobs(rows, "d", np.uint32)
        left, right = (joined_blobs(rows, c, np.uint8).reshape(-1, span) for c in "ef")
        order = np.lexsort((at, ids[:, 1], ids[:, 0]))
        new = np.concatenate([[True], (np.diff(ids[order], axis=0) != 0).any(axis=1) | (np.diff(at[order]) != 0)])
        key, ids, at, fields, left, right = (x[order[new]] for x in (key, ids, at, fields, left, right))
        hits = list(repeated(key, ids, at, fields, left, right, reach))
        if not hits:
            return
        who, offset = (np.concatenate(x) for x in zip(*hits))
        yield emit(*_runs(ids[who, 0], ids[who, 1], at[who] - offset))

    return resolve


def spans(docs: DataFrame, size: int = SIZE, reach: int = REACH, hot_least: int = HOT_LEAST, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row (k1, k2, whole, windows) for each document that loses bytes: its removed window starts as runs, or all of it."""
    if not 2 * GRAM < reach <= size // 2:
        raise ValueError("reach must lie between the gram and half the size")
    spark = docs.sparkSession
    texts = row_keys(docs)
    n = partitions(texts)
    buckets = n
    parsed = by_bucket(texts.mapInArrow(lean(_parse(size, reach, buckets)), PACKED), n)
    met = parsed.mapInArrow(lean(_meet(hot_least)), PACKED)
    candidates = saved(met.repartitionById(n, F.pmod("part", F.lit(n))).mapInArrow(lean(_to_docs), CANDIDATES).groupBy("hot", "k1", "k2").agg(F.min("whole").alias("whole"), F.max("ordinals").alias("ordinals")), "suffix-candidates")
    keys, candidates = candidates.where("hot"), candidates.where("not hot").drop("hot")
    least = max(hot_least, int(hot_share * texts.select("k1").count()))  # so there are at most anchors of an average text / share of them
    hot = keys.where(F.col("k2") >= least).orderBy(F.desc("k2"), "k1").limit(HOT_KEYS).select("k1").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.k1 for r in hot], np.int64).view(np.uint64)))
    wanted = candidates.where("not whole")
    met = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "ordinals").mapInArrow(lean(_contexts(size, reach, buckets, hot)), PACKED)
    found = by_bucket(met, n).mapInArrow(lean(_resolve(reach)), SPANS)
    windows = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("windows"))
    return windows.select("k1", "k2", F.lit(False).alias("whole"), "windows").union(candidates.where("whole").select("k1", "k2", "whole", F.array().cast("array<struct<first:int,last:int>>")))


def _cut(data: bytes, whole: bool | None, windows: list | None, size: int) -> list[tuple[int, int]]:
    """The removed runs [from, to) of a text."""
    if whole:
        return [(0, len(data))]
    out: list[tuple[int, int]] = []
    for w in sorted((w["first"], w["last"]) for w in windows or []):
        begin, end = w[0], w[1] + size
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def removed(docs: DataFrame, size: int = SIZE, reach: int = REACH) -> DataFrame:
    """docs' rows with what goes and what stays: row, spans (array of start, length in bytes), kept (binary), new (kept as text; characters that a cut breaks are left out)."""
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).schema["row"]
    schema = T.StructType([row, *T._parse_datatype_string("spans array<struct<start:int,length:int>>, kept binary, new string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, kept = [], []
            for text, whole, windows in zip(batch["text"].cast(pa.large_binary()).to_pylist(), batch["whole"].to_pylist(), batch["windows"].to_pylist()):
                text = text or b""
                gone = _cut(text, whole, windows, size)
                runs.append([{"start": a, "length": b - a} for a, b in gone])
                edges = [0, *(x for run in gone for x in run), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.binary()), pa.array([x.decode(errors="ignore") for x in kept], pa.string())], names=["row", "spans", "kept", "new"])

    rows = keyed(docs).join(spans(docs, size, reach), ["k1", "k2"], "left")
    return rows.select("row", F.col("row.text").alias("text"), "whole", "windows").mapInArrow(lean(cut), schema)


def dedup(docs: DataFrame, size: int = SIZE, reach: int = REACH) -> DataFrame:
    """docs with the removed bytes cut from text (broken characters at a cut are left out); texts that become empty drop out.

    A column n_chars is set anew; all others are as they were.
    """
    out = removed(docs, size, reach)
    cut = F.size("spans") > 0
    out = out.where(~(cut & (F.octet_length("new") == 0))).withColumn("new", F.when(cut, F.col("new")).otherwise(F.col("row.text")))
    field = lambda c: F.col("new").alias(c) if c == "text" else F.when(cut, F.length("new")).otherwise(F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
    return out.select(*[field(c) for c in docs.columns])


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return removed(docs).select(
        "row.doc_id",
        F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.expr("aggregate(spans, 0L, (a, x) -> a + x.length)").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL: dict[str, str] = {
    "op10_suffix_array_dedup": """
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    w AS (SELECT doc_id, unnest(range(octet_length(b) - 99)) AS s, b FROM d WHERE octet_length(b) >= 100),
    h AS (SELECT doc_id, s, sha256(b[s + 1 : s + 100]) AS h FROM w),
    g AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM h) WHERE n > 1),
    e AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM g),
    r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z, k FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM e) GROUP BY doc_id, k),
    t AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, k FROM r),
    m AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS runs, list({'f': before, 't': a} ORDER BY a) AS keep, max(z) AS last FROM t GROUP BY doc_id)
    SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0) AS n_spans,
           CASE WHEN runs IS NULL THEN sha256(b)
                ELSE sha256(unhex(array_to_string(list_transform(keep, lambda x: hex(b[x.f + 1 : x.t])), '') || hex(b[last + 1 : octet_length(b)]))) END AS kept_sha256
    FROM d LEFT JOIN m USING (doc_id)""",
}
