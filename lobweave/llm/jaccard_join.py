"""Join of documents by the Jaccard similarity of their word shingles.

A document's set is hashed into groups; the counts of its groups are a point.
The overlap of two sets is at most the sum of the coordinates' minima, so pairs
that link lie close together in the sum of absolute differences.

* Routing: sets that link share one of the first n - ceil(t n) + 1 shingles of
  each in any order common to all. The order is that of the hashes, with the most
  frequent shingles last (those in many documents of some stretch of the input,
  a bounded list that moves work and no result). Documents that share such a
  shingle are a cell, parted where sizes leave a step that no link bridges. A
  frequent shingle is in the prefix of documents made of frequent ones alone, a
  family of near copies say; each input partition sends one of them and ties the
  others to it, so such a cell is a cluster at once and never one task's group.
* The points of a cell's members are packed into an R-tree whose nodes keep the
  upper corner of the counts and the range of the sizes; a search drops nodes by
  the summed minima of the query and the corner. Pairs that survive join clusters.
* Surviving pairs are verified on the shingles, cluster by cluster and again
  through an R-tree.
* A cluster too large for one task (``LARGE`` shingles) is split into blocks of
  rows. ``ROUNDS`` rounds of pivots, each an R-tree against every block, join a
  family of near copies to one component; in a last round all documents that are
  still outside the largest component are pivots at once, dealt into blocks of
  their own, so every pair that could still be joined is compared, and the rounds
  don't grow with the cluster. A cell too large for one task becomes one cluster.

Equal sets are one class and travel once. A set's name has 64 bits; a second hash
travels with the classes, and names that two sets share are found by it, sent to
all (they are next to none) and told apart in a second pass. Components, not pairs,
are returned: pairs inside a component already known are skipped.

Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased.
Sets of fewer words than a shingle are the whole sequence; documents without
words (null text too) have no set and link with nothing. A null doc_id sorts
last and gives a null component_id where it is the smallest; repeated rows get
the same result; words and shingles are told apart by 64-bit hashes; an empty
table gives an empty result; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, PACKED, by_bucket, components, dealt, dropped, gathered, joined_blobs, keyed, lean, mixed, packed, part_id, partitions, row_keys, saved

DOC, CLASS, CELL, EDGE, STAR, CLASH = 0, 1, 2, 3, 4, 5  # kinds of packed rows
GROUPS, FANOUT = 64, 16
LONG = (800, 3_200, 12_800)  # sizes from each of which sets have four times the groups: more shingles need finer counts
LARGE = 3_000_000  # shingles in one task's cluster or block
CELL_MOST = 100_000  # members of a cell that one task indexes
PIVOTS, ROUNDS = 256, 2  # pivots of each large cluster in a round; rounds before the last
STRETCH, SHARE, FREQUENT = 1_000_000, 0.002, 100_000  # shingles of a stretch, of its documents that make a shingle frequent, frequent shingles kept
_CACHED_WORDS = 400_000
_OTHER = np.uint64(0xD6E8FEB86659FD93)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words = words
        self.cache: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        if len(cache) > _CACHED_WORDS:
            cache.clear()
        return out

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.words:
            whole = hashlib.blake2b(b" ".join(words), digest_size=8, person=b"short")
            return np.frombuffer(whole.digest(), np.uint64)
        h = self._hashes(words)
        n = len(h) - self.words + 1
        out = np.full(n, self.words, np.uint64)
        for k in range(self.words):
            out = mixed(out ^ h[k : k + n])
        return np.unique(out)


def set_id(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two hashes of a set as signed numbers; of the first only so many bits."""
    sums = [mixed(x).sum(dtype=np.uint64) + np.uint64(len(shingles)) for x in (shingles, shingles ^ _OTHER)]
    one, two = mixed(np.array(sums, np.uint64))
    return tuple(np.array([one & np.uint64(2**bits - 1), two], np.uint64).view(np.int64).tolist())


def named(one: int, two: int, apart: frozenset) -> int:
    """A set's name: its first hash, or one of both hashes where two sets share the first."""
    return one if one not in apart else int(mixed(np.array([one ^ two], np.int64).view(np.uint64)).view(np.int64)[0])


def prefix(shingles: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles of which one is shared with every set that links: sorted ones, frequent ones last."""
    n = len(shingles)
    length = n + (-num * n) // den + 1
    if length == 1 and n * (den - num) < num:
        return shingles[:0]  # only an equal set can link, and those are one class already
    often = _among(shingles, frequent)
    if often[:length].any():
        shingles = np.concatenate([shingles[~often], shingles[often]])
    return shingles[:length]


def _among(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which shingles are frequent ones (sorted)."""
    if not len(frequent):
        return np.zeros(len(shingles), bool)
    return frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles


class CountTree:
    """R-tree over count vectors, packed by recursive halving along the widest coordinate."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order: list[np.ndarray] = []
        todo = [np.argsort(sizes, kind="stable")]
        while todo:
            ids = todo.pop()
            if len(ids) <= FANOUT:
                order.append(ids)
                continue
            at = points[ids]
            axis = int(at.var(axis=0).argmax())
            ids = ids[np.argsort(at[:, axis], kind="stable")]
            half = max(FANOUT, len(ids) // 2 // FANOUT * FANOUT)
            todo += [ids[half:], ids[:half]]
        self.order = np.concatenate(order)
        self.points, self.sizes = points[self.order], sizes[self.order]
        edges = np.concatenate([[0], np.cumsum([len(x) for x in order])])
        corner, least, most, count = self.points, self.sizes, self.sizes, len(self.sizes)
        self.levels = []  # from the leaves' parents up: corner, least, most, first child, last child
        while True:
            first, last = edges[:-1], edges[1:]
            corner = np.maximum.reduceat(corner, first, axis=0)
            least, most = np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)
            self.levels.append((corner, least, most, first, last))
            count = len(first)
            if count == 1:
                break
            edges = np.append(np.arange(0, count, FANOUT), count)

    def search(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Indices of all points whose bound lets them link with the query."""
        nodes = np.zeros(1, np.int64)
        for corner, least, most, first, last in reversed(self.levels):
            nodes = nodes[self._may(corner[nodes], least[nodes], most[nodes], point, size, num, den)]
            if not len(nodes):
                return nodes
            width = last[nodes] - first[nodes]
            nodes = np.repeat(first[nodes], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        nodes = nodes[self._may(self.points[nodes], self.sizes[nodes], self.sizes[nodes], point, size, num, den)]
        return self.order[nodes]

    @staticmethod
    def _may(corner, least, most, point, size, num, den) -> np.ndarray:
        small = np.maximum(least, -(-num * size // den))
        bound = np.minimum(corner, point).sum(axis=1, dtype=np.int64)
        return (small <= most) & (least * num <= size * den) & ((bound * (num + den) >= num * (size + small)) | _saturated(most))


def scale_of(size) -> np.ndarray:
    """0 to 3: a set of this size has GROUPS * 4 ** scale groups."""
    return np.searchsorted(LONG, size, side="right")


def counts_of(sets: list[np.ndarray], scale: int = 0) -> np.ndarray:
    """Points: how many shingles of each set fall into each group."""
    groups = GROUPS * 4**scale
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    group = (np.concatenate(sets) % np.uint64(groups)).astype(np.int64)
    return np.bincount(rows * groups + group, minlength=len(sets) * groups).reshape(-1, groups)


def folded(points: np.ndarray, scale: int, to: int) -> np.ndarray:
    """Points of a finer scale at a coarser one."""
    return points.reshape(len(points), 4 ** (scale - to), -1).sum(axis=1)


def _saturated(size) -> np.ndarray:
    """Sizes whose counts a stored point may cut short: the bound says nothing of them."""
    return np.asarray(size) > 65535


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = np.sort(np.concatenate([a, b]), kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return den * inter >= num * (len(a) + len(b) - inter)


def spanned(points: np.ndarray, sizes: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """The component of each point, as the index of a member: under the bound alone, or verified on sets.

    Goes on until every point outside the largest component has been a query, so
    every pair that isn't joined already is seen from one side.
    """
    n = len(sizes)
    label, size_of, done = np.arange(n), np.ones(n, np.int64), np.zeros(n, bool)
    tree = CountTree(points, sizes)
    while len(open_ := np.flatnonzero(~done & (label != size_of.argmax()))):
        for at in open_:
            if size_of[label[at]] > 1 and label[at] == size_of.argmax():
                continue
            done[at] = True
            near = tree.search(points[at], sizes[at], num, den)
            near = near[label[near] != label[at]]
            while len(near):
                if sets is not None and not linked(sets[at], sets[near[0]], num, den):
                    near = near[1:]
                    continue
                old, mine = np.unique(label[near] if sets is None else label[near[:1]]), label[at]
                label[np.isin(label, old)] = mine
                size_of[mine] += size_of[old].sum()
                size_of[old] = 0
                near = near[label[near] != mine]
    return label


def _bounded(num: int, den: int):
    """Edges that span what the bound leaves of each cell; rows: cell1, cell2, sid, n, point."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        one, two, sid, size = (np.concatenate([b[c].to_numpy() for b in batches]) for c in ("cell1", "cell2", "sid", "n"))
        blobs = [x.as_buffer() for b in batches for x in b["point"]]
        scale, place, points = scale_of(size), np.empty(len(size), np.int64), {}
        for c in range(len(LONG) + 1):
            rows = np.flatnonzero(scale == c)
            place[rows] = np.arange(len(rows))
            points[c] = np.frombuffer(b"".join(blobs[i] for i in rows), np.uint16).reshape(len(rows), GROUPS * 4**c)
        del blobs

        def at(rows: np.ndarray, c: int, to: int) -> np.ndarray:
            x = points[c][place[rows]]
            return x if c == to else folded(x, c, to)

        order = np.lexsort((sid, two, one))
        cuts = np.flatnonzero(np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]), [True]]))
        width = np.diff(cuts)
        edges = []
        for m in range(2, FANOUT + 1):  # cells of one leaf, all of a width together
            first = cuts[:-1][width == m]
            left, right = np.triu_indices(m, 1)
            a, b = order[(first[:, None] + left).ravel()], order[(first[:, None] + right).ravel()]
            near = (size[a] * den >= size[b] * num) & (size[b] * den >= size[a] * num)
            a, b = a[near], b[near]
            for ca, cb in {*zip(scale[a].tolist(), scale[b].tolist())}:
                pick = np.flatnonzero((scale[a] == ca) & (scale[b] == cb))
                step = max(1, 2_000_000 // (GROUPS << 2 * max(ca, cb)))
                for k in range(0, len(pick), step):
                    x, y = a[pick[k : k + step]], b[pick[k : k + step]]
                    may = CountTree._may(at(y, cb, min(ca, cb)), size[y], size[y], at(x, ca, min(ca, cb)), size[x], num, den)
                    edges.append(np.stack([sid[x[may]], sid[y[may]]], axis=1))
        for first, last in zip(cuts[:-1][width > FANOUT], cuts[1:][width > FANOUT]):
            for c in range(len(LONG) + 1):
                ids = order[first:last][scale[order[first:last]] == c]
                if not len(ids):
                    continue
                held = at(ids, c, c)
                label = spanned(held, size[ids], num, den)
                moved = label != np.arange(len(ids))
                edges.append(np.stack([sid[ids[moved]], sid[ids[label[moved]]]], axis=1))
                for d in range(c + 1, len(LONG) + 1):  # pairs across the border of two scales
                    over = order[first:last][scale[order[first:last]] == d]
                    over = over[size[over] * num <= size[ids].max() * den]
                    tree = CountTree(held, size[ids]) if len(over) else None
                    for i in over:
                        near = ids[tree.search(at(np.array([i]), d, c)[0], size[i], num, den)]
                        edges.append(np.stack([np.full(len(near), sid[i]), sid[near]], axis=1))
        both = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return join


def _frequent(words: int, share: float = SHARE):
    """Shingles that many documents of a stretch of the input have, with their number there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, total = Shingler(words), [], 0

        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= max(3, share * len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token[many].view(np.int64)), pa.array(n[many])], names=["token", "n"])

        for batch in batches:
            for text in batch["text"].to_pylist():
                held.append(shingler(text))
                total += len(held[-1])
                if total > STRETCH:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return count


def _route(words: int, num: int, den: int, buckets: int, frequent, apart: frozenset, bits: int):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shingler, often = part_id(), Shingler(words), frequent.value
        docs, tokens, sids, sizes, points = [], [], [], [], {}
        for batch in batches:
            for k1, k2, text in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["text"].to_pylist()):
                s = shingler(text)
                one, check = set_id(s, bits) if len(s) else (0, 0)
                sid = named(one, check, apart)
                docs.append((k1, k2, len(s), sid, check))
                if len(s) and sid not in points:
                    token = prefix(s, often, num, den)
                    tokens.append(token)
                    sids.append(np.full(len(token), sid))
                    sizes.append(np.full(len(token), len(s), np.uint32))
                    points[sid] = np.minimum(counts_of([s], int(scale_of(len(s))))[0], 65535).astype(np.uint16)
        if not docs:
            return
        k1, k2, n, sid, check = np.array(docs, np.int64).T
        yield packed([(DOC, part, part % buckets, k1.tobytes(), k2.tobytes(), n.tobytes(), sid.tobytes())])
        order = _smallest(sid, k1, k2, n > 0)
        if len(order):
            yield from _clashes(sid, check, n > 0)
        for c in range(len(LONG) + 1):
            rows = order[scale_of(n[order]) == c]
            if len(rows):
                yield from dealt(CLASS, part, buckets, sid[rows].view(np.uint64), sid[rows], k1[rows], k2[rows], n[rows], np.stack([points[x] for x in sid[rows]]), check[rows])
        if tokens:
            token, sid, size = np.concatenate(tokens), np.concatenate(sids), np.concatenate(sizes)
            hot = _among(token, often)
            yield from dealt(CELL, part, buckets, token[~hot], token[~hot], sid[~hot], size[~hot])
            lead, least, edges = _stars(token[hot], sid[hot])
            yield from dealt(STAR, part, buckets, lead, lead, least)
            if len(edges):
                yield packed([(EDGE, part, part % buckets, edges[:, 0].tobytes(), edges[:, 1].tobytes())])

    return route


def _clashes(sid: np.ndarray, check: np.ndarray, use: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Names that stand for more than one set."""
    both = np.unique(np.stack([sid[use], check[use]], axis=1), axis=0)
    again = np.unique(both[1:][both[1:, 0] == both[:-1, 0], 0])
    if len(again):
        yield packed([(CLASH, 0, 0, again.tobytes())])


def _stars(token: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token once with its smallest set, and the distinct edges from that set to the token's others."""
    if not len(token):
        return token, sid, np.zeros((0, 2), np.int64)
    order = np.lexsort((sid, token))
    token, sid = token[order], sid[order]
    first = np.concatenate([[True], token[1:] != token[:-1]])
    lead = sid[first][np.cumsum(first) - 1]
    return token[first], sid[first], np.unique(np.stack([lead, sid], axis=1)[lead != sid], axis=0)


def _smallest(sid: np.ndarray, k1: np.ndarray, k2: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The row of the smallest document of each set."""
    order = np.lexsort((k2, k1, sid))
    order = order[use[order]]
    return order[np.concatenate([[True], sid[order][1:] != sid[order][:-1]])] if len(order) else order


def _meet(num: int, den: int, most: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = gathered(batches)
        for r in rows.get(DOC, []):
            yield packed([(DOC, 0, 0, r["a"], r["b"], r["c"], r["d"])])
        for r in rows.get(CLASH, []):
            yield packed([(CLASH, 0, 0, r["a"])])
        if classes := rows.get(CLASS, []):
            sid = joined_blobs(classes, "a", np.int64)
            yield from _clashes(sid, joined_blobs(classes, "f", np.int64), np.ones(len(sid), bool))
        by_scale: dict[int, list[dict]] = {}
        for r in rows.get(CLASS, []):
            by_scale.setdefault(int(scale_of(np.frombuffer(r["d"], np.int64, 1)[0])), []).append(r)
        for c, classes in by_scale.items():
            sid, k1, k2, n = (joined_blobs(classes, x, np.int64) for x in "abcd")
            point = joined_blobs(classes, "e", np.uint16).reshape(len(sid), -1)
            order = _smallest(sid, k1, k2, n > 0)
            yield packed([(CLASS, 0, 0, *[x[order].tobytes() for x in (sid, k1, k2, n, point)])])
        for r in rows.get(EDGE, []):
            yield packed([(EDGE, 0, 0, r["a"], r["b"])])
        if stars := rows.get(STAR, []):
            edges = _stars(joined_blobs(stars, "a", np.int64), joined_blobs(stars, "b", np.int64))[2]
            if len(edges):
                yield packed([(EDGE, 0, 0, edges[:, 0].tobytes(), edges[:, 1].tobytes())])
        if cells := rows.get(CELL, []):
            token, sid, n = joined_blobs(cells, "a", np.int64), joined_blobs(cells, "b", np.int64), joined_blobs(cells, "c", np.uint32).astype(np.int64)
            order = np.lexsort((sid, n, token))
            token, sid, n = token[order], sid[order], n[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])])
            token, sid, n = token[new], sid[new], n[new]
            # a step in size that no link can bridge parts a cell
            first = np.concatenate([[True], (token[1:] != token[:-1]) | (n[1:] * num > n[:-1] * den)])
            group = np.cumsum(first) - 1
            size = np.bincount(group)[group]
            fits, over = (size > 1) & (size <= most), (size > most) & ~first
            if fits.any():
                held = sid[fits]
                lead = np.flatnonzero(first[fits])
                sums = np.stack([np.add.reduceat(mixed(held.view(np.uint64) ^ np.uint64(k)), lead) for k in (0, 1)], axis=1)  # order of members doesn't count
                yield packed([(CELL, 0, 0, sums.tobytes(), lead.tobytes(), held.tobytes())])
            if over.any():
                yield packed([(EDGE, 0, 0, sid[first][group[over]].tobytes(), sid[over].tobytes())])

    return meet


def _unpacked(table: DataFrame, kind: int, names: str, points: bool = False) -> DataFrame:
    """The rows of one kind; the last name is a point where points says so."""
    fields = names.split()
    types = ["long"] * (len(fields) - points) + ["binary"] * points

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cols = [pa.array(np.frombuffer(row[c], np.int64)) for c, t in zip("abcdef", types) if t == "long"]
                if points:
                    blob = row["abcdef"[len(cols)]]
                    width = len(blob) // len(cols[0])
                    cols.append(pa.array([blob[k : k + width] for k in range(0, len(blob), width)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=fields)

    return table.where(f"kind = {kind}").select(*"abcdef"[: len(fields)]).mapInArrow(lean(unpack), ", ".join(map(" ".join, zip(fields, types))))


def _cells(table: DataFrame) -> DataFrame:
    """Members (cell1, cell2, sid) of the distinct cells: shingles that the same documents share are one cell."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lead = np.frombuffer(row["b"], np.int64)
                names, ends = np.frombuffer(row["a"], np.int64).reshape(-1, 2), np.append(lead, len(row["c"]) // 8)
                _, at = np.unique(names, axis=0, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[at, 0]), pa.array(names[at, 1]), pa.array([row["c"][8 * ends[k] : 8 * ends[k + 1]] for k in at], pa.binary())], names=["cell1", "cell2", "sids"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [x.as_buffer() for x in batch["sids"]]
            width = np.array([x.size // 8 for x in blobs], np.int64)
            cells = [pa.array(np.repeat(batch[c].to_numpy(), width)) for c in ("cell1", "cell2")]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(np.frombuffer(b"".join(blobs), np.int64))], names=["cell1", "cell2", "sid"])

    found = table.where(f"kind = {CELL}").select(*"abc").mapInArrow(lean(cells), "cell1 long, cell2 long, sids binary")
    return found.groupBy("cell1", "cell2").agg(F.max("sids").alias("sids")).mapInArrow(lean(members), "cell1 long, cell2 long, sid long")


def _whole_clusters(words: int, num: int, den: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        rows = ((r["cluster"], r["sid"], r["text"]) for batch in batches for r in batch.to_pylist())
        for _, group in groupby(rows, key=lambda r: r[0]):
            held = {sid: shingler(text) for _, sid, text in group}
            sids, sets = np.array(list(held), np.int64), list(held.values())
            label = spanned(counts_of(sets), np.array([len(s) for s in sets]), num, den, sets) if len(sets) > 1 else np.zeros(1, np.int64)
            moved = label != np.arange(len(sids))
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(sids[moved]), pa.array(sids[label[moved]])], names=["a", "b"])

    return join


def _against_pivots(words: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(block: pa.Table, pivots: pa.Table) -> pa.Table:
        shingler, out = Shingler(words), []
        if block.num_rows and pivots.num_rows:
            heads = dict(zip(pivots["sid"].to_pylist(), map(shingler, pivots["text"].to_pylist())))
            sids, sets = list(heads), list(heads.values())
            tree = CountTree(counts_of(sets), np.array([len(s) for s in sets]))
            for sid, text in zip(block["sid"].to_pylist(), block["text"].to_pylist()):
                s = shingler(text)
                for j in tree.search(counts_of([s])[0], len(s), num, den):
                    if sids[j] != sid and linked(s, sets[j], num, den):
                        out.append((sid, sids[j]))
        return pa.table(list(map(list, zip(*out))) if out else [[], []], schema=schema)

    return join


def _large_links(docs: DataFrame, words: int, num: int, den: int, pivots: int, block: int, rounds: int) -> DataFrame:
    """Links (a, b) that span the components of clusters too large for a task; docs: cluster, weight, sid, n, text.

    So many rounds of pivots, and a last one in which all sets outside their
    cluster's largest component that were no pivots are dealt into blocks too, and
    each of these meets every block of the cluster.
    """
    docs = saved(docs.withColumn("slot", F.pmod(F.xxhash64("sid"), F.ceil(F.col("weight") / block))), "jaccard-large")
    slots = docs.select("cluster", "slot").distinct()
    state = saved(docs.select("cluster", "sid", "n", F.col("sid").alias("label"), F.lit(False).alias("done")).distinct(), "jaccard-state")
    links = state.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0)
    for round_ in range(rounds + 1):
        sizes = state.groupBy("cluster", "label").count()
        top = sizes.groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
        open_ = state.where("not done").join(top, "cluster").where("label <> top")
        if round_ < rounds:
            rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("sid")))
            chosen = open_.withColumn("rank", rank).where(F.col("rank") <= pivots).select("cluster", "sid", F.lit(0).cast("long").alias("deal"))
        else:
            weight = open_.groupBy("cluster").agg(F.sum("n").alias("weight"))
            chosen = open_.join(weight, "cluster").select("cluster", "sid", F.pmod(F.xxhash64("sid", F.lit(1)), F.ceil(F.col("weight") / block)).alias("deal"))
        chosen = saved(chosen, "jaccard-pivots")
        if not chosen.limit(1).count():
            break
        deals = chosen.select("cluster", "deal").distinct()
        heads = chosen.join(docs.select("cluster", "sid", "text"), ["cluster", "sid"]).dropDuplicates(["cluster", "sid"])
        heads = saved(heads.join(slots, "cluster"), "jaccard-heads")  # as many copies as blocks
        rows = docs.select("cluster", "slot", "sid", "text").join(deals, "cluster")
        found = saved(rows.groupBy("cluster", "slot", "deal").cogroup(heads.groupBy("cluster", "slot", "deal")).applyInArrow(_against_pivots(words, num, den), "a long, b long"), "jaccard-links")
        links = links.union(found)
        if round_ < rounds:
            labels = components(found.union(state.select(F.col("sid").alias("a"), F.col("label").alias("b"))), "jaccard-large")
            done = chosen.select("sid", F.lit(True).alias("now"))
            new = state.join(labels.withColumnsRenamed({"node": "sid", "label": "new"}), "sid", "left").join(done, "sid", "left")
            state = saved(new.select("cluster", "sid", "n", F.coalesce("new", "label").alias("label"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")), "jaccard-state")
    return links


def classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, large: int = LARGE, pivots: int = PIVOTS, rounds: int = ROUNDS, cell_most: int = CELL_MOST, bits: int = 64) -> DataFrame:
    """One row for each row of docs: k1, k2 (its keys), n_shingles, rep1, rep2 (keys of the smallest document of its component).

    Two documents link when den * intersection >= num * union of their sets of
    shingles of so many words. The last five say when work is split, and how many
    bits of a set's name are used at first; the result doesn't depend on them.
    """
    spark = docs.sparkSession
    texts = row_keys(docs)
    n = partitions(texts)
    buckets = n
    often = texts.select("text").mapInArrow(lean(_frequent(words)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = np.sort(np.array([r.token for r in often.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()], np.int64).view(np.uint64))
    sent, apart = spark.sparkContext.broadcast(often), frozenset()
    while True:
        routed = by_bucket(texts.mapInArrow(lean(_route(words, num, den, buckets, sent, apart, bits)), PACKED), n)
        table = saved(routed.mapInArrow(lean(_meet(num, den, cell_most)), PACKED), "jaccard-cells")
        clashes = {r.sid for r in _unpacked(table, CLASH, "sid").distinct().collect()}  # of N sets about N * N / 2 ** 65
        if not clashes:
            break
        dropped(table)
        apart |= clashes
    points = _unpacked(table, CLASS, "sid r1 r2 n point", points=True)
    reps = points.drop("point")
    members = _cells(table).join(points.select("sid", "n", "point").hint("merge"), "sid")
    bounded = members.select("cell1", "cell2", "sid", "n", "point").repartition(n, "cell1").mapInArrow(lean(_bounded(num, den)), "a long, b long")
    clusters = components(bounded.union(_unpacked(table, EDGE, "a b")), "jaccard-clusters")
    suspects = clusters.select(F.col("node").alias("sid"), F.col("label").alias("cluster")).join(reps, "sid")
    weights = suspects.groupBy("cluster").agg(F.sum("n").alias("weight"))
    suspects = saved(suspects.join(weights, "cluster"), "jaccard-suspects")
    found = suspects.select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), "sid", "cluster", "weight", "n")
    wanted = texts.join(found.hint("merge"), ["k1", "k2"])  # grows with the input, so it isn't sent to all
    fits = wanted.where(F.col("weight") <= large).select("cluster", "sid", "text").repartition(n, "cluster").sortWithinPartitions("cluster", "sid")  # by sid too: a task that is run again gives the same links
    links = fits.mapInArrow(lean(_whole_clusters(words, num, den)), "a long, b long")
    if suspects.where(F.col("weight") > large).limit(1).count():
        links = links.union(_large_links(wanted.where(F.col("weight") > large), words, num, den, pivots, large, rounds))
    labels = components(links, "jaccard-links")
    members = reps.join(labels.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "r1", "r2", F.coalesce("label", "sid").alias("label"))
    best = members.groupBy("label").agg(F.min(F.struct("r1", "r2")).alias("rep"))
    of = members.join(best, "label").select("sid", "rep")
    rows = _unpacked(table, DOC, "k1 k2 n sid").join(of, "sid", "left")
    own = F.col("n") == 0
    return rows.select("k1", "k2", F.col("n").alias("n_shingles"), F.when(own, F.col("k1")).otherwise(F.col("rep.r1")).alias("rep1"), F.when(own, F.col("k2")).otherwise(F.col("rep.r2")).alias("rep2"))


def dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with the smallest doc_id of each component, once, all columns as they are; documents without words stay."""
    marks = saved(classes(docs, words, num, den), "jaccard-marks")
    lost = marks.where("k1 <> rep1 or k2 <> rep2").select("k1", "k2").distinct()
    left = keyed(docs).join(lost, ["k1", "k2"], "left_anti")
    if marks.where("n_shingles > 0 and k1 = rep1 and k2 = rep2").groupBy("k1", "k2").count().where("count > 1").limit(1).count():
        left = left.dropDuplicates(["k1", "k2"])
    return left.select("row.*")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return classes(docs, words=3, num=90, den=100).select(real("k1").alias("doc_id"), "n_shingles", real("rep1").alias("component_id"))


SQL: dict[str, str] = {
    "op7_ngram_jaccard_join": r"""
    WITH RECURSIVE t AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT doc_id, g FROM s QUALIFY count(*) OVER (PARTITION BY g) > 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM o a JOIN o b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id
    FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) ON a = doc_id"""
}
