"""Exact, near, sentence and suffix-array dedup against brute force and on edge cases."""

import hashlib
import random

import numpy as np
import pytest
from docs import CLASHING, corpus, saved, table

from lobweave.llm import exact_dedup, jaccard_join, sentence_dedup, suffix_dedup

ROWS = corpus()


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


# --- exact


def test_exact_against_brute_force(spark, tmp_path):
    got = [tuple(r) for r in exact_dedup.op6_exact_dedup(spark, saved(spark, tmp_path, ROWS)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    groups = {}
    for i, t in ROWS:
        groups.setdefault(low(t), []).append(i)
    want = [(i, max(groups[low(t)]), len(groups[low(t)]), i == max(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in ROWS]
    assert sorted(got) == sorted(want)


def test_exact_history_and_nulls(spark):
    history = spark.createDataFrame([(50, "Seen"), (51, "seen"), (60, "older only")], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "SEEN"), (None, "seen"), (None, "new"), (7, None), (8, "")], "doc_id long, text string")
    got = {(r.doc_id, r.text_sha256[:6]): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.mark(docs, history).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
    assert got == {(1, sha("seen")): (51, 4, False), (None, sha("seen")): (51, 4, False), (None, sha("new")): (None, 1, True), (7, sha("")): (8, 2, False), (8, sha("")): (8, 2, True)}


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint64).reshape(-1, 4)
    mph = exact_dedup.PerfectHash.build(keys[:3000])
    assert sorted(mph.slots(keys[:3000])) == list(range(3000))
    held = keys[:3000][np.argsort(mph.slots(keys[:3000]))]
    other = mph.slots(keys[3000:])
    assert not (held[other[other >= 0]] == keys[3000:][other >= 0]).all(axis=1).any()
    assert len(exact_dedup.PerfectHash.build(keys[:0]).slots(keys[:5])) == 5


# --- near


def near_components(rows, k, num, den):
    sets = {}
    for key, t in enumerate(rows):
        w = (t[1] or "").encode().lower().split()
        sets[key] = set() if not w else {tuple(w)} if len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    head = {i: i for i in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            inter = len(x & y)
            if x and y and den * inter >= num * (len(x) + len(y) - inter):
                p, q = root(a), root(b)
                head[max(p, q)] = min(p, q)
    least = {}
    for key in sets:
        least[root(key)] = min(least.get(root(key), rows[key][0]), rows[key][0])
    return sorted((rows[key][0], len(sets[key]), least[root(key)]) for key in sets)


SPLITS = {
    "as it is": {},
    "clusters split, one round": {"large": 150, "pivots": 2, "rounds": 1},
    "clusters split, no pivots": {"large": 300, "rounds": 0},
    "clusters split, many rounds": {"large": 150, "pivots": 2, "rounds": 3, "cell_most": 3},
    "cells split": {"cell_most": 2},
    "names that clash": {"bits": 4},
}


@pytest.mark.parametrize("k,num,split", [(3, 90, "as it is"), (5, 80, "as it is"), *((3, 80, x) for x in SPLITS)])
def test_near_against_brute_force(spark, k, num, split):
    got = sorted((r.k1, r.n_shingles, r.rep1) for r in jaccard_join.classes(table(spark, ROWS), k, num, 100, **SPLITS[split]).collect())
    assert got == near_components(ROWS, k, num, 100)


def test_components_of_edges_that_turn_when_read_again(spark):
    """Which way an edge points may depend on the order of rows, which a shuffle leaves open."""
    import pyarrow as pa

    from lobweave.llm.common import components

    def turned(batches):
        rng = random.Random()  # another one each time
        for batch in batches:
            edges = [rng.sample([2 * i, 2 * i + 1], 2) for i in batch["id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    got = components(spark.range(200).mapInArrow(turned, "a long, b long"), "turned").collect()
    assert sorted(tuple(r) for r in got) == [(i, i // 2 * 2) for i in range(400)]


@pytest.mark.parametrize("share,frequent", [(0.0, 100_000), (0.3, 5)])
def test_near_whatever_is_frequent(spark, monkeypatch, share, frequent):
    """Which shingles count as frequent moves work and no result: the order of the prefixes is another one each time."""
    import functools

    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "_frequent", functools.partial(jaccard_join._frequent, share=share))
    got = sorted((r.k1, r.n_shingles, r.rep1) for r in jaccard_join.classes(table(spark, ROWS), 3, 80, 100).collect())
    assert got == near_components(ROWS, 3, 80, 100)


def test_near_long_documents_of_two_scales(spark):
    rng = random.Random(5)
    rows = []
    for n in (2900, 2990, 3010, 3300, 13000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows.append((len(rows), " ".join(base)))
        rows.append((len(rows), " ".join(base[: int(n * 0.93)])))
        rows.append((len(rows), " ".join(base[: int(n * 0.7)])))
    got = sorted((r.k1, r.n_shingles, r.rep1) for r in jaccard_join.classes(table(spark, rows), 3, 90, 100).collect())
    assert got == near_components(rows, 3, 90, 100)


def test_tree_search_loses_nothing():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 4000, rng.integers(5, 400)).astype(np.uint64)) for _ in range(200)]
    sets += [s[:-1] for s in sets[:50] if len(s) > 12]
    sizes = np.array([len(s) for s in sets])
    points = jaccard_join.counts_of(sets)
    tree = jaccard_join.CountTree(points, sizes)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if jaccard_join.linked(s, t, 80, 100)}
        assert want <= set(tree.search(points[i], sizes[i], 80, 100).tolist())


# --- sentences


def sentence_brute(rows, run=3, words=12):
    """(doc_id, n_sentences, n_removed, n_spans, kept_sha256) by the definition, character by character."""
    cut = {}
    for i, t in sorted(dict(rows).items()):
        units, now = [], ""
        for c in t or "":
            if now and now[-1] in ".!?;:,\n" and c not in ".!?;:,\n":
                units.append(now)
                now = ""
            now += c
        cut[i] = units + [now] * bool(now)
    seen, out = set(), []
    for i, units in cut.items():
        said = [(k, low(u).encode().split()) for k, u in enumerate(units)]
        said = [(k, w) for k, w in said if w]
        gone = [False] * len(units)
        for j in range(len(said) - run + 1):
            span = tuple(tuple(w) for _, w in said[j : j + run])
            if sum(map(len, span)) < words:
                continue
            if span in seen:
                gone[said[j][0] : said[j + run - 1][0] + 1] = [True] * (said[j + run - 1][0] + 1 - said[j][0])
            seen.add(span)
        kept = "".join(u for u, g in zip(units, gone) if not g)
        out.append((i, len(units), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sentences_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join(rng.choice(["aa", "B", "c\u00e9", "dd"]) for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 20]))) + rng.choice([". ", "!? ", ", ", ";", "\n", ":\n\n", " . "])
    pool = [sentence() for _ in range(30)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 9))] for _ in range(12)]
    rows = [(i, "".join(x if rng.random() < 0.9 else x.upper() for _ in range(rng.randint(0, 4)) for x in rng.choice([rng.choice(passages), [sentence()]])) + rng.choice(["", "an end"])) for i in range(70)]
    rows += [(80, None), (81, ""), (82, "a. b. c. " * 3000), (83, ". , ;"), (84, "no mark " * 400), (85, "no mark " * 400)]
    rows += [rows[3], rows[9]]
    got = {tuple(r) for r in sentence_dedup.op9_sentence_span_dedup(spark, saved(spark, tmp_path, rows)).collect()}
    assert got == set(sentence_brute(rows))


def test_sentences_example(spark):
    lead = "one two three four five, six seven eight nine ten; eleven twelve thirteen fourteen fifteen sixteen."
    rows = [(1, f"First words here. {lead} the end"), (2, f"other start! {lead} other end"), (3, lead + lead), (4, None), (5, "short. short. short.")]
    got = {r.row.doc_id: (r.n_sentences, r.n_removed, r.new) for r in sentence_dedup.removed(table(spark, rows)).collect()}
    assert got[1] == (5, 0, rows[0][1])
    assert got[2] == (5, 3, "other start! other end"[:12] + " other end")
    assert got[3] == (6, 6, "")
    assert got[4] == (0, 0, "") and got[5] == (3, 0, rows[4][1])


def test_sentences_repeats_across_partitions(spark):
    rng = random.Random(1)
    passage = ", ".join(" ".join(f"p{rng.randrange(999)}" for _ in range(8)) for _ in range(8)) + "."
    rows = [(i, f"{' '.join(f'x{rng.randrange(9999)}' for _ in range(20))}. {passage} tail{i}.") for i in range(40)]
    out = {r.row.doc_id: r.new for r in sentence_dedup.removed(table(spark, rows, parts=7)).collect()}
    assert "p" in out[0].split(". ")[1] and all(passage[10:60] not in out[i] for i in range(1, 40))


def test_sentences_whole_runs(spark):
    """Passages of two long sentences, without marks or spaces, and the short last clauses of a run."""
    rng = random.Random(4)
    new = lambda n, p="x": [f"{p}{rng.randrange(10**6)}" for _ in range(n)]
    two = " ".join(new(30, "a")) + ". " + " ".join(new(30, "a")) + "."
    bars = " | ".join(new(60, "b"))
    tail = " ".join(new(8, "t")) + ", " + " ".join(new(9, "t")) + "; " + " ".join(new(8, "t")) + ". short one here. tiny."
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(120)) + "\u3002"
    around = lambda x, end: f"{' '.join(new(12))}. {x}{end} {' '.join(new(12))}."
    rows = [(2 * i + k, around(x, end)) for i, (x, end) in enumerate([(two, ""), (bars, " |"), (tail, ""), (han, "")]) for k in (0, 1)]
    out = {r.row.doc_id: (r.n_removed, r.new) for r in sentence_dedup.removed(table(spark, rows)).collect()}
    assert all(out[i] == (0, rows[i][1]) for i in (0, 2, 4, 6))
    assert out[1][1].count(" a") == 0
    assert out[3][1].count("b") <= 2 * sentence_dedup.LONG
    assert "tiny" not in out[5][1] and " t" not in out[5][1]
    assert sum(c > "\u3400" for c in out[7][1]) <= 2 * sentence_dedup.LONG
    assert all(len(out[i][1].split()) >= 24 for i in (1, 3, 5, 7))


# --- suffix array


def suffix_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(dict(rows).items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_against_brute_force(spark, tmp_path, seed):
    rng = random.Random(seed)
    letters = "abcdefgh \u00e9\0"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 600))) for _ in range(20)]
    piece = lambda: rng.choice([rng.choice(base)[rng.randint(0, 50) : rng.randint(60, 600)], "".join(rng.choice(letters) for _ in range(80))])
    rows = [(i, "".join(piece() for _ in range(rng.randint(0, 5)))) for i in range(70)]
    rows += [(80, "a" * 1000), (81, "ab" * 300), (82, None), (83, "a" * 500 + "b" * 150), (84, rows[3][1]), (85, "q" * 99)]
    rows += [rows[3], rows[10]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op10_suffix_array_dedup(spark, saved(spark, tmp_path, rows)).collect()}
    assert got == suffix_brute(rows)


def test_suffix_hot_keys_by_window(spark):
    """A passage in most documents: its keys are hot, and windows at its edges differ from document to document."""
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("xyz \u00e9") for _ in range(rng.randint(0, 90))) + (passage if i % 4 else "") + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [rows[5], (100, passage * 2)]
    want = suffix_brute(rows)
    for least in (5, 40, 10**9):
        gone = {}
        for r in suffix_dedup.spans(table(spark, rows, parts=3), hot_least=least, hot_share=0).collect():
            n = next(len(t.encode()) for i, t in rows if i == r.k1)
            gone[r.k1] = sum(b - a for a, b in suffix_dedup._cut(b"x" * n, r.whole, r.windows, 100))
        assert gone == {i: w[1] for i, w in want.items() if w[1]}


def test_rolling_hash_and_triggers():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    power = int(suffix_dedup._POWER)
    want = [sum(int(data[i + k]) * pow(power, k, 2**64) for k in range(8)) % 2**64 for i in range(0, 2993, 7)]
    assert (suffix_dedup.mixed(np.array(want, np.uint64)) == suffix_dedup.rolled(data)[::7]).all()
    long = rng.integers(0, 9, suffix_dedup.STRETCH + 500).astype(np.uint8)
    assert (suffix_dedup.rolled(long)[-900:] == suffix_dedup.rolled(long[-907:])).all()


def test_suffix_array_of_the_dictionary():
    rng = np.random.default_rng(3)
    phrases = rng.integers(0, 2, (60, 12)).astype(np.uint8)
    least, most = rng.integers(0, 7, 60), rng.integers(5, 13, 60)
    phrase, length, place, begin = suffix_dedup.dictionary_order(phrases, least, most)
    said = [bytes(phrases[p][12 - n :]) for p, n in zip(phrase, length)]
    want = [bytes(phrases[p][12 - n :]) for p in range(60) for n in range(least[p], most[p] + 1)]
    pad = lambda x: x.ljust(12, b"\0") + bytes([len(x)])
    assert said == sorted(want, key=pad)
    rank = {x: i for i, x in enumerate(sorted(set(want), key=pad))}
    assert all(place[begin[p] + n] == rank[bytes(phrases[p][12 - n :])] for p in range(60) for n in range(least[p], most[p] + 1))


def test_suffix_array_of_the_parse():
    """Phrases give the bytes back, none is another one's prefix but at a row's end, and the order by ranks is the order by bytes."""
    rng = np.random.default_rng(4)
    base = rng.integers(97, 100, 400).astype(np.uint8)
    rows = np.stack([base[i : i + 49] for i in rng.integers(0, 350, 300)])
    rows[::5, 30:] = rng.integers(97, 100, (60, 19))
    ranks, phrases = suffix_dedup.parse_of(rows)
    text = {k + 1: bytes(p[: p[-1]]) for k, p in enumerate(phrases)}
    assert list(text.values()) == sorted(text.values()) and (ranks > 0).sum(axis=1).max() > 1
    for row, said in zip(rows, ranks):
        said = [text[x] for x in said if x]
        assert b"".join(x[: len(x) - suffix_dedup.GRAM] for x in said[:-1]) + said[-1] == bytes(row)
    key = rng.integers(0, 3, 300).astype(np.uint64)
    order, common = suffix_dedup.parse_order(key, rows)
    said = [(int(key[i]), bytes(rows[i])) for i in order]
    assert said == sorted(said)
    for (k, x), (q, y), n in zip(said, said[1:], common[1:]):
        assert n == (-1 if k != q else next((j for j in range(49) if x[j] != y[j]), 49))


def test_slices_of_keys_find_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    n = 400
    key, at = np.sort(rng.integers(0, 60, n)).astype(np.uint64), rng.permutation(n)
    ids = np.stack([rng.integers(0, 30, n), np.zeros(n, np.int64)], axis=1)
    low, high = rng.integers(0, 20, n), rng.integers(20, 49, n)
    fields = (low | high << 8 | 49 << 16).astype(np.uint32)
    left, right = (rng.integers(0, 2, (3, 49)).astype(np.uint8)[rng.integers(0, 3, n)] for _ in "ab")
    left[np.arange(49)[None, :] < (49 - high)[:, None]] = 0
    whole = {(int(w), int(o)) for x in suffix_dedup.repeated(key, ids, at, fields, left, right, 50) for w, o in zip(*x)}
    monkeypatch.setattr(suffix_dedup, "SLICE", 7)
    assert whole == {(int(w), int(o)) for x in suffix_dedup.repeated(key, ids, at, fields, left, right, 50) for w, o in zip(*x)}
    seen, want = set(), set()
    for i in sorted(range(n), key=lambda i: (ids[i, 0], at[i])):
        for o in range(low[i], high[i] + 1):
            window = (int(key[i]), o, bytes(left[i, 49 - o :]), bytes(right[i, : 49 - o]))
            if window in seen:
                want.add((i, o))
            seen.add(window)
    assert whole == want


def test_anchors_own_every_window_once():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 3, 700).astype(np.uint8), np.zeros(300, np.uint8), rng.integers(0, 255, 100).astype(np.uint8)):
        at, first, last = suffix_dedup.anchors(data)
        assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
        assert ((at - first < suffix_dedup.REACH) & (at >= last)).all()


# --- edge cases of all filters


FILTERS = {"exact": exact_dedup.dedup, "near": jaccard_join.dedup, "sentences": sentence_dedup.dedup, "suffix": suffix_dedup.dedup}


@pytest.mark.parametrize("name", FILTERS)
def test_clashing_columns_nulls_and_empty_tables(spark, name):
    rows = [(1, "some text that is long enough to be a document of its own"), (1, "other text"), (None, "no id"), (None, None), (4, None), (5, "some text that is long enough to be a document of its own")]
    docs = table(spark, rows, clashing=True)
    out = FILTERS[name](docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    kept = [tuple(r) for r in out.select("doc_id", "text").collect()]
    assert set(kept) <= set(rows) and (None, "no id") in kept and (1, "other text") in kept
    assert all(r[c] == 7 for r in out.collect() for c in CLASHING if c != "a.b")
    empty = FILTERS[name](docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


@pytest.mark.parametrize("name", ["exact", "near"])
def test_repeated_rows_leave_one(spark, name):
    text = "a text of some words that is there three times over"
    rows = [(3, text)] * 3 + [(9, "different words altogether, here and now, in this text")] * 2
    assert sorted(r.doc_id for r in FILTERS[name](table(spark, rows)).collect()) == [3, 9]
