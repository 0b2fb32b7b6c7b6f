"""Packing and byte-level BPE against the public libraries."""

import base64
import collections
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from docs import corpus, saved, table
from tokenizers import Tokenizer

from lobweave.llm import bpe, packing

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(4)
    pick = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1000), rng.randrange(0x4E00, 0x4F00), 10, 32]))
    return ["", "a" * 3000, " " * 300 + "x", "\u6f22\u5b57" * 300, "<|endoftext|> it's", "a\0b", "x" * 33] + ["".join(pick() for _ in range(rng.randrange(120))) for _ in range(300)]


def test_bpe_is_the_library(library):
    codec = bpe.Bpe(RANKS)
    for text, ids in zip(texts(), codec.encode(texts())):
        assert ids.tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()
        assert codec.merge(text.encode()[:200] or b"a")  # a lone pretoken of any bytes


def test_long_and_short_merges_agree(library):
    codec = bpe.Bpe(RANKS)
    for word in ("internationalization", "zzzzzzzzzzzzzzzz", "qjxkvbwq"):
        assert codec.merge(word.encode()) == list(next(codec._together([word.encode()], 32)))


def test_round_trip_query(spark, tmp_path, library):
    import hashlib

    rows = corpus()
    got = sorted(tuple(r) for r in bpe.op5_byte_bpe(spark, saved(spark, tmp_path, rows)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(ids := library.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows)
    assert got == want


def test_encode_and_decode_tables(spark):
    docs = table(spark, [(1, "hello world"), (None, None), (2, "")], clashing=True)
    rows = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()}
    assert bytes(rows[1].data) == b"hello world" and rows[None].ids == [] and bytes(rows[2].data) == b""
    assert bpe.encode(docs.limit(0), RANKS).count() == 0


def test_fast_ids_are_the_tokenizers():
    ids, tokenizer = packing.TokenIds(JSON), Tokenizer.from_file(JSON)
    assert ids.fast is not None
    for t in texts():
        assert ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check_pieces(rows, docs):
    tokenizer = Tokenizer.from_file(JSON)
    want = collections.Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in docs)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at and len(r.ids) == 4 * r.length > 0
            at += r.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return want, padding


def test_packing_holds_every_id_once(spark):
    docs = [(i, t) for i, (_, t) in enumerate(corpus(groups=40))] + [(1000, "long words " * 3000), (1001, None)]
    rows = packing.pack(table(spark, docs, clashing=True), JSON).collect()
    _, padding = check_pieces(rows, docs)
    assert padding == 0
    tokenizer = Tokenizer.from_file(JSON)
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, t in docs:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(bytes(r.ids) for r in pieces) == struct.pack(f"<{len(ids)}I", *ids)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1]) and pieces[0].doc_tokens == len(ids)


def test_packing_query_and_empty(spark, tmp_path):
    rows = [(1, "abc " * 3000), (2, None)]
    got = packing.op3_sum_of_squares_packing(spark, saved(spark, tmp_path, rows)).collect()
    ids = Tokenizer.from_file(JSON).encode(rows[0][1], add_special_tokens=False).ids + [1]
    for r in got:
        part = (ids if r.doc_id == 1 else [1])[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
    assert packing.pack(table(spark, [(1, "x")]).limit(0), JSON).count() == 0


def squares(level, top):
    return sum(n * n for n in level[1:top])


def placements(level, top, size, cut=0):
    """Sums of squares of all ways to place size units: whole, or a part that completes a window and the rest whole."""
    for at in range(top - size + 1):
        if not at or level[at]:
            after = list(level)
            after[at] -= bool(at)
            after[at + size] += 1
            yield squares(after, top) + cut
    for at in range(1, top):
        if not cut and level[at] and top - at < size:
            after = list(level)
            after[at] -= 1
            yield from placements(after, top, size - (top - at), packing.CUT)


def test_sum_of_squares_rule():
    """Each placement is a best one by the definition, computed anew; of equal sizes windows don't pile up."""
    for sizes in (lambda r: r.randrange(1, 16), lambda r: 9, lambda r: r.choice([7, 11, 11, 11])):
        rng = random.Random(0)
        packer = packing.SumOfSquares(16, unit=1)
        for _ in range(600):
            size, before = sizes(rng), squares(packer.level, 16)
            least = min(placements(packer.level, 16, size))
            change, at = packer.best(size)
            assert before + change == least
            assert all(sum(len(i) for _, _, i in sequence) == 16 for sequence in packer.place("d", np.arange(size, dtype=np.uint32)))
            assert squares(packer.level, 16) == least - packing.CUT * (at + size > 16)
            assert packer.open <= 16 * packing.CUT


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_the_rule_packs_the_remainders(parts):
    """Of the tokens beyond whole windows nearly all lie in windows that the rule filled up, and the rest where it put them."""
    rng = random.Random(parts)
    lengths = [int(rng.lognormvariate(6.2, 1)) + 1 for _ in range(9600)]
    remainders = closed = 0
    for k in range(parts):
        packer, windows = packing.SumOfSquares(2048), []
        for i, n in enumerate(lengths[k::parts]):
            windows += list(packer.place(i, np.zeros(n, np.uint32)))
            remainders += n % 2048
        assert all(sum(len(x) for _, _, x in w) == 2048 for w in windows)
        held = {(t, s + j) for level in packer.windows for w in level for t, s, x in w for j in range(len(x))}
        ends = list(packer.close())
        closed += sum(len(x) for w in ends for _, _, x in w)
        assert {(t, s + j) for w in ends for t, s, x in w for j in range(len(x))} >= held
        assert all((n := sum(len(x) for _, _, x in w)) & (n - 1) == 0 for w in ends)
    assert closed <= 0.1 * remainders


def test_texts_beyond_the_engine():
    ids = packing.TokenIds(JSON)
    for text in ("a" + " " * 1_000_000 + "b", "\n" * 2_000_000):
        assert ids(text).tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
