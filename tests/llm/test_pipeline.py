"""The pipeline, stage by stage and whole, against brute force."""

import collections
import random
import struct

import public_tokenizers as P
import pytest
from docs import corpus, table, words
from test_dedup import near_components
from tokenizers import Tokenizer

import corpus_pipeline
from lobweave.llm import toxicity

BAD = ["vilewort", "grumble", "scorned"]


def fixture(spark, path):
    rng = random.Random(8)
    rows = [(i, t) for i, t in dict(corpus(seed=11, groups=30)).items() if i is not None]
    start = 1000
    for k in range(240):
        t = words(rng, rng.randint(10, 60), 5000).split()
        for _ in range(4 if k % 6 == 0 else 0):
            t.insert(rng.randrange(len(t)), rng.choice(BAD))
        rows.append((start + k, " ".join(t)))
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(start + k, 1, int(k % 6 == 0)) for k in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def low(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def cut(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
        if not any(gone):
            out.append((i, t))
        elif kept:
            out.append((i, kept))
    return out


def brute(spark, rows, path):
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    stages = []
    rows = [(i, t) for i, t in rows if model.severity(model.total(t or "")) < model.cut]
    stages.append(rows)
    last = {}
    for i, t in rows:
        last[low(t)] = max(i, last.get(low(t), i))
    rows = [(i, t) for i, t in rows if last[low(t)] == i]
    stages.append(rows)
    head = {i: c for i, _, c in near_components(rows, 5, 80, 100)}
    rows = [(i, t) for i, t in rows if head[i] == i]
    stages.append(rows)
    rows = cut(rows)
    stages.append(rows)
    return stages


def test_whole_pipeline(spark, tmp_path):
    rows = fixture(spark, tmp_path)
    want = brute(spark, rows, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        path = f"{tmp_path}/{name}"
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(expected, key=lambda r: (r[0], r[1] or "")), name
    toxic = [i for i, t in rows if i >= 1000 and any(b in t for b in BAD)]
    left = {i for i, _ in want[0]}
    assert not left & set(toxic) and len(want[0]) == len(rows) - len(toxic)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append(r)
    assert set(got) == {i for i, _ in want[-1]}
    for i, t in want[-1]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        assert b"".join(bytes(r.ids) for r in sorted(got[i], key=lambda r: r.start)) == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_awkward_tables(spark, tmp_path, k):
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    docs = table(spark, [(1, "x"), (None, None), (2, ""), (None, "y z"), (2, "")], clashing=True)
    out = stage(spark, docs, str(tmp_path))
    assert out.count() >= 3 and (name == "packing" or out.columns == docs.columns)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
