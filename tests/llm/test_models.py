"""Toxicity, URL filter, chat formatting, nearest neighbours."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
from docs import CLASHING, table, words

from lobweave.llm import chat, neighbours, toxicity, url_filter

# --- toxicity

BAD = ["vilewort", "grumble", "scorned", "wretchy"]


def labelled(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = words(rng, rng.randint(5, 150), 3000).split()
        toxic = i % 6 == 0
        for _ in range(rng.choice([2, 3, 6, 12]) if toxic else 0):
            t.insert(rng.randrange(len(t) + 1), rng.choice(BAD) + rng.choice(["", "en", "ish", "!", "er."]))
        rows.append((i, " ".join(t), int(toxic)))
    return rows


def test_toxicity_on_held_out_documents(spark):
    train, test = labelled(1, 900), labelled(2, 300)
    docs = table(spark, [r[:2] for r in train])
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in train] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.row.doc_id: r for r in toxicity.score(table(spark, [r[:2] for r in test], clashing=True), model).collect()}
    right = sum(got[i].toxic == bool(t) for i, _, t in test)
    assert right >= 0.97 * len(test)
    assert not [i for i, _, t in test if not t and got[i].toxic]
    worst = [got[i].severity for i, text, t in test if t and sum(text.count(b) for b in BAD) >= 10]
    mild = [got[i].severity for i, text, t in test if t and sum(text.count(b) for b in BAD) <= 3]
    assert np.mean(worst) > np.mean(mild) + 0.5
    assert all(0 <= r.severity <= toxicity.GRADES - 1 for r in got.values())


def test_toxicity_without_labels_or_rows(spark):
    docs = table(spark, [(1, "fine"), (None, None), (1, "fine")], clashing=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.filter_toxic(docs, labels)
    assert out.columns == docs.columns and out.count() == 3
    assert toxicity.filter_toxic(docs.limit(0), labels).count() == 0
    assert [r[c] for r in out.collect() for c in CLASHING if c != "a.b"] == [7] * 3 * (len(CLASHING) - 1)


def test_likelihood_and_gradient_by_definition():
    """The mean log likelihood row by row from the definition, and its gradient by differences."""
    rng = np.random.default_rng(0)
    every = [(np.sort(rng.choice(40, rng.integers(1, 9), replace=False)).astype(np.int32), rng.random(9).astype(np.float32)) for _ in range(60)]
    every = [(s, v[: len(s)]) for s, v in every]
    rows, y = toxicity._Rows(every), rng.integers(0, 4, 60)
    w, first, gaps = np.zeros(toxicity.SLOTS), -0.3, np.array([0.2, -0.4])
    w[:40] = rng.standard_normal(40)

    def direct(w, first, gaps):
        theta = [first, first + np.exp(gaps[0]), first + np.exp(gaps[0]) + np.exp(gaps[1])]
        total = 0.0
        for (slots, values), grade in zip(every, y):
            s = sum(float(w[k]) * float(v) for k, v in zip(slots, values))
            over = [1.0, *(1 / (1 + np.exp(t - s)) for t in theta), 0.0]
            total += np.log(over[grade] - over[grade + 1])
        return total / len(every)

    value, gw, g_first, g_gaps = toxicity.likelihood(rows, y, w, first, gaps)
    assert value == pytest.approx(direct(w, first, gaps))
    step, bump = 1e-5, lambda x, k: x + np.eye(1, len(x), k)[0] * 1e-5
    assert g_first == pytest.approx((direct(w, first + step, gaps) - direct(w, first - step, gaps)) / 2 / step, abs=1e-6)
    for k in (0, 1):
        assert g_gaps[k] == pytest.approx((direct(w, first, bump(gaps, k)) - value) / step, abs=1e-4)
    for k in range(0, 40, 7):
        assert gw[k] == pytest.approx((direct(bump(w, k), first, gaps) - value) / step, abs=1e-4)


def test_given_grades_are_predicted(spark):
    """A labels table with grades: severity follows them on documents that weren't fitted."""
    levels = [[], ["grumble"], ["scorned", "scornful"], ["vilewort", "wretchy"]]

    def rows(seed, n):
        rng = random.Random(seed)
        for i in range(n):
            grade = rng.choice([0, 0, 0, 1, 2, 3])
            t = words(rng, rng.randint(5, 80), 3000).split()
            for _ in range(rng.randint(2, 4) if grade else 0):
                t.insert(rng.randrange(len(t) + 1), rng.choice(levels[grade]))
            yield i, " ".join(t), grade

    train, test = list(rows(1, 1200)), list(rows(2, 300))
    labels = spark.createDataFrame([(i, g) for i, _, g in train] + [(1, None), (None, 2)], "doc_id long, grade int")
    model = toxicity.train(table(spark, [r[:2] for r in train]), labels)
    got = {r.row.doc_id: r for r in toxicity.score(table(spark, [r[:2] for r in test]), model).collect()}
    severity, grade = np.array([got[i].severity for i, _, _ in test]), np.array([g for *_, g in test])
    means = [severity[grade == g].mean() for g in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1.5
    assert (np.abs(severity - grade) < 1).mean() > 0.8


def test_toxicity_query_by_definition(spark, tmp_path):
    """The query's rows, computed anew from the model's weights over all features of every text."""
    data = labelled(5, 500) + [(900, None, 0), (901, "", 0), (902, "long vilewort words " * 20_000, 1)]
    table(spark, [r[:2] for r in data]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, _, t in data], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for i, text, _ in data:
        slots, values = toxicity.features(text or "")
        s = float((model.weights[slots] * values).sum())
        over = [1.0, *(1 / (1 + np.exp(t - s)) for t in model.thresholds), 0.0]
        assert got[i].severity == pytest.approx(sum(over[1:-1]), abs=1e-5)
        assert got[i].grade == int(np.argmax([a - b for a, b in zip(over, over[1:])]))
        assert got[i].toxic == (sum(over[1:-1]) >= model.cut)


def test_total_by_way_of_weighted_words():
    """The model's total is the same by way of all features and by way of those with a weight."""
    rows = labelled(3, 300)
    model = toxicity.fit([toxicity.features(t) for _, t, _ in rows], np.array([x for *_, x in rows]))
    for _, t, _ in rows[:40]:
        slots, values = toxicity.features(t)
        assert model.total(t) == pytest.approx(float((model.weights[slots] * values).sum()))
    assert model.severity(np.array([-50.0, 50.0])) == pytest.approx([0, toxicity.GRADES - 1], abs=1e-6)


# --- URLs


def ruled(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


URLS = [None, "", "nothing", "HTTP://A.Com?x", "x://WWW.EXAMPLE.COM/en/a#b", "://net/es/", "http://\u00e9.NET/fr/\n?", "a://b.example.com/en/x", "a://notexample.com/en/", "a://x.com", "a://com/", "a://y.net/de/?q=://z", "http://u.org/en/1"]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] + [(None, "http://x.net/fr/a", 2)], "page_id long, url string, score int")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = ruled(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert got[None].verdict == "block"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_tells_kinds_apart(spark):
    rng = random.Random(0)
    good = lambda: f"https://{rng.choice(['news', 'wiki', 'docs'])}.{rng.choice(['alpha', 'beta', 'gamma'])}.org/{rng.choice(['article', 'page', 'guide'])}/{rng.randrange(10**6)}"
    bad = lambda: f"http://{rng.choice(['casino', 'pills', 'bets'])}-{rng.choice(['win', 'cheap', 'free'])}{rng.randrange(99)}.biz/{rng.choice(['promo', 'click', 'offer'])}?aff={rng.randrange(10**6)}"
    rows = [(good(), True) for _ in range(400)] + [(bad(), False) for _ in range(400)] + [(None, None)]
    model = url_filter.train(spark.createDataFrame(rows, "url string, accepted boolean"))
    assert (model.scores([good() for _ in range(100)]) >= model.threshold).mean() > 0.98
    assert (model.scores([bad() for _ in range(100)]) < model.threshold).mean() > 0.98
    assert model.scores([""])[0] == 0


def test_url_likelihood_is_the_recursion():
    """The vectorised score equals the definition with exact counts, as long as no slots collide."""
    urls = ["abcab", "abd", "xbcab"]
    table_ = np.zeros(2 * url_filter.SLOTS)
    slots, n = url_filter.Grams(urls).counts()
    table_[slots.astype(np.int64)] = n
    grams, contexts = {}, {}
    for u in urls:
        t = "\2" + u
        for i in range(1, len(t)):
            for k in range(1, url_filter.ORDER + 1):
                if i - (k - 1) >= 0:
                    key = (k, t[i - k + 1 : i])
                    contexts[key] = contexts.get(key, 0) + 1
                    grams[key, t[i]] = grams.get((key, t[i]), 0) + 1

    def direct(u):
        t, total = "\2" + u, 0.0
        for i in range(1, len(t)):
            p = 1 / 256
            for k in range(1, url_filter.ORDER + 1):
                if i - (k - 1) >= 0:
                    key = (k, t[i - k + 1 : i])
                    p = (grams.get((key, t[i]), 0) + p) / (contexts.get(key, 0) + 1)
            total += np.log(p)
        return total

    for u in ("abcab", "zzz", "abx"):
        assert url_filter.Grams([u]).log_likelihood(table_)[0] == pytest.approx(direct(u))


def test_url_counts_are_exact_for_many_grams(spark):
    """No n-gram reads another one's count, however many there are."""
    rng = random.Random(5)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(30))
    urls = [(make("abcdefghijklmnopqrstuvwxyz0123456789"), True) for _ in range(1500)] + [(make("ghijklmnopqrstuvwxyz0123456789-_"), False) for _ in range(1500)]
    labelled_urls = spark.createDataFrame(urls, "url string, accepted boolean").repartition(3)
    model = url_filter.train(labelled_urls)
    kept = labelled_urls.where(f"pmod(xxhash64(url), {url_filter.FOLDS}) <> 0").collect()
    grams, contexts = {}, {}
    for u, accepted in kept:
        t = "\2" + u
        for i in range(1, len(t)):
            for k in range(1, url_filter.ORDER + 1):
                if i - (k - 1) >= 0:
                    key = (accepted, t[i - k + 1 : i], k)
                    contexts[key] = contexts.get(key, 0) + 1
                    grams[key, t[i]] = grams.get((key, t[i]), 0) + 1

    def direct(u):
        t, total = "\2" + u, 0.0
        for i in range(1, len(t)):
            p = {True: 1 / 256, False: 1 / 256}
            for k in range(1, url_filter.ORDER + 1):
                if i - (k - 1) >= 0:
                    for a in p:
                        key = (a, t[i - k + 1 : i], k)
                        p[a] = (grams.get((key, t[i]), 0) + p[a]) / (contexts.get(key, 0) + 1)
            total += np.log(max(p[True], 1e-12)) - np.log(max(p[False], 1e-12))
        return total / (len(t) - 1)

    asked = [u for u, _ in urls[::100]] + [make("abcxyz019-") for _ in range(30)]
    assert model.scores(asked) == pytest.approx([direct(u) for u in asked])
    got = {r.url: r.score for r in model.scored(url_filter.chunked(spark.createDataFrame([(u,) for u in asked], "url string"))).collect()}
    assert [got[u] for u in asked] == pytest.approx([direct(u) for u in asked])


# --- chat


def test_template_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "sys:tem", "#"]), "".join(rng.choice("\\#<>/turn: \nx</turn>### é") for _ in range(rng.randrange(30)))) for _ in range(rng.randrange(5))]
        text, mask = chat.formatted(turns)
        assert chat.parsed(text) == turns
        assert "".join(chat.unescaped(text[a:b]) for a, b in mask) == "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize("record,turns", [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 3}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c", "meta": {"x": [1]}}, [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "question": "q", "answer": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
    ({"data": {"messages": [{"role": "human", "content": "a"}, {"role": "bot", "content": "b"}]}}, [("user", "a"), ("assistant", "b")]),
    ({"prompt": {"text": "p"}, "response": {"text": "r", "score": 2}}, [("user", "p"), ("assistant", "r")]),
    ({"data": {"prompt": "p", "response": "r"}, "id": 1}, [("user", "p"), ("assistant", "r")]),
    ({"conversation": {"messages": [{"author": {"role": "gpt"}, "content": {"parts": ["a", "b"]}}]}}, [("assistant", "ab")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "c"}]}, [("user", "ab"), ("assistant", "c")]),
    ({"messages": []}, []),
    ({"turns": [{"role": "human", "text": "kept"}, {"role": None, "text": None}]}, [("human", "kept"), ("user", "")]),
])
def test_layouts(record, turns):
    assert chat.Layouts().turns(record) == turns


def test_fingerprints_follow_paths_not_values():
    a = chat.fingerprint(chat.field_paths({"m": [{"x": 1}, {"x": 2}], "n": None}))
    assert a != chat.fingerprint(chat.field_paths({"n": "t", "m": [{"x": []}]}))
    assert a == chat.fingerprint(chat.field_paths({"n": 5, "m": [{"x": "z"}]}))
    assert a != chat.fingerprint(chat.field_paths({"m": [{"y": 1}]}))


def test_broken_records_carry_errors(spark):
    rows = [(1, json.dumps({"prompt": "p", "response": "r"})), (2, "{"), (3, None), (4, '{"odd": 1}'), (5, "[]"), (6, '{"messages": null}')]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "c long, j string"), "c", "j").collect()}
    assert got[1].error is None and chat.parsed(got[1].formatted) == [("user", "p"), ("assistant", "r")]
    assert all(got[i].error and got[i].formatted is None for i in (2, 3, 4, 5, 6))


def test_layouts_meet_in_one_table(spark):
    """Each row's layout is chosen by its own fingerprint; contents that aren't text are an error, and read back as nulls."""
    rng = random.Random(2)
    say = lambda: "".join(rng.choice("ab #<\\:\n</turn>") for _ in range(rng.randrange(20)))
    make = [
        lambda u, a: {"messages": [{"role": "user", "content": u}, {"role": "assistant", "content": a}]},
        lambda u, a: {"data": {"messages": [{"role": "user", "content": [{"type": "text", "text": u}]}, {"role": "assistant", "content": a}]}},
        lambda u, a: {"conversations": [{"from": "human", "value": u}, {"from": "gpt", "value": a}], "source": {"url": "x"}},
        lambda u, a: {"prompt": u, "completion": a},
        lambda u, a: {"instruction": u, "input": "", "output": a, "meta": [1, 2]},
        lambda u, a: {"question": u, "answer": a},
    ]
    said = {i: (say(), say()) for i in range(60)}
    rows = [(i, json.dumps(make[i % len(make)](u, a))) for i, (u, a) in said.items()]
    rows += [(100, json.dumps({"messages": [{"role": "user", "content": [{"type": "image", "url": "x"}]}]}))]
    done = chat.format_records(spark.createDataFrame(rows, "id long, json string").repartition(3), "id", "json")
    got = {r.id: r for r in done.collect()}
    assert len({got[i].layout for i in said}) == len(make)
    assert all(chat.parsed(got[i].formatted) == [("user", u), ("assistant", a)] for i, (u, a) in said.items())
    assert got[100].formatted is None and "without text" in got[100].error
    back = {r.conv_id: r for r in chat.read_back(done).collect()}
    assert back[100].n_turns is None and back[3].n_turns == 2
    clashing = spark.createDataFrame(rows[:3], "id long, json string").selectExpr("id", "json", "1 layout", "2 formatted", "3 error")
    assert chat.format_records(clashing, "id", "json").count() == 3 and chat.format_records(clashing.limit(0), "id", "json").count() == 0


def test_a_very_long_turn_reads_back():
    import tracemalloc

    turns = [("user", "\\#<a" * 1_000_000), ("assistant", "b</turn>\n" * 500_000)]
    text, _ = chat.formatted(turns)
    tracemalloc.start()
    assert chat.parsed(text) == turns
    assert tracemalloc.get_traced_memory()[1] < 12 * len(text)
    tracemalloc.stop()
    for broken in ("### user: a", "### user: a</turn>", "### user: a#</turn>\n", "x", "### us:er a</turn>\n"):
        with pytest.raises(ValueError):
            chat.parsed(broken)


def test_conversations_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, None, None, "late"), (2, 0, "user", "x"), (2, 0, "assistant", "tie"), (2, 0, "user", "x"), (None, 0, "user", "n")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op2_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\nyes\n") and got[1].loss_chars == 3
    assert got[2].turns_sha256 == sha("assistant\ntie\nuser\nx\nuser\nx\nuser\nlate\n")
    probe = chat.PROBE
    assert got[-7].n_turns == 2 and got[-7].loss_sha256 == sha(probe) and got[-7].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n")
    assert got[None].n_turns == 1


# --- neighbours


def clustered(seed, n, d=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, d))
    return centres[rng.integers(0, 30, n)] + 0.6 * rng.standard_normal((n, d))


def test_recall_and_exact_scores(spark):
    x = clustered(1, 3000)
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    rows += [(5000 + i, rows[20][1], 1) for i in range(40)]  # one very common vector
    rows += [(7000, None, 1), (7001, [0.0] * 24, 1), (7002, [float("nan")] * 24, 1), (7003, [None] * 24, 1), (7004, [1.0], 1), (None, rows[1][1], 1), rows[40]]
    table_ = neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int"), "vec_id", "embedding")
    index, router = neighbours.build_index(table_, parts=16)
    queries = index.where("vec_id % 20 = 0")
    got = {}
    for r in neighbours.search(index, router, queries, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = {r[0]: np.array(r[1]) for r in rows if r[0] is not None and r[0] < 7000}
    ids = np.array(sorted(fine))
    m = np.stack([fine[i] for i in ids])
    hit = total = 0
    assert len(got) == sum(1 for i in ids if i % 20 == 0)
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(float((fine[v] * fine[q]).sum()), abs=1e-12) for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found) and q not in [v for _, v, _ in found]
        score = (m * fine[q]).sum(axis=1)
        score[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hit += len(set(best.tolist()) & {v for _, v, _ in found})
        total += 20
    assert hit >= 0.9 * total


def test_parts_grow_with_the_table():
    """As the square root of the rows, and what is scanned falls with them at a recall above 0.9."""
    assert [neighbours.parts_for(n) for n in (0, 1, 500, 10_000, 51_000)] == [1, 1, 16, 128, 256]
    shares = []
    for n in (500, 2000, 8000):
        x = clustered(7, n)
        router = neighbours.fit(x, neighbours.parts_for(n))
        home, probed = router.likeliest(x, 1)[:, 0], router.likeliest(x[::20], router.probes)
        score = x[::20] @ x.T
        score[np.arange(len(probed)), np.arange(0, n, 20)] = -np.inf
        best = np.argsort(-score, axis=1)[:, :20]
        assert (home[best][:, :, None] == probed[:, None, :]).any(axis=2).mean() >= 0.9
        shares.append(np.bincount(home, minlength=neighbours.parts_for(n))[probed].sum(axis=1).mean() / n)
    assert shares[0] > shares[1] > shares[2]


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few = neighbours.valid(spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 2.0])], schema), "vec_id", "embedding")
    index, router = neighbours.build_index(few)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(index, router, index.where("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 21, 0.0), (20, 1, 21, 1.0), (20, 2, 0, 0.5)]
    none = neighbours.valid(spark.createDataFrame([(1, None)], schema), "vec_id", "embedding")
    index, router = neighbours.build_index(none)
    assert neighbours.search(index, router, index, 5).count() == 0


def test_small_parts_still_give_k(spark):
    """A query whose probed parts hold too few candidates goes on to other parts."""
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(clustered(3, 600))] + [(5, [1.0] * 24)]
    table_ = neighbours.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    index, router = neighbours.build_index(table_, parts=16)
    router.probes = 1
    for k in (150, 700):
        found = neighbours.search(index, router, index.where("vec_id % 60 = 0"), k).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in found} == {i: min(k, 599) for i in range(0, 600, 60)}


def test_parts_are_balanced():
    x = neighbours.unit(clustered(2, 1000))
    parts = neighbours.balanced_parts(neighbours.nearest(x, x, 10), 8)
    assert np.bincount(parts).min() >= 124 and np.bincount(parts).max() <= 126
