"""Books and features: literal cases, and the batch plan against the event-by-event kernel."""

import random
from decimal import Decimal as Dec

import pytest
from events import event, frame, random_events, snapshot, trade, update

from lobweave.functions import features as f
from lobweave.operators import book, reports, sequence
from lobweave.plans import features
from lobweave.schemas import FEATURE_NAMES
from lobweave.streaming.state import Instrument

SEC = 10**9
W = 60 * SEC
SEED = snapshot(0, 0, 100, [(100, 5)], [(101, 5)])


def kernel(rows, width=W):
    state, out = {}, []
    for r in sorted(rows, key=lambda r: (r["session"], r["capture_seq"])):
        out.append((r, *state.setdefault(r["symbol"], Instrument(width)).observe(r)))
    return out


def results(rows):
    return [x for r, x, _ in kernel(rows) if r["type"] == "book_update"]


def batch_results(spark, rows):
    done = book.applied(sequence.ordered(frame(spark, rows))).where("type = 'book_update'").orderBy("ord")
    return [r.result for r in done.collect()]


CASES = {
    "unseeded": ([update(0, 1, 1, 5)], ["NOT_SYNCED"]),
    "spans": ([SEED, update(1, 1, 95, 105)], ["APPLIED"]),
    "gap": ([SEED, update(1, 1, 95, 105), update(2, 1, 107, 110)], ["APPLIED", "GAP"]),
    "joins": ([SEED, update(1, 1, 101, 105), update(2, 1, 106, 109)], ["APPLIED", "APPLIED"]),
    "duplicate": ([SEED, update(1, 1, 50, 60)], ["DUPLICATE"]),
    "after gap": ([SEED, update(1, 1, 107, 110), update(2, 1, 111, 112)], ["GAP", "NOT_SYNCED"]),
    "crossed": ([SEED, update(1, 1, 101, 101, [], [(99, 1)])], ["CROSSED"]),
    "unknown price": ([SEED, update(1, 1, 101, 101, [(50, 0)])], ["APPLIED"]),
    "crossed snapshot": ([snapshot(0, 0, 1, [(101, 1)], [(100, 1)]), update(1, 1, 2, 2)], ["NOT_SYNCED"]),
    "recovers": ([SEED, update(1, 1, 107, 110), snapshot(2, 2, 200, [(1, 1)], [(2, 1)]), update(3, 3, 201, 201)], ["GAP", "APPLIED"]),
}


@pytest.mark.parametrize("name", CASES)
def test_sequencing(spark, name):
    rows, want = CASES[name]
    assert results(rows) == want == batch_results(spark, rows)


def test_instant_features(spark):
    rows = [snapshot(0, 0, 1, [(100, 2), (99, 6), (98, 8)], [(101, 6), (102, 6), (103, 4)])]
    r = book.applied(sequence.ordered(frame(spark, rows))).select(*[b().cast("double").alias(n) for n, b in f.INSTANT.items()], *[f.imbalance("bids", "asks", n).alias(f"i{n}") for n in (1, 2, 3)], *[f.depth("bids", n).cast("int").alias(f"b{n}") for n in (1, 2, 3)]).first()
    assert (r.spread, r.midprice, r.microprice) == (1, 100.5, 100.25)
    assert (r.i1, r.i2, r.i3) == (-0.5, -0.2, 0) and (r.b1, r.b2, r.b3) == (2, 8, 16)
    assert r.microprice == pytest.approx(r.midprice + r.spread / 2 * r.imbalance_1)
    for bids, asks, want in (([(1, 1)], [], 1), ([], [(1, 1)], -1), ([], [], None)):
        r = book.applied(sequence.ordered(frame(spark, [snapshot(0, 0, 1, bids, asks)]))).select(f.imbalance("bids", "asks", 1).alias("i"), f.INSTANT["spread"]().alias("s"), f.depth("bids", 1).cast("int").alias("d")).first()
        assert r.i == want and r.s is None and r.d == len(bids)


def last_features(spark, rows):
    from pyspark.sql import functions as F

    got = features.feature_rows(frame(spark, rows), W).orderBy(F.desc("ord")).first().asDict()
    want = [x for *_, x in kernel(rows) if x][-1]
    for n in FEATURE_NAMES:
        assert (got[n] is None) == (want[n] is None), n
        assert got[n] is None or float(got[n]) == pytest.approx(float(want[n]), abs=1e-11), n
    return {n: None if got[n] is None else float(got[n]) for n in FEATURE_NAMES}


def test_windows(spark):
    nop = lambda k, ts, seq, **x: update(k, ts, seq, seq, [(50, 0)], **x)
    assert last_features(spark, [SEED, trade(1, 1, 100, 9), trade(2, 1, 200, 1), nop(3, 2, 101)])["vwap"] == 110
    assert last_features(spark, [SEED, trade(1, 1, 100, 3), trade(2, 1, 100, 1, "sell"), nop(3, 2, 101)])["trade_imbalance"] == 0.5
    got = last_features(spark, [SEED, nop(1, 1, 101)])
    assert got["vwap"] is None and got["order_flow_imbalance"] == 0 and got["realised_volatility"] is None
    for bids, asks, ofi in (([(100, 9)], [], 4), ([], [(101, 9)], -4), ([(100.5, 3)], [], 3)):
        assert last_features(spark, [SEED, update(1, 1, 101, 101, bids, asks)])["order_flow_imbalance"] == ofi
    two = snapshot(0, 0, 100, [(100, 5), (99, 2)], [(101, 5)])
    assert last_features(spark, [two, update(1, 1, 101, 101, [(100, 0)])])["order_flow_imbalance"] == -5
    late = [SEED, trade(1, 100 * SEC, 100, 1), trade(2, 99 * SEC, 200, 1), nop(3, 100 * SEC, 101)]
    assert last_features(spark, late)["vwap"] == 150
    assert last_features(spark, [*late, trade(4, 161 * SEC, 300, 1), nop(5, 161 * SEC, 102)])["vwap"] == 300


def test_resync_leaves_a_hole(spark):
    rows = [SEED, trade(1, SEC, 100, 1), update(2, SEC, 101, 101, [(100, 6)]), snapshot(3, 2 * SEC, 200, [(100, 5)], [(101, 5)]), update(4, 2 * SEC, 201, 201, [(99, 1)])]
    got = last_features(spark, rows)
    assert got["order_flow_imbalance"] is None and got["realised_volatility"] is None and got["vwap"] == 100
    assert last_features(spark, [*rows, update(5, 63 * SEC, 202, 202, [(100, 8)])])["order_flow_imbalance"] == 3


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_equals_kernel_on_random_events(spark, seed):
    rows, width = random_events(seed), 20 * SEC
    seen = kernel(rows, width)
    done = {(r.symbol, r.session, r.capture_seq): r for r in book.applied(sequence.ordered(frame(spark, rows))).collect()}
    for r, result, _ in seen:
        if r["type"] != "trade":
            assert done[r["symbol"], r["session"], r["capture_seq"]].result == result
    want = {(r["symbol"], r["session"], r["capture_seq"]): x for r, _, x in seen if x}
    got = {(r.symbol, r.session, r.capture_seq): r for r in features.feature_rows(frame(spark, rows), width).collect()}
    assert set(got) == set(want) and len(want) > 20
    for k, x in want.items():
        for n in FEATURE_NAMES:
            a, b = got[k][n], x[n]
            assert (a is None) == (b is None), (k, n, a, b)
            assert a is None or float(a) == pytest.approx(float(b), abs=1e-10), (k, n)
        assert got[k]["best_bid"] is None or got[k]["best_ask"] is None or got[k]["best_bid"] < got[k]["best_ask"]
    counts = {r.symbol: r for r in features.outcome_counts(frame(spark, rows)).collect()}
    for s in counts:
        assert counts[s].events == sum(r["symbol"] == s for r in rows)
        assert counts[s].rejected == sum(x in ("GAP", "DUPLICATE", "CROSSED", "NOT_SYNCED") for r, x, _ in seen if r["symbol"] == s)


def test_many_blocks_of_one_epoch(spark):
    rows = [SEED] + [update(k, k, 100 + k, 100 + k, [(100 - k % 7, 1 + k % 3)], [(101 + k % 5, k % 4)]) for k in range(1, 700)]
    got = {r.capture_seq: (r.bids, r.asks) for r in book.applied(sequence.ordered(frame(spark, rows))).where("result = 'APPLIED'").collect()}
    state = Instrument(W)
    for r in rows:
        state.observe(r)
        if r["type"] == "book_update":
            bids, asks = got[r["capture_seq"]]
            assert [(x.price, x.quantity) for x in bids] == state.bids.top(10, True) and [(x.price, x.quantity) for x in asks] == state.asks.top(10, False)


def test_duplicate_prices_in_snapshot_and_update(spark):
    rows = [snapshot(0, 0, 1, [(100, 1), (100, 0)], [(101, 1)]), update(1, 1, 2, 2, [], [(101, 3), (101, 0)])]
    r = book.applied(sequence.ordered(frame(spark, rows))).orderBy("ord").collect()
    assert [x.price for x in r[0].bids] == [Dec(100)] and [x.price for x in r[1].bids] == [Dec(100)] and r[1].asks == []


def test_sequence_reports(spark):
    rows = frame(spark, [update(0, 0, 1, 5), update(1, 1, 6, 9), update(2, 2, 12, 12), update(0, 3, 3, 20, session=2)])
    assert sorted((r.first_seq, r.gap) for r in sequence.sequence_gaps(rows).collect()) == [(3, -3), (6, -15), (12, 2)]
    assert [(r.first_seq, r.gap) for r in sequence.sequence_gaps(rows, per_session=True).collect()] == [(12, 2)]
    assert sequence.sequence_span(rows).first().span == 11
    joined = sequence.joined_to_snapshot(frame(spark, [snapshot(0, 0, 500, [], [])]), frame(spark, [update(1, 0, 400, 450), update(2, 0, 510, 520)]))
    assert [(r.first_seq, r.too_old) for r in joined.collect()] == [(510, True)]
    kept = sequence.joined_to_snapshot(frame(spark, [snapshot(0, 0, 500, [], [])]), frame(spark, [update(1, 0, 400, 499), update(2, 0, 495, 505)]))
    assert [(r.first_seq, r.too_old) for r in kept.collect()] == [(495, False)]
    gaps = sequence.contiguity(sequence.ordered(frame(spark, [snapshot(0, 0, 100, [], []), update(1, 0, 101, 110), update(2, 0, 111, 120), update(3, 0, 118, 135)]))).where("gap").collect()
    assert [r.message for r in gaps] == ["expected 121, got 118"]


def test_levels_and_percentiles(spark):
    rows = frame(spark, [snapshot(0, 0, 1, [(100, 1), (99, 0)], [(101, 2)]), update(1, 0, 2, 2, [(99, 0)], [(102, 1)])])
    long = [(r.capture_seq, r.side, float(r.price), float(r.quantity)) for r in reports.levels_long(rows, "capture_seq").collect()]
    assert long == [(0, "ask", 101, 2), (0, "bid", 100, 1), (0, "bid", 99, 0), (1, "ask", 102, 1), (1, "bid", 99, 0)]
    values = spark.createDataFrame([(float(x),) for x in range(1, 201)] + [(None,)], "v double")
    r = reports.percentiles(values, "v").first()
    assert (r["count"], r.p50, r.p95, r.p99, r.worst) == (200, 101, 191, 199, 200)
    assert [(r.column, r.nulls) for r in reports.null_counts(values).collect()] == [("v", 1)]


def test_latest_state(spark):
    state = lambda rows: features.latest_state(frame(spark, rows)).first()
    r = state([SEED, update(1, 1, 101, 101), update(2, 2, 50, 60)])
    assert (r.state, r.last_seq, r.has_features, r.snapshots) == ("SYNCED", 101, True, 1)
    assert not state([SEED, update(1, 1, 101, 101), snapshot(2, 2, 300, [], [])]).has_features
    r = state([SEED, update(1, 1, 101, 101), update(2, 2, 109, 110)])
    assert (r.state, r.has_features) == ("INVALID", False)
    assert state([event("trade", 0, 1, price=Dec(1), quantity=Dec(1), aggressor="buy", trade_id=5)]).state == "EMPTY"


def test_deep_books_and_long_epochs(spark):
    """Sides of 1,000 levels and epochs that span many batches: the best levels by a model that sorts all of them each time."""
    rng = random.Random(8)
    rows, books = [], ({}, {})
    deep = [(10_000 - k, 1 + k % 7) for k in range(1000)], [(10_001 + k, 1 + k % 5) for k in range(1000)]
    rows.append(snapshot(0, 0, 0, *deep))
    books = tuple(dict(side) for side in deep)
    want = {}
    for k in range(1, 400):
        bids, asks = ([(10_000 + sign * rng.randrange(1000) + (sign > 0), rng.choice([0, 0, 3, 9])) for _ in range(rng.randint(0, 30))] for sign in (-1, 1))
        for side, changes in zip(books, (bids, asks)):
            side.update(changes)
        rows.append(update(k, k, k, k, bids, asks))
        alive = [{p: q for p, q in side.items() if q} for side in books]
        want[k] = [(p, alive[0][p]) for p in sorted(alive[0], reverse=True)[:10]], [(p, alive[1][p]) for p in sorted(alive[1])[:10]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = book.applied(sequence.ordered(frame(spark, rows))).where("type = 'book_update'").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.ord - 1: tuple([(int(x.price), int(x.quantity)) for x in side] for side in (r.bids, r.asks)) for r in got} == want
