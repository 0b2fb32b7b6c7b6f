"""Frames, captures, replay, research reads, logs, streaming, the service and the driver's queries."""

import json
import os
import shutil
import threading
import urllib.error
import urllib.request
from types import SimpleNamespace

import pytest
from events import NAMES, frame, random_events, snapshot, trade, update
from pyspark.sql import functions as F

from lobweave import api
from lobweave.fixtures import fx_book
from lobweave.operators import reports, research, sequence
from lobweave.plans import features, oracle, queries, replay
from lobweave.schemas import FEATURES, struct
from lobweave.sources import capture, frames, logs
from lobweave.streaming import market

T0 = 1_788_307_200_000_000_000  # 2026-09-02T00:00:00Z
SF = "/root/testdata/sf0.001"


def raw(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), 7) for r in rows], "raw string, received_ns long")


DEPTH = {"e": "depthUpdate", "E": 1788376136014, "s": "BTCUSDT", "U": 5, "u": 9, "b": [["100.10", "0.00"], ["99", "2"]], "a": []}
TRADE = {"e": "trade", "E": 1788376136014, "T": 1788376136011, "s": "BTCUSDT", "t": 77, "p": "100.5", "q": "0.25", "m": True}


def test_depth_and_trade_frames(spark):
    r = frames.parse_depth(raw(spark, DEPTH)).first()
    assert (r.timestamp_ns, r.received_ns, r.first_seq, r.last_seq, r.symbol) == (1788376136014000000, 7, 5, 9, "BTCUSDT")
    assert [(float(x.price), float(x.quantity)) for x in r.bids] == [(100.1, 0), (99, 2)] and r.asks == [] and r.error is None
    sold, bought = frames.parse_trades(raw(spark, TRADE, TRADE | {"m": False})).collect()
    assert (sold.timestamp_ns, sold.trade_id, float(sold.price), sold.aggressor, bought.aggressor) == (1788376136011000000, 77, 100.5, "sell", "buy")


def test_envelopes_and_errors(spark):
    wrap = lambda d: {"stream": "x", "data": d}
    rows = frames.parse_stream(raw(spark, wrap(DEPTH), wrap(TRADE), TRADE, wrap({"e": "kline"}), "{broken")).collect()
    assert [r.type for r in rows] == ["book_update", "trade", None, None, None] and all(r.error for r in rows[2:])
    assert frames.parse_depth(raw(spark, TRADE)).first().error and frames.parse_trades(raw(spark, DEPTH)).first().error
    with pytest.raises(Exception, match="unknown event"):
        frames.parse_stream(raw(spark, wrap({"e": "kline"})), strict=True).collect()
    body = spark.createDataFrame([(json.dumps({"lastUpdateId": 5, "bids": [["1", "2"]], "asks": []}), "btcusdt", 9), (json.dumps({"code": -1121, "msg": "Invalid symbol."}), "x", 9)], "raw string, symbol string, received_ns long")
    good, bad = frames.parse_snapshots(body).collect()
    assert (good.symbol, good.last_seq, good.timestamp_ns, len(good.bids)) == ("BTCUSDT", 5, 9, 1) and bad.error == "Invalid symbol."


def test_frames_round_trip(spark):
    rows = frame(spark, [r | {"timestamp_ns": r["timestamp_ns"] // 10**6 * 10**6} for r in random_events(5, 2)]).where("type <> 'snapshot'")
    back = frames.parse_stream(frames.to_frames(rows).select("raw", "received_ns", "session", "capture_seq"))
    keep = ["type", "symbol", "session", "capture_seq", "timestamp_ns", "received_ns", "first_seq", "last_seq", "bids", "asks", "trade_id", "price", "quantity", "aggressor"]
    assert back.where("error IS NOT NULL").count() == 0
    key = lambda r: (r.symbol, r.capture_seq)
    assert sorted(back.select(keep).collect(), key=key) == sorted(rows.select(keep).collect(), key=key)


def test_frames_keep_every_millisecond(spark):
    """Nanoseconds have more digits than a double: these milliseconds came out as the ones before."""
    clocks = [1704154120618000000, 1704546846418000000, 1705931300226000000, 1705931300226999999]
    rows = frame(spark, [r | {"timestamp_ns": t} for r, t in zip((r for r in random_events(5, 2) if r["type"] != "snapshot"), clocks)])
    raw_ = frames.to_frames(rows).select("raw", "received_ns")
    assert sorted(r.timestamp_ns for r in frames.parse_stream(raw_).collect()) == [t // 10**6 * 10**6 for t in clocks]


def day_rows():
    rows = [r | {"timestamp_ns": T0 + r["timestamp_ns"], "received_ns": T0 + r["received_ns"]} for r in random_events(9, 1, 60)]
    return [r | {"symbol": "BTCUSDT"} for r in rows]


def test_capture_round_trip_order_and_pages(spark, tmp_path):
    rows, root = day_rows(), str(tmp_path)
    capture.record(capture.checked(frame(spark, rows), symbol="BTCUSDT"), root, roll_rows=7)
    back = capture.read_partition(spark, root, "binance", "btcusdt", "2026-09-02")
    assert [(r.session, r.capture_seq) for r in back.collect()] == sorted((r["session"], r["capture_seq"]) for r in rows)
    want = {(r["session"], r["capture_seq"]): r for r in rows}
    for r in back.select(NAMES).collect():
        w = want[r.session, r.capture_seq]
        assert (r.price, r.last_seq, r.aggressor) == (w["price"], w["last_seq"], w["aggressor"])
        assert w["bids"] is None and not r.bids or [tuple(x) for x in r.bids or []] == [tuple(x.values()) for x in w["bids"] or []]
    with pytest.raises(capture.CaptureNotFound):
        capture.read_partition(spark, root, "binance", "ETHUSDT", "2026-09-02")
    with pytest.raises(capture.CaptureNotFound):
        capture.read_events(spark, root + "/none")
    reader = api.Research(spark, root)
    seen, cursor = [], None
    while True:
        page = reader.events("BTCUSDT", "2026-09-02", cursor, limit=7)
        seen += page["events"]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert len(seen) == len(rows) and "capture_seq" not in seen[0]
    assert reader.events("BTCUSDT", "2026-09-02", byte_budget=1)["count"] == 1
    assert reader.events("BTCUSDT", "2026-09-02", session=1, start_seq=5, end_seq=9)["count"] == 5
    assert reader.events("BTCUSDT", "2026-09-02", session=99)["count"] == 0
    sessions = reader.sessions("BTCUSDT")
    assert all(s["bytes"] > 0 and s["events"] == sum(x["rows"] for x in sessions if x["session"] == s["session"]) for s in sessions)
    plan = research.catalogue_of(spark, root, "binance", "BTCUSDT", "2026-09-02")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*), MIN(capture_seq)") == 3
    want = {(r["date"], r["session"], r["stream"]): r for r in (x.asDict() for x in research.catalogue(capture.read_events(spark, root)).collect())}
    assert all(want[s["date"], s["session"], s["stream"]] == {k: v for k, v in s.items() if k != "bytes"} for s in sessions) and len(want) == len(sessions)
    assert sum(s["rows"] for s in sessions) == len(rows) and {s["session"] for s in sessions} == {1, 2} and reader.sessions("NONE") == []
    for call, status in ((lambda: reader.events("BTCUSDT", "2026-09-02", "x"), 400), (lambda: reader.events("BTCUSDT", "2026-09-02", limit=0), 422), (lambda: reader.events("BTCUSDT", "2020-01-01"), 404), (lambda: reader.export("BTCUSDT", "2026-09-02", "features", "x"), 400)):
        with pytest.raises(api.ApiError) as e:
            call()
        assert e.value.status == status
    reader.export("BTCUSDT", "2026-09-02", "trades", f"{root}/out")
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == sum(r["type"] == "trade" for r in rows) and "session" in out.columns
    got = replay.replay_features(spark, root, "binance", "BTCUSDT", ["2026-09-02"])
    assert got.count() == features.feature_rows(frame(spark, rows)).count()
    capture.write_features(features.stored_features(got), root, 5)
    assert [f.name for f in struct(FEATURES)] == capture.read_features(spark, root).columns[:-2]
    assert capture.sizes(spark, root).agg(F.sum("bytes")).first()[0] > 0


def test_foreign_events_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="foreign or unknown"):
        capture.checked(frame(spark, [trade(0, T0, 1, 1, symbol="X")]), symbol="BTCUSDT").collect()
    with pytest.raises(Exception, match="foreign or unknown"):
        capture.checked(frame(spark, [trade(0, T0, 1, 1) | {"type": "odd"}])).collect()
    rows = capture.with_capture_seq(frame(spark, day_rows()).drop("capture_seq"), ("symbol",), ("received_ns", "last_seq"), spark.createDataFrame([("BTCUSDT", 99)], "symbol string, last_capture_seq long"))
    assert sorted(r.capture_seq for r in rows.collect()) == list(range(100, 100 + len(day_rows())))
    with pytest.raises(Exception, match="foreign or unknown"):
        capture.write_events(frame(spark, [trade(0, T0, 1, 1), trade(1, T0, 1, 1) | {"type": "odd"}]), str(tmp_path))
    rolled = capture.rolled(frame(spark, [trade(k, T0, 1, 1, session=5) for k in range(7)]), 3).orderBy("capture_seq").collect()
    assert [(r.session, r.capture_seq) for r in rolled] == [(5, 0), (5, 1), (5, 2), (6, 3), (6, 4), (6, 5), (7, 6)]
    with pytest.raises(Exception, match="more than 8 decimal places"):
        features.feature_rows(frame(spark, [snapshot(0, T0, 1, [("1.123456789", 1)], [(2, 1)])])).collect()


def test_flat_layout_and_broken_files(spark, tmp_path):
    from lobweave.schemas import STREAMS

    names = [f.name for f in struct(STREAMS["trades"])]
    rows = frame(spark, [trade(k, T0, 100, 1) for k in range(3)]).select(names)
    rows.coalesce(1).toPandas()
    (tmp_path / "day").mkdir()
    for session in (1, 2):
        rows.coalesce(1).write.parquet(f"{tmp_path}/w{session}")
        part = next((tmp_path / f"w{session}").glob("part-*.parquet"))
        part.rename(tmp_path / "day" / f"trades-{session}.parquet")
    (tmp_path / "day" / "trades-3.parquet").write_bytes(b"no footer")
    assert sorted((r.stream, r.session) for r in capture.flat_files(spark, f"{tmp_path}/day").collect()) == [("trades", 1), ("trades", 2), ("trades", 3)]
    assert capture.tolerant_read(spark, f"{tmp_path}/day").count() == 6
    (tmp_path / "day" / "trades-3.parquet").unlink()
    assert sorted(r.session for r in capture.read_flat(spark, f"{tmp_path}/day").collect()) == [1, 1, 1, 2, 2, 2]


def test_replay_is_the_same_each_time_and_paced(spark):
    rows = frame(spark, day_rows())
    waits = []
    plain = list(replay.replay(rows))
    assert plain == list(replay.replay(rows, 10, waits.append)) and all(w >= 0 for w in waits) and sum(waits) > 0
    paced = replay.paced(frame(spark, [trade(0, 0, 1, 1), trade(1, 2 * 10**9, 1, 1), trade(2, 10**9, 1, 1), trade(3, 3 * 10**9, 1, 1)]), 2.0).orderBy("capture_seq")
    assert [r.emit_offset_s for r in paced.collect()] == [0, 1, 1, 2]


def test_cursor_and_page_rules():
    assert research.Cursor.parse("5:-1") == research.Cursor(5, -1) and str(research.Cursor(3, 4)) == "3:4"
    for bad in ("", "5", "a:b", "1:2:3"):
        with pytest.raises(research.BadRequest):
            research.Cursor.parse(bad)


def test_filters_reach_the_scan(spark, tmp_path):
    capture.write_events(frame(spark, day_rows()), str(tmp_path))
    rows = research.in_range(capture.read_events(spark, str(tmp_path), "binance", "BTCUSDT", ["2026-09-02"]), session=1, start_seq=5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(capture_seq), GreaterThanOrEqual(capture_seq,5)]" in plan and "session" in plan.split("PartitionFilters")[1].split("]")[0]


def test_logs(spark, tmp_path):
    (tmp_path / "run.log").write_text(
        "2026-09-08 00:00:00  start BTCUSDT\n"
        "2026-09-08 00:05:00  mid 100.00  L1 +0.1  ofi 1  rv 2bp  |  1,200 events  1,000 trades  1 snapshot(s)  0 rejected\n"
        "2026-09-08 00:06:00  snapshot seq=5 1x1 levels -> SEEDED RESYNC\n2026-09-08 00:06:01  !! GAP at seq 5-6\nValueError: x\n"
        "2026-09-08 00:10:00  mid 102.00  L1 +0.1  ofi 1  rv 2bp  |  2,400 events  2,000 trades  2 snapshot(s)  1 rejected\n"
    )
    r = logs.log_summary(logs.read_log(spark, f"{tmp_path}/run.log")).first()
    assert (r.lines, r.resyncs, r.rejected_lines, r.errors, r.heartbeats, r.events, r.trades, r.span_pct) == (6, 1, 1, 1, 2, 2400, 2000, 2.0)
    beats = spark.createDataFrame([(T0 + k * 10**10, 100.0 + k, 10 * k, k, 1, 0) for k in range(7)] + [(T0, None, 1, 1, 1, 1)], "timestamp_ns long, midprice double, events long, trades long, snapshots int, rejected int")
    assert logs.heartbeats(logs.heartbeat_lines(beats)).count() == 7
    assert [r.events for r in logs.heartbeats(logs.heartbeat_lines(beats.where("midprice > 0"), 30)).orderBy("at").collect()] == [0, 30, 60]
    reports.write_csv(frame(spark, day_rows()).where("type = 'trade'").select("symbol", "price"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() > 0
    books = frame(spark, [snapshot(0, T0, 1, [(100, 1), (99, 0)], [("101.000000000000000001", 2)]), update(1, T0, 2, 2, [(99, 0)])])
    reports.write_csv(books, f"{tmp_path}/books")
    back = spark.read.option("header", True).csv(f"{tmp_path}/books").orderBy("capture_seq", "side", F.desc("price")).collect()
    assert [(r.side, r.price[:24], float(r.quantity)) for r in back] == [("ask", "101.000000000000000001", 2), ("bid", "99.000000000000000000", 0), ("bid", "100.000000000000000000", 1), ("bid", "99.000000000000000000", 0)]
    said = []
    beat = logs.Heartbeat(10, said.append, iter((0.0, 5.0, 11.0)).__next__)
    for k in range(3):
        beat.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=600, timestamp=f"t{k}", processedRowsPerSecond=9.0, batchId=k)))
    assert said == ["t0  600 events  9 a second  batch 0", "t2  1,800 events  9 a second  batch 2"]


def wire(name, data):
    return json.dumps({"stream": f"btcusdt@{name}", "data": data})


def depth(first, last, bids=(), asks=()):
    return wire("depth", {"e": "depthUpdate", "E": 1788376136014 + last, "s": "BTCUSDT", "U": first, "u": last, "b": list(bids), "a": list(asks)})


def match(k):
    return wire("trade", TRADE | {"t": k, "T": 1788376136011 + k})


def put(folder, name, lines, at):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    os.utime(folder / name, (at, at))


def test_capture_to_features_in_two_runs_with_a_retry(spark, tmp_path):
    """Frames with a buffered start, a gap and a new snapshot: numbered by arrival, written once, seeded like a feed, then features."""
    body = lambda last, low: {"lastUpdateId": last, "bids": [[str(low), "5"]], "asks": [[str(low + 1), "4"]]}
    first = [match(1), depth(1, 5), depth(6, 10, [["100", "7"]]), "{broken", wire("snapshot", body(7, 100)), match(2), depth(11, 15, [], [["101", "3"]])]
    second = [depth(21, 25), match(3), wire("snapshot", body(23, 90)), depth(26, 30, [["90", "1"]]), match(4)]
    put(tmp_path / "in", "b.txt", first, 1_788_376_140)
    root = str(tmp_path / "root")
    market.capture_frames(spark, str(tmp_path / "in"), root, roll_rows=4).awaitTermination()
    put(tmp_path / "in", "a.txt", second, 1_788_376_150)  # a later arrival under an earlier name
    market.capture_frames(spark, str(tmp_path / "in"), root, roll_rows=4).awaitTermination()
    rows = capture.read_events(spark, root).orderBy("session", "capture_seq").collect()
    assert [r.capture_seq for r in rows] == list(range(11))
    assert [r.session - rows[0].session for r in rows] == [0] * 4 + [1] * 4 + [2] * 3
    assert [r.type[0] + str(r.trade_id or r.last_seq) for r in rows] == ["t1", "b5", "b10", "s7", "t2", "b15", "b25", "t3", "s23", "b30", "t4"]
    # the second batch is tried again, after a failure that had left one of its streams
    shutil.rmtree(f"{root}/snapshots/exchange=binance/symbol=BTCUSDT/date={rows[8].date}/session={rows[8].session}/batch=1")
    (tmp_path / "root" / "_checkpoint" / "commits" / "1").unlink()
    (tmp_path / "root" / "_checkpoint" / "commits" / ".1.crc").unlink()
    market.capture_frames(spark, str(tmp_path / "in"), root, roll_rows=4).awaitTermination()
    assert capture.read_events(spark, root).orderBy("session", "capture_seq").collect() == rows
    fed = sequence.seeded(capture.read_events(spark, root)).orderBy("session", "capture_seq")
    assert [(r.attempt, r.type[0] + str(r.trade_id or r.last_seq)) for r in fed.collect()] == [(0, x) for x in ("s7", "t1", "b10", "t2", "b15")] + [(1, x) for x in ("s23", "t3", "b25", "b30", "t4")]
    got = replay.replay_features(spark, root, as_arrived=True).orderBy("ord").collect()
    assert [(float(r.best_bid), float(r.bid_depth_10)) for r in got] == [(100, 7), (100, 7), (90, 5), (90, 1)]
    again = sequence.seeded(fed.drop("attempt")).orderBy("session", "capture_seq")  # what is in order stays
    keep = ("capture_seq", "type", "last_seq", "trade_id")
    assert again.select(*keep).collect() == fed.select(*keep).collect()


def test_seeding_rules(spark):
    kinds = lambda rows: [r.type[0] + str(r.last_seq or r.trade_id) for r in sequence.seeded(frame(spark, rows)).orderBy("session", "capture_seq").collect()]
    assert kinds([update(0, 0, 10, 12), snapshot(1, 1, 5, [], []), snapshot(2, 2, 9, [], []), update(3, 3, 13, 14)]) == ["s9", "b12", "b14"]  # the first snapshot is too old
    assert kinds([update(0, 0, 10, 12), trade(1, 1, 5, 5)]) == []
    assert kinds([snapshot(0, 0, 9, [], []), update(1, 1, 3, 9), update(2, 2, 10, 11), snapshot(3, 3, 11, [], []), update(4, 4, 12, 12)]) == ["s9", "b11", "s11", "b12"]
    assert kinds([]) == []


def test_silences_in_a_stream(spark, tmp_path):
    at = [0, 1, 40, 41, 100]
    frame(spark, [trade(k, T0 + x * 10**9, 1, 1) for k, x in enumerate(at)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    market.run_to_table(market.silent(market.event_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.schema(market.SILENCE_ROW).parquet(f"{tmp_path}/out").where("until_ns is not null").orderBy("since_ns").collect()
    assert [(r.since_ns - T0, r.silence_ns) for r in got] == [(10**9, 39 * 10**9), (41 * 10**9, 59 * 10**9)]


def test_stateful_stream_equals_batch(spark, tmp_path):
    rows = random_events(4, 3)
    for k in range(3):
        part = [r for r in rows if r["capture_seq"] // 20 == k]
        frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    width = 20 * 10**9
    market.run_to_table(market.feature_stream(market.event_stream(spark, f"{tmp_path}/in"), width), f"{tmp_path}/out", f"{tmp_path}/check")
    cols = ["symbol", "session", "capture_seq", "best_bid", "order_flow_imbalance", "vwap", "realised_volatility"]
    tidy = lambda r: tuple(round(float(x), 9) if isinstance(x, float) or hasattr(x, "as_tuple") else x for x in r)
    got = {tidy(r) for r in spark.read.parquet(f"{tmp_path}/out").select(cols).collect()}
    assert got == {tidy(r) for r in features.feature_rows(frame(spark, rows), width).select(cols).collect()}
    market.run_to_table(market.outcome_stream(market.event_stream(spark, f"{tmp_path}/in"), width), f"{tmp_path}/out2", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/out2").count() == len(rows)


def test_service(spark, tmp_path):
    rows = [snapshot(0, T0, 100, [(100, 5)], [(101, 5)]), update(1, T0 + 1, 101, 101, [(100, 7)]), trade(2, T0 + 2, 100.5, 2), trade(3, T0 + 3, 100.6, 2, "sell")]
    live = api.Live().feed(frame(spark, rows))
    markets = api.Markets(live)
    assert markets.book("btcusdt", 1)["bids"][0]["quantity"].startswith("7.")
    assert markets.features("BTCUSDT")["order_flow_imbalance"].startswith("2.")
    assert [t["trade_id"] for t in markets.trades("BTCUSDT")["trades"]] == [3, 2]
    assert markets.health("BTCUSDT", now_ns=T0 + 10**9)["status"] == "ok" and markets.health("BTCUSDT", now_ns=T0 + 10**12)["stale"]
    capture.write_events(frame(spark, rows), f"{tmp_path}/root")
    server = api.serve(markets, api.Research(spark, f"{tmp_path}/root"), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert json.load(urllib.request.urlopen(f"{base}/markets/BTCUSDT/book?depth=2"))["state"] == "SYNCED"
    assert json.load(urllib.request.urlopen(f"{base}/system/health"))["symbol"] == "BTCUSDT"
    sent = urllib.request.urlopen(f"{base}/research/BTCUSDT/export?date=2026-09-02&stream=trades").read()
    (tmp_path / "sent.parquet").write_bytes(sent)
    assert [r.trade_id for r in spark.read.parquet(f"{tmp_path}/sent.parquet").collect()] == [2, 3]
    assert json.load(urllib.request.urlopen(f"{base}/research/BTCUSDT/sessions"))[0]["bytes"] > 0
    for path, status in (("/markets/XX/book", 404), ("/markets/BTCUSDT/trades?limit=0", 422), ("/nothing", 404), ("/research/BTCUSDT/export?date=2026-09-02&stream=features", 400), ("/research/BTCUSDT/export?date=2020-09-02&stream=trades", 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(base + path)
        assert e.value.code == status
    server.shutdown()


def test_live_state_goes_on_batch_by_batch(spark, tmp_path):
    live = api.Live()
    markets = api.Markets(live)
    feed = lambda *rows: live.feed(frame(spark, rows))
    status = lambda call: pytest.raises(api.ApiError, call).value.status
    assert markets.health()["state"] == "EMPTY" and status(lambda: markets.book("BTCUSDT")) == 404
    feed(snapshot(0, T0, 100, [(100, 5)], [(101, 5)]))
    assert markets.book("BTCUSDT")["state"] == "SEEDED" and status(lambda: markets.features("BTCUSDT")) == 404
    feed(update(1, T0 + 1, 101, 101, [(100, 7)]))
    known = markets.features("BTCUSDT")
    feed(update(2, T0 + 2, 90, 95))  # a duplicate leaves the features
    assert markets.features("BTCUSDT") == known
    feed(*[trade(3 + k, T0 + 3, 100, 1) for k in range(150)])
    assert [t["trade_id"] for t in markets.trades("BTCUSDT", 100)["trades"]] == list(range(152, 52, -1))
    assert [r.trade_id for r in features.last_trades(frame(spark, [trade(3 + k, T0 + 3, 100, 1) for k in range(150)])).first().trades] == list(range(152, 52, -1))
    feed(update(153, T0 + 4, 150, 151))  # a gap
    assert status(lambda: markets.book("BTCUSDT")) == 503 and status(lambda: markets.features("BTCUSDT")) == 404
    assert markets.health("BTCUSDT", now_ns=T0 + 10)["status"] == "degraded"
    frame(spark, [snapshot(154, T0 + 5, 300, [(99, 1)], [(101, 5)]), update(155, T0 + 6, 301, 301)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    live.follow(market.event_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/check").awaitTermination()
    assert markets.book("BTCUSDT")["last_sequence"] == 301 and markets.features("BTCUSDT")["best_bid"].startswith("99.")
    assert markets.health("BTCUSDT")["snapshots"] == 2


def test_throughput_is_measured(spark, tmp_path):
    from lobweave.plans import throughput

    got = throughput.measured(frame(spark, day_rows()), f"{tmp_path}/bench")
    assert got["events"] == 60 and all(v > 0 for v in got.values())


def test_every_query_has_sql_or_a_reason_and_the_entry_runs(spark):
    import __spark_entry__ as entry

    without = set(queries.QUERIES) - set(oracle.SQL)
    assert without == {"log_heartbeat"} and set(oracle.SQL) <= set(queries.QUERIES)
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["trades_by_aggressor", "flow_vwap", "book_apply_result", "feature_snapshot", "event_json"])
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=key)
    want = sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({oracle.SQL[name]})").fetchall(), key=key)
    assert got == want and got


def test_fixture_reaches_the_outcomes(spark):
    assert fx_book(spark, SF).where("type = 'snapshot'").count() == 5
