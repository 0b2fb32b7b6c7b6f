"""python -m lobweave capture FRAMES ROOT | replay SYMBOL DATE [SPEED [ROOT]] | features SYMBOL DATE [ROOT] | report ROOT | log PATH | bench SYMBOL DATE [ROOT]"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from . import api, session
from .operators import reports, sequence
from .plans import replay, throughput
from .sources import capture, logs
from .streaming import market


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    command, rest = args[0], args[1:]
    spark = session.get_or_create()
    try:
        if command == "capture":
            market.capture_frames(spark, *rest[:2]).awaitTermination()
        elif command == "replay":
            symbol, date = rest[:2]
            speed, root = float(rest[2]) if len(rest) > 2 else 0.0, rest[3] if len(rest) > 3 else api.data_root()
            for row in replay.replay_partition(spark, root, api.EXCHANGE, symbol, date, speed):
                print(row["type"], row["session"], row["capture_seq"], row["timestamp_ns"], row["last_seq"] if row["type"] != "trade" else row["price"])
        elif command == "features":
            symbol, date = rest[:2]
            root = rest[2] if len(rest) > 2 else api.data_root()
            replay.replay_features(spark, root, api.EXCHANGE, symbol, [date], as_arrived=True).orderBy("ord").show(50, truncate=False)
        elif command == "report":
            rows = capture.read_events(spark, rest[0])
            updates, trades = rows.where("type = 'book_update'"), rows.where("type = 'trade'")
            sequence.sequence_gaps(updates, ("exchange", "symbol")).select("symbol", "session", "first_seq", "gap").show()
            sequence.sequence_span(updates, ("exchange", "symbol")).show()
            reports.by_aggressor(trades, "symbol").show()
            reports.null_counts(trades.drop("first_seq", "last_seq", "bids", "asks")).show()
            capture.sizes(spark, rest[0]).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).show()
        elif command == "log":
            logs.log_summary(logs.read_log(spark, rest[0])).show(truncate=False)
        elif command == "bench":
            symbol, date = rest[:2]
            rows = capture.read_events(spark, rest[2] if len(rest) > 2 else api.data_root(), api.EXCHANGE, symbol, [date])
            for name, value in throughput.measured(rows, session.work_path(spark, "bench")).items():
                print(f"{name}: {value:,.1f}")
        else:
            print(__doc__)
            return 2
    except capture.CaptureNotFound as missing:
        print(f"no capture at {missing}")
        return 1
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
