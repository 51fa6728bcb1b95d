"""Streams over several files that do not come in order of time."""

import os
from datetime import datetime, timedelta
from pathlib import Path

from tidemark.plans import market
from tidemark.streaming import candles

#: Days of the events of each file, in the order in which the files come; ids are days.
FILES = [[200, 201], [0, 1, 200], [100, 0]]


def folder_of(spark, tmp_path):
    for k, days in enumerate(FILES):
        rows = [(d, d, datetime(2024, 1, 1) + timedelta(days=d), float(d)) for d in days]
        part = tmp_path / f"part{k}"
        spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").coalesce(1).write.parquet(str(part))
        (file,) = part.glob("*.parquet")
        to = tmp_path / "events.parquet" / f"{k}.parquet"
        to.parent.mkdir(exist_ok=True)
        os.utime(file.rename(to), (1_700_000_000 + 60 * k,) * 2)
    return str(tmp_path)


def test_back_fill_keeps_late_events(spark, tmp_path):
    got = market.QUERIES["stream_distinct"](spark, folder_of(spark, tmp_path)).collect()
    assert sorted(r.event_id for r in got) == [0, 1, 100, 200, 201]


def test_live_stream_drops_late_events(spark, tmp_path):
    folder = Path(folder_of(spark, tmp_path))
    stream = candles.distinct_trades(candles.trade_stream(spark, str(folder), "events"), ["event_id"], "60 days")
    got = candles.drain(stream, f"file://{folder}/drained").collect()
    # The first file's watermark holds from the third on: 100 is late there.
    assert sorted(r.event_id for r in got) == [0, 1, 200, 201]
