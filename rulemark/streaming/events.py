"""Event streams: rows once, sessions, and the latest earlier row of another stream.

All three take streaming and static frames alike, but for ``as_of``, which keeps
state and is for streams (static frames have ``operators.joins.as_of``). State is
bounded by time: a watermark of ``late`` behind the newest row says when a row may
be forgotten. Defined results: rows without a time are left out; rows that come
later than ``late`` are left out of a stream; a static frame has no late rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(events: DataFrame, keys: Sequence[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """events without rows that repeat another's keys: within the watermark in a stream, at all in a static frame."""
    events = events.where(F.col(time).isNotNull())
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def sessions(events: DataFrame, by: Sequence[str], gap: str = "30 minutes", time: str = "ts", value: str = "value", late: str = "1 hour") -> DataFrame:
    """(by, start, last, n, total): runs of a key's rows no two neighbours of which lie more than ``gap`` apart."""
    rows = events.where(F.col(time).isNotNull()).withWatermark(time, late)
    run = rows.groupBy(F.session_window(time, gap).alias("s"), *by).agg(F.min(time).alias("start"), F.max(time).alias("last"), F.count("*").alias("n"), F.sum(value).alias("total"))
    return run.select(*by, "start", "last", "n", "total")


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, value: str, tolerance_s: float, late: str = "1 hour") -> DataFrame:
    """(by, time, matched_time, value): each left row with the newest right row of its key that is no later and at most tolerance_s older, else nulls.

    A left row waits until the watermark has passed it: no right row before it can
    still come. Right rows go when no waiting or coming left row may want them.
    Times are kept to the microsecond.
    """
    micros = F.unix_micros(F.col(time))
    side = lambda df, which, v: df.where(F.col(time).isNotNull() & F.col(by).isNotNull()).select(F.col(by).cast("string").alias("key"), F.col(time).alias("at"), micros.alias("us"), F.lit(which).alias("side"), v.cast("double").alias("v"))
    both = side(left, 0, F.lit(None)).unionByName(side(right, 1, F.col(value))).withWatermark("at", late)
    span = int(tolerance_s * 1e6)

    def match(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, known = (json.loads(x) for x in state.get) if state.exists else ([], [])
        mark = state.getCurrentWatermarkMs() * 1000
        for frame in frames:
            for us, which, v in zip(frame["us"].tolist(), frame["side"].tolist(), frame["v"].tolist(), strict=True):
                if us >= mark:
                    (waiting if which == 0 else known).append(us if which == 0 else [us, v])
        known.sort()
        out = []
        for us in sorted(u for u in waiting if u < mark):
            found = [k for k in known if us - span <= k[0] <= us]
            out.append((key[0], us, found[-1][0] if found else None, found[-1][1] if found else None))
        waiting = [u for u in waiting if u >= mark]
        known = [k for k in known if k[0] >= mark - span]
        if waiting or known:
            state.update((json.dumps(waiting), json.dumps(known)))
            # Woken when the watermark passes the first row that waits, or the last that is kept.
            wake = min(waiting) // 1000 + 1 if waiting else (known[-1][0] + span) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, mark // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "us", "matched", "v"]).astype({"us": "int64", "matched": "Int64", "v": "float64"})

    found = both.groupBy("key").applyInPandasWithState(match, "key string, us long, matched long, v double", "waiting string, known string", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("key").alias(by), F.timestamp_micros("us").alias(time), F.timestamp_micros("matched").alias("matched_time"), F.col("v").alias(value))
