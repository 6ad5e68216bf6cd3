"""Distinct members of a key within a trailing time to live, kept as stream state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TrailingMembers(StatefulProcessor):
    """Events wait until the watermark passes them, then are taken in time order: each gets the number of members seen in
    ``[t - ttl, t]``, its own instant included. A member leaves the state when its last sight is older than the time to
    live, an idle key with its last member, by event-time timers. Per key the state holds the waiting events and
    one entry per live member."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, ident string, member string")
        self.seen = handle.getMapState("seen", "member string", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if len(pdf):
                self.waiting.appendList([(int(u), i, m) for u, i, m in zip(pdf["us"], pdf["ident"], pdf["member"].where(pdf["member"].notna(), None))])
                for at in sorted(set(-(-pdf["us"] // 1000))):
                    self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= until], [tuple(r) for r in rows if r[0] > until]
        last = {k[0]: v[0] for k, v in self.seen.iterator()} if self.seen.exists() else {}
        known, out, at = dict(last), [], 0
        while at < len(due):
            us, end = due[at][0], at
            while end < len(due) and due[end][0] == us:  # peers of one instant see each other
                if due[end][2] is not None:
                    last[due[end][2]] = us
                end += 1
            last = {m: t for m, t in last.items() if t >= us - self.ttl}
            out += [(key[0], due[i][1], us, len(last)) for i in range(at, end)]
            at = end
        last = {m: t for m, t in last.items() if t >= until - self.ttl}
        for m in known.keys() - last.keys():
            self.seen.removeKey((m,))
        for m, t in last.items():
            if known.get(m) != t:
                self.seen.updateValue((m,), (t,))
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if last:
            self.handle.registerTimer(int(-(-(min(last.values()) + self.ttl + 1) // 1000)))  # when the oldest member has to go
        if out:
            yield pd.DataFrame(out, columns=["key", "ident", "us", "members"])

    def close(self) -> None:
        pass


def trailing_members(events: DataFrame, key: str, member: str, ttl_seconds: int, ident: str, ts: str = "timestamp", lateness: str = "5 minutes") -> DataFrame:
    """(key, ident, timestamp, members) of each event of a stream, in step with ``velocity.trailing_distinct``.

    Events older than the watermark are dropped as late. Results come out once the watermark has passed an event."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # keyed state with timers needs it
    slim = events.withWatermark(ts, lateness).select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("us"), F.col(ident).cast("string").alias("ident"),
                                                     F.col(member).cast("string").alias("member"), F.col(ts).alias("event_time"))
    counted = slim.groupBy("key").transformWithStateInPandas(TrailingMembers(ttl_seconds), "key string, ident string, us long, members long", "Append", "EventTime")
    return counted.select(F.col("key").alias(key), F.col("ident").alias(ident), F.timestamp_micros("us").alias(ts), "members")
