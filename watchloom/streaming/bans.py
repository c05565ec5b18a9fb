"""Rate bans on a stream: per client, counts of open slots and event-time timers.

A client with more than ``limit`` requests in a slot of ``seconds`` is banned from the slot's end on for ``ban`` seconds. Whether a
request met a running ban is known for sure once everything before its slot has come, which is when
the watermark passes the slot's end. A client has one timer, at the earliest time it waits for; when it fires, all slots that are over
by then are decided in one pass over their counts, in order, and their requests are let go. Slots within
the limit leave no state; a slot beyond it leaves one number, which goes when its ban can reach no request any more.
A client's state is thus its open slots and its running bans, and a short list of both; requests of a slot are read again only where a ban may have met them. Requests after the watermark, and those without a client or time, are not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from watchloom.operators.edge import BAN_SECONDS, RATE_LIMIT, RATE_SECONDS
from watchloom.streaming.jobs import trigger

BANNED = T.StructType().add("event_id", "long").add("src_ip", "string").add("ts", "timestamp")
_SLOT = T.StructType().add("slot", "long")
_OPEN = T.StructType().add("n", "long").add("ids", T.ArrayType(T.LongType())).add("micros", T.ArrayType(T.LongType()))
_LISTED = T.StructType().add("slots", T.ArrayType(T.LongType())).add("counts", T.ArrayType(T.LongType())).add("decided", T.ArrayType(T.BooleanType())).add("wake", T.LongType())
MICROS = 1_000_000


class BanProcessor(StatefulProcessor):
    """Requests of one client; yields those that a ban of the client met."""

    def __init__(self, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS, ban: int = BAN_SECONDS) -> None:
        self.limit, self.seconds, self.ban = limit, seconds, ban

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", _SLOT, _OPEN)
        self.listed = handle.getValueState("listed", _LISTED)

    def _list(self) -> tuple[dict[int, tuple[int, bool]], int | None]:
        """(count, decided) by slot, and the time in seconds that a timer is set to."""
        if not self.listed.exists():
            return {}, None
        slots, counts, decided, wake = self.listed.get()
        return {k: (n, d) for k, n, d in zip(slots, counts, decided, strict=True)}, wake

    def _keep(self, known: dict[int, tuple[int, bool]], wake: int | None) -> None:
        """Store the list and see that a timer fires at the earliest time it waits for."""
        if not known:
            self.listed.clear()
            return
        due = min(self._over(k) if decided else (k + 1) * self.seconds for k, (_, decided) in known.items())
        if wake is None or due != wake:
            self.handle.registerTimer(due * 1000)
        self.listed.update((list(known), [n for n, _ in known.values()], [d for _, d in known.values()], due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        micros = np.concatenate([p["micros"].to_numpy(np.int64) for p in parts])
        ids = [None if pd.isna(i) else int(i) for p in parts for i in p["event_id"].tolist()]
        slot_of = micros // (self.seconds * MICROS)
        order = np.argsort(slot_of, kind="stable")
        known, wake = self._list()
        for own in np.split(order, np.flatnonzero(np.diff(slot_of[order])) + 1):
            slot = int(slot_of[own[0]])
            n, old_ids, old_micros = self.slots.getValue((slot,)) if slot in known else (0, [], [])
            self.slots.updateValue((slot,), (n + len(own), [*old_ids, *[ids[i] for i in own]], [*old_micros, *micros[own].tolist()]))
            known[slot] = n + len(own), known.get(slot, (0, False))[1]
        self._keep(known, wake)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all timers up to the watermark fire; the first of a client does the work of all
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        known, wake = self._list()
        met: list[tuple[int | None, int]] = []
        until = 0
        for slot, (n, decided) in sorted(known.items()):
            if not decided:
                # counts of all earlier slots are complete by now
                if (slot + 1) * self.seconds > now:
                    break
                if until > slot * self.seconds:
                    _, ids, micros = self.slots.getValue((slot,))
                    met += [(i, m) for i, m in zip(ids, micros, strict=True) if m < until * MICROS]
                if n > self.limit:
                    self.slots.updateValue((slot,), (n, [], []))
                    known[slot] = n, True
                else:
                    self.slots.removeKey((slot,))
                    del known[slot]
            if n > self.limit:
                until = max(until, self._until(slot))
        for slot in [k for k, (_, decided) in known.items() if decided and self._over(k) <= now]:
            self.slots.removeKey((slot,))
            del known[slot]
        self._keep(known, wake)
        if met:
            yield pd.DataFrame({"event_id": pd.array([i for i, _ in met], "Int64"), "src_ip": key[0], "ts": pd.to_datetime([m for _, m in met], unit="us", utc=True)})

    def _until(self, slot: int) -> int:
        return (slot + 1) * self.seconds + self.ban

    def _over(self, slot: int) -> int:
        """End of the last slot that the slot's ban reaches into."""
        return -(-self._until(slot) // self.seconds) * self.seconds + 1

    def close(self) -> None:
        pass


def banned_requests(requests: DataFrame, delay: str = "10 minutes", limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS, ban: int = BAN_SECONDS) -> DataFrame:
    """(event_id, src_ip, ts) of the requests that met a ban, out of a stream with those columns."""
    rows = requests.where(F.col("src_ip").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    narrow = rows.select("event_id", "src_ip", "ts", F.unix_micros("ts").alias("micros"))
    return narrow.groupBy("src_ip").transformWithStateInPandas(
        statefulProcessor=BanProcessor(limit, seconds, ban), outputStructType=BANNED, outputMode="Append", timeMode="EventTime"
    )


def ban_job(requests: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", every: str | None = "1 minute", **limits: int) -> StreamingQuery:
    """Write banned requests to ``path``; a batch run again replaces its rows."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = banned_requests(requests, delay, **limits).writeStream.outputMode("append").foreachBatch(write)
    return trigger(writer.option("checkpointLocation", checkpoint), every).start()
