"""Late events and bans over several runs of a stream, with restarts."""

import random
from datetime import UTC, datetime, timedelta
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from watchloom.operators import edge
from watchloom.operators.features import security_features
from watchloom.plans import live
from watchloom.schema import EVENT_SCHEMA, FEATURE_COLUMNS, FEATURE_KEYS
from watchloom.sources import lake
from watchloom.streaming import bans, jobs, late

START = datetime(2026, 1, 1, tzinfo=UTC)


def events(spark, rnd, part, late_by=0):
    rows = [
        {"ts": START + timedelta(seconds=part * 900 + rnd.randint(0, 899) - (late_by if rnd.random() < 0.1 else 0)), "source": "lb", "host": rnd.choice(["h", "g"]), "message": "m",
         "status": rnd.choice([200, 500]), "latency_ms": float(rnd.randint(0, 99)), "bytes": 5, "src_ip": f"ip{rnd.randint(0, 4)}", "path": "/"}
        for _ in range(120)
    ]
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def test_late_events_amend_windows_over_restarts(spark, tmp_path):
    rnd, at = random.Random(8), str(tmp_path)
    for part in range(4):
        events(spark, rnd, part, late_by=2000).coalesce(1).write.mode("append").parquet(f"{at}/in")
        # each run goes on from the checkpoints of the one before
        jobs.drain(late.late_gate(spark.readStream.schema(EVENT_SCHEMA).parquet(f"{at}/in"), f"{at}/gate", f"{at}/cp1", 300, "5 minutes", every=None))
        job = jobs.features_job(late.gated(spark, f"{at}/gate", "ontime", EVENT_SCHEMA), f"{at}/f", f"{at}/cp2", 300, "5 minutes", every=None, kept_counts=f"{at}/c")
        jobs.drain(job)
        assert jobs.late_rows(job) == 0
        jobs.drain(late.amendments(late.gated(spark, f"{at}/gate", "late", EVENT_SCHEMA), f"{at}/c", f"{at}/a", f"{at}/cp3", 300, every=None))
    jobs.flush_open(spark, f"{at}/f", f"{at}/cp2", 300)
    every = spark.read.schema(EVENT_SCHEMA).parquet(f"{at}/in")
    n = [spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{at}/gate/{p}").count() for p in ("ontime", "late")]
    assert sum(n) == every.count() and n[1] > 5
    got = late.amended_features(lake.read_features(spark, f"{at}/f"), spark, f"{at}/a")
    key = lambda r: tuple(r[k] for k in FEATURE_KEYS)
    mine, want = ({key(r): [r[c] for c in FEATURE_COLUMNS] for r in df.collect()} for df in (got, security_features(every, 300, "tumbling")))
    assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k]) for k in want)


def test_bans_over_restarts_equal_batch(spark, tmp_path):
    rnd, at, schema = random.Random(1), str(tmp_path), "event_id long, src_ip string, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, limits = [], dict(limit=4, seconds=60, ban=150)
    for part in range(4):
        own = [(part * 1000 + i, rnd.choice(["hot", "hot", "b", "c", None]), START + timedelta(milliseconds=rnd.randint(0, 300_000) + part * 300_000)) for i in range(60)]
        rows += own
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        if part == 3:
            spark.createDataFrame([(-1, "clock", START + timedelta(days=1))], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
        jobs.drain(bans.ban_job(stream, f"{at}/out", f"{at}/cp", "5 minutes", every=None, **limits))
    got = spark.read.schema(bans.BANNED).option("recursiveFileLookup", "true").parquet(f"{at}/out")
    want = edge.mark_banned(spark.createDataFrame(rows, schema), **limits).where("banned")
    both = [sorted((r["event_id"], r["src_ip"], r["ts"]) for r in df.collect()) for df in (got, want.select("event_id", "src_ip", "ts"))]
    assert both[0] == both[1] and len(both[0]) > 10
    # no request is left in the state but the clock's; slots beyond the limit go with the next batch
    left = spark.read.format("statestore").option("stateVarName", "slots").load(f"{at}/cp").where(F.col("key.src_ip") != "clock")
    assert left.where(F.size("user_map_value.ids") > 0).count() == 0 and left.where("user_map_value.n <= 4").count() == 0


class FakeState(dict):
    """A client's state and timers in memory; counts entries read."""

    def __init__(self):
        super().__init__()
        self.read, self.timers, self.value = 0, set(), None

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        held = self

        class Value:
            exists = staticmethod(lambda: held.value is not None)
            get = staticmethod(lambda: held.value)
            update = staticmethod(lambda v: setattr(held, "value", v))
            clear = staticmethod(lambda: setattr(held, "value", None))

        return Value

    def registerTimer(self, at):
        self.timers.add(at)

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        self.read += 1
        return self[k]

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        self.pop(k, None)

    def iterator(self):
        for k, v in list(self.items()):
            self.read += 1
            yield k, v


def test_a_slot_of_a_busy_client_is_read_a_few_times_only():
    """All of a client's slots are over at once: what is read grows with the slots, not with their square."""
    n, at, state = 300, 60 * 1_000_000, FakeState()
    job = bans.BanProcessor(limit=2, seconds=60, ban=90)
    job.init(state)
    times = [s * at + i for s in range(n) for i in range(3 if s % 10 == 0 else 1)]
    list(job.handleInputRows(("c",), iter([pd.DataFrame({"event_id": range(len(times)), "micros": times})]), None))
    mark, got = (n + 5) * 60_000, []
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
    while due := sorted(t for t in state.timers if t <= mark):
        state.timers.remove(due[0])
        got += [int(i) for f in job.handleExpiredTimer(("c",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: due[0])) for i in f["event_id"]]
    assert not state and state.read <= 4 * n
    until = [(s + 1) * at + 90_000_000 for s in range(0, n, 10)]
    assert sorted(got) == [i for i, m in enumerate(times) if any((u - 90_000_000) <= m < u for u in until)] and len(got) == 60


def test_batches_of_several_files_hold_a_part(spark, tmp_path, monkeypatch):
    """Large parts are written by several tasks, and a batch of the stream still takes just one part."""
    monkeypatch.setattr(live, "FILE_ROWS", 40)
    day = [datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=p * live.PART + i) for p, n in ((0, 300), (1, 3), (2, 90)) for i in range(n)]
    rows = [(i, t, i % 7, "click", float(i), '{"k": 1}') for i, t in enumerate(day)]
    spark.createDataFrame([*rows, (1, None, None, None, None, None)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    stream = live.arrivals(spark, str(tmp_path), very_late=False, clock=10)
    jobs.drain(jobs.trigger(stream.writeStream.foreachBatch(lambda df, b: seen.append(sorted(r[0] for r in df.select("event_id").collect()))).option("checkpointLocation", f"{tmp_path}/cp"), None).start())
    part = lambda i, t: (t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() // live.PART + (i % live.DELAYED == 0)
    by = {}
    for i, t, *_ in rows:
        by.setdefault(part(i, t), []).append(i)
    assert [b for b in seen if b] == [sorted(by[p]) for p in sorted(by)] + [[-1]]
