"""Streams against their batch twins, over several micro-batches."""

import datetime
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewell.operators.trigger import sta_lta, trigger
from tracewell.streaming import features
from tracewell.streaming import trigger as online
from tracewell.streaming.trigger import ratio_from_ring, stream_trigger

SCHEMA = "t string, ts timestamp, i long, v double"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime.datetime(2024, 1, 1)


def write_batches(spark, rows, cuts, folder):
    """One file per micro-batch, in time order of the files."""
    pdf = pd.DataFrame(rows, columns=["t", "i", "v"])
    pdf["ts"] = [START + datetime.timedelta(seconds=int(i)) for i in pdf.i]
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        part = pdf[(pdf.i >= lo) & (pdf.i < hi)].sample(frac=1, random_state=b)
        spark.createDataFrame(part[["t", "ts", "i", "v"]], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(pdf[["t", "ts", "i", "v"]], SCHEMA)


@pytest.fixture(scope="module")
def traces(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    rows = [(t, i, float(v)) for t in "abc" for i, v in enumerate(rng.normal(size=240) * (1 + 4 * (np.arange(240) % 60 > 48)))]
    folder = str(tmp_path_factory.mktemp("live"))
    return write_batches(spark, rows, [0, 37, 38, 120, 240], folder), folder


def test_ring_equals_whole_trace():
    rng = np.random.default_rng(1)
    e = rng.normal(size=100) ** 2
    whole = ratio_from_ring(np.array([]), e, 3, 10, 1e-20)
    ring, got = np.array([]), []
    for a, b in ((0, 2), (2, 3), (3, 60), (60, 100)):
        got.append(ratio_from_ring(ring, e[a:b], 3, 10, 1e-20))
        ring = np.r_[ring, e[a:b]][-9:]
    np.testing.assert_allclose(np.concatenate(got), whole)


def run_trigger(spark, folder, *args, **kw):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        return features.run_to_table(stream_trigger(live, ["t"], 3, 10, 1.8, 0.8, 2, *args, **kw)).collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_stream_trigger_equals_batch(spark, traces, tmp_path):
    """Open events are closed by silence, so all detections of the batch come out."""
    batch, shared = traces
    folder = str(tmp_path / "live")  # the rows at the end must not reach the other tests
    shutil.copytree(shared, folder)
    end = spark.createDataFrame([("z", START + datetime.timedelta(seconds=400), 0, 0.0)], SCHEMA)
    end.coalesce(1).write.mode("append").parquet(folder)
    got = [r for r in run_trigger(spark, folder, "1 second", 60_000, bucket_ms=5_000) if r.t != "z"]
    want = trigger(sta_lta(batch, ["t"], 3, 10), ["t"], 1.8, 0.8, 2).collect()
    assert len(want) > 5
    assert sorted((r.t, r.on_i, r.off_i) for r in got) == sorted((r.t, r.on_i, r.off_i) for r in want)
    for r in got:
        assert (r.t_on - START).total_seconds() == r.on_i and r.closed_by == ("below" if r.off_i < 240 else "silence")


def test_rows_inside_the_watermark_keep_their_place(spark, tmp_path):
    """Rows up to 50 s behind the newest row, spread over micro-batches, with a watermark of one minute."""
    rng = np.random.default_rng(5)
    rows = [("a", i, float(v)) for i, v in enumerate(rng.normal(size=600) * (1 + 4 * (np.arange(600) % 60 > 48)))]
    pdf = pd.DataFrame(rows, columns=["t", "i", "v"])
    pdf["ts"] = [START + datetime.timedelta(seconds=int(i)) for i in pdf.i]
    come = (pdf.i + rng.integers(0, 50, len(pdf))) // 100
    for b in sorted(set(come)):
        spark.createDataFrame(pdf[come == b][["t", "ts", "i", "v"]], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    end = spark.createDataFrame([("z", START + datetime.timedelta(seconds=2000), 0, 0.0)], SCHEMA)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    got = run_trigger(spark, str(tmp_path / "l"), "1 minute", 60_000, bucket_ms=10_000)
    batch = spark.createDataFrame(pdf[["t", "ts", "i", "v"]], SCHEMA)
    want = trigger(sta_lta(batch, ["t"], 3, 10), ["t"], 1.8, 0.8, 2).collect()
    assert len(want) > 5 and sorted((r.on_i, r.off_i) for r in got) == sorted((r.on_i, r.off_i) for r in want)


def test_silence_ends_an_event_inside_a_trace(spark, tmp_path):
    values = [1.0] * 20 + [9.0] * 3 + [9.0] * 3 + [0.1] * 20
    at = [i if i < 23 else i + 300 for i in range(len(values))]
    pdf = pd.DataFrame({"t": "a", "ts": [START + datetime.timedelta(seconds=x) for x in at], "i": range(len(values)), "v": values})
    spark.createDataFrame(pdf, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "l"))
    got = run_trigger(spark, str(tmp_path / "l"), "1 second", 60_000, bucket_ms=1_000)
    assert [(r.on_i, r.off_i, r.closed_by) for r in sorted(got)][0] == (0, 23, "silence")
    assert sorted(got)[1].on_i == 23


def test_windows_close_at_the_watermark(spark, traces):
    batch, folder = traces
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = features.run_to_table(features.stream_windows(live, ["t"], "20 seconds", "10 seconds", "5 seconds")).toPandas()
    pdf = batch.toPandas()
    for t, g in pdf.groupby("t"):
        for w0 in range(-10, 240, 10):
            rows = g[(g.i >= w0) & (g.i < w0 + 20)].v
            mine = got[(got.t == t) & (got.w0 == START + datetime.timedelta(seconds=w0))]
            closed = w0 + 20 <= 239 - 5
            assert len(mine) == int(closed and len(rows) > 0)
            if len(mine):
                assert mine.n.iloc[0] == len(rows) and mine["var"].iloc[0] == pytest.approx(rows.var(ddof=0))


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [("a", i, 1.0) for i in range(100)]
    # a row is late when the watermark of the batch before its own has passed it
    write_batches(spark, rows, [0, 90, 100], str(tmp_path / "l"))
    late = spark.createDataFrame([("a", START + datetime.timedelta(seconds=3), 3, 50.0)], SCHEMA)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    end = spark.createDataFrame([("a", START + datetime.timedelta(seconds=200), 200, 1.0)], SCHEMA)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    out = features.run_to_table(features.stream_energy(live, ["t"], "10 seconds", "5 seconds")).toPandas()
    first = out[out.w0 == START]
    assert len(first) == 1 and first.n.iloc[0] == 10 and first.rms.iloc[0] == pytest.approx(1.0)


def test_sessions(spark, traces):
    batch, folder = traces
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    got = features.run_to_table(features.stream_sessions(live, ["t"], 3.0, "6 seconds", "2 seconds", value="v")).collect()
    want = []
    for t, g in batch.toPandas().groupby("t"):
        loud = sorted(g[g.v > 3].i)
        run = []
        for i in loud:
            if run and i - run[-1] >= 6:
                want.append((t, run[0], run[-1] + 6, len(run)))
                run = []
            run.append(i)
        if run:
            want.append((t, run[0], run[-1] + 6, len(run)))
    limit = 239 - 2  # sessions that the watermark has not passed stay open
    want = [w for w in want if w[2] <= limit]
    assert sorted((r.t, (r.t_on - START).total_seconds(), (r.t_off - START).total_seconds(), r.n) for r in got) == sorted(want)


def test_stream_of_a_table_in_part_files(spark, tmp_path):
    """A table may be one file, or a folder of part files; both forms and later tables are read, other tables are not."""
    rows = spark.range(100).select("id")
    rows.repartition(3).write.parquet(str(tmp_path / "in/a.parquet"))
    rows.select((F.col("id") + 100).alias("id")).coalesce(1).write.parquet(str(tmp_path / "one"))
    shutil.copy(next((tmp_path / "one").glob("part-*.parquet")), tmp_path / "in/a-2.parquet")
    rows.write.parquet(str(tmp_path / "in/b.parquet"))
    read = lambda: features.run_to_table(features.stream_table(spark, str(tmp_path / "in"), "a", "id long"), str(tmp_path / "out"))
    assert sorted(r.id for r in read().collect()) == list(range(200))
    rows.select((F.col("id") + 200).alias("id")).write.parquet(str(tmp_path / "in/a-3.parquet"))
    assert sorted(r.id for r in read().collect()) == list(range(300))


class Held:
    """The state of one trace in memory; counts what is asked of it."""

    def __init__(self):
        self.value, self.map, self.timers, self.asked, self.longest = None, {}, set(), 0, 0

    def getValueState(self, *args):
        return self

    getMapState = getValueState

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def getValue(self, key):
        self.asked += 1
        return self.map.get(key)

    def updateValue(self, key, value):
        self.asked += 1
        self.map[key] = value
        self.longest = max(self.longest, len(value[0]))

    def removeKey(self, key):
        self.asked += 1
        del self.map[key]

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def run_held(v, arrive, delay_s, span, monkeypatch):
    """One trace, a row a second in buckets of 2 s; ``arrive`` has the micro-batch of each row."""
    monkeypatch.setattr(online, "SPAN", span)
    monkeypatch.setattr(online, "GATHERED", 50)
    held, us = Held(), np.arange(len(v)) * 1_000_000
    trace = online._Trigger(["t"], 3, 10, 1.8, 0.8, 2, 1e-20, "v", "ts", 60_000, 2_000)
    trace.init(held)
    found, rng, newest = [], np.random.default_rng(3), 0
    for batch in [*sorted(set(arrive)), None]:
        if batch is not None:
            mine = rng.permutation(np.flatnonzero(arrive == batch))
            chunks = [pd.DataFrame({"ts": pd.to_datetime(us[c], unit="us"), "v": v[c]}) for c in np.array_split(mine, 3) if len(c)]
            assert not list(trace.handleInputRows(("a",), iter(chunks), None))
            newest = max(newest, us[mine].max() // 1000)
        until = Watermark(int(newest) - 1000 * delay_s if batch is not None else 10**9)
        while any(t <= until.at for t in held.timers):
            held.timers = {t for t in held.timers if t > until.at}
            for part in trace.handleExpiredTimer(("a",), until, None):
                found += part[["on_i", "off_i"]].to_numpy().tolist()
    assert not held.map
    return sorted(map(tuple, found)), held


@pytest.mark.parametrize("span", [1, 7, 40, 1 << 12])
@pytest.mark.parametrize("delay_s", [30, 3_000])
def test_waiting_rows_in_spans(spark, span, delay_s, monkeypatch):
    rng = np.random.default_rng(8)
    v = rng.normal(size=1500) * (1 + 4 * (np.arange(1500) % 60 > 48))
    arrive = rng.integers(0, 12, len(v))
    if delay_s == 30:  # up to 20 s late; else in any order, and all waits to the end
        arrive = np.sort(arrive)[np.minimum(len(v) - 1, np.arange(len(v)) + rng.integers(0, 20, len(v)))]
    got, held = run_held(v, arrive, delay_s, span, monkeypatch)
    batch = spark.createDataFrame(pd.DataFrame({"t": "a", "i": range(len(v)), "v": v}))
    want = trigger(sta_lta(batch, ["t"], 3, 10), ["t"], 1.8, 0.8, 2).collect()
    assert len(want) > 10 and got == sorted((r.on_i, r.off_i) for r in want)
    assert held.longest <= max(span, 2)
    if span == 1 << 12:
        # a row or bucket of its own would take at least one call
        assert held.asked < 250
