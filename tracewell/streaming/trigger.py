"""Online STA/LTA with a hysteresis trigger, one state per trace.

Rows wait in the state until the watermark has passed their bucket of event time;
then they are put in time order and used.  So rows may arrive in any order within
the watermark, and positions are those of the whole trace.  Rows of a bucket that
was used are behind the watermark and are dropped; they are the only ones.  The
state holds the waiting rows, the energies of the last n_lta rows, the position and
the open event.

Waiting rows lie in spans of whole buckets that follow each other in time.  A span
of over ``SPAN`` rows is split, so a trace with few rows is read and written once,
and of a long one a task holds a span, or a bucket that has more rows.  One timer, for
the earliest bucket, stands for all.

An open event ends where the ratio falls below ``off``, or after its last row when
the next row is ``silence_ms`` or more later, or when the watermark says that no
such row can come.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("ring", T.ArrayType(T.DoubleType())), T.StructField("open_i", T.LongType()),
    T.StructField("open_us", T.LongType()), T.StructField("last_us", T.LongType()), T.StructField("used_ms", T.LongType()),
    T.StructField("due_ms", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())),
])
NEW = (0, [], None, None, None, None, None, [])
SPAN = 1 << 12  # rows of several buckets that wait together
GATHERED = 1 << 16  # new rows that a task collects before it puts them into spans
BUCKET = T.StructType([T.StructField("bucket", T.LongType())])
WAITING = T.StructType([T.StructField("us", T.ArrayType(T.LongType())), T.StructField("v", T.ArrayType(T.DoubleType()))])


def trailing_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of each value and the n - 1 before it, for positions n - 1 and later, from sums of 1, 2, 4, ... values."""
    total, at, power, size = None, 0, x, 1
    while size <= n:
        if n & size:
            end = len(x) - n + 1
            part = power[n - at - size:n - at - size + end]
            total = part if total is None else total + part
            at += size
        power, size = power[:-size] + power[size:] if len(power) > size else power[:0], 2 * size
    return total


def ratio_from_ring(ring: np.ndarray, energy: np.ndarray, n_sta: int, n_lta: int, floor: float) -> np.ndarray:
    """Causal ratio for new energies, given the previous ones (zeros before the start)."""
    full = np.concatenate([np.zeros(max(0, n_lta - 1 - len(ring))), ring[-(n_lta - 1):] if n_lta > 1 else ring[:0], energy])
    sta, lta = trailing_sums(full[n_lta - n_sta:], n_sta) / n_sta, trailing_sums(full, n_lta) / n_lta
    return np.where(lta > floor, sta / np.where(lta > floor, lta, 1.0), 0.0)


class _Trigger(StatefulProcessor):
    def __init__(self, key, n_sta, n_lta, on, off, min_n, floor, value, ts, silence_ms, bucket_ms):
        self.key, self.n_sta, self.n_lta, self.on, self.off = key, n_sta, n_lta, on, off
        self.min_n, self.floor, self.value, self.ts, self.silence_ms, self.bucket_ms = min_n, floor, value, ts, silence_ms, bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trace", STATE)
        self.waiting = handle.getMapState("waiting", BUCKET, WAITING)

    def _frame(self, key, rows):
        out = pd.DataFrame(rows, columns=["on_i", "off_i", "t_on", "t_off", "closed_by"])
        for name, v in zip(reversed(self.key), reversed(key)):
            out.insert(0, name, v)
        for c in ("t_on", "t_off"):
            out[c] = pd.to_datetime(out[c], unit="us", utc=True)
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() or NEW
        used, due, spans = state[5], state[6], list(state[7])
        us, v, size = [], [], 0

        def put() -> None:
            nonlocal due, size
            if size:
                first = (self._wait(spans, np.concatenate(us), np.concatenate(v)) + 1) * self.bucket_ms
                if due is None or first < due:
                    due = first
                    self.handle.registerTimer(due)
            us.clear(), v.clear()
            size = 0

        for chunk in rows:
            at = pd.to_datetime(chunk[self.ts], utc=True).astype("datetime64[us, UTC]").astype("int64").to_numpy()
            # what the watermark has passed is left out
            fresh = np.ones(len(at), bool) if used is None else (at // (1000 * self.bucket_ms) + 1) * self.bucket_ms > used
            us.append(at[fresh])
            v.append(chunk[self.value].to_numpy(dtype=float)[fresh])
            size += int(fresh.sum())
            if size >= GATHERED:
                put()
        put()
        if (due, spans) != (state[6], list(state[7])):
            self.state.update((*state[:6], due, spans))
        yield from ()

    def _wait(self, spans: list[int], us: np.ndarray, v: np.ndarray) -> int:
        """Put rows into their spans, split what has grown too long, and return the earliest bucket.

        A span is named after its first bucket or an earlier one and ends before the name of the next; the first also takes what is earlier.
        """
        order = np.argsort(us, kind="stable")
        us, v = us[order], v[order]
        bucket = us // (1000 * self.bucket_ms)
        names = spans or [int(bucket[0])]
        cuts = np.concatenate([[0], np.searchsorted(bucket, names[1:]), [len(us)]])
        fresh = []
        for name, lo, hi in zip(names, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            fresh.append(name)
            if lo == hi:
                continue
            old = self.waiting.getValue((name,)) if spans else ([], [])
            all_us, all_v = np.concatenate([np.array(old[0], np.int64), us[lo:hi]]), np.concatenate([np.array(old[1], float), v[lo:hi]])
            order = np.argsort(all_us, kind="stable")
            all_us, all_v = all_us[order], all_v[order]
            own, at = all_us // (1000 * self.bucket_ms), 0
            if own[0] < name:  # only in the first span: a later piece of it may need its name
                if spans:
                    self.waiting.removeKey((name,))
                fresh[-1] = int(own[0])
            while at < len(own):
                to = len(own)
                if to - at > SPAN:
                    # before the bucket of the row that is too many, or after it if nothing is before
                    to = int(np.searchsorted(own, own[at + SPAN]))
                    to = to if to > at else int(np.searchsorted(own, own[at], "right"))
                if at:
                    fresh.append(int(own[at]))
                self.waiting.updateValue((fresh[-1],), (all_us[at:to].tolist(), all_v[at:to].tolist()))
                at = to
        spans[:] = fresh
        return int(bucket[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() // self.bucket_ms * self.bucket_ms
        n, ring, open_i, open_us, last_us, used, due, spans = self.state.get() or NEW
        if used is not None and until <= used:
            return
        ring, spans, found, due = np.asarray(ring, float), list(spans), [], None
        while spans:
            us, v = (np.array(x, kind) for x, kind in zip(self.waiting.getValue((spans[0],)), (np.int64, float), strict=True))
            end = (us // (1000 * self.bucket_ms) + 1) * self.bucket_ms
            late = end > until
            if late.any():  # the rest of the span waits on
                due = int(end[late].min())
                if not late.all():
                    self.waiting.updateValue((spans[0],), (us[late].tolist(), v[late].tolist()))
            else:
                self.waiting.removeKey((spans.pop(0),))
            us, v = us[~late], v[~late]
            if not len(us):
                break
            order = np.lexsort((v, us))
            us, v = us[order], v[order]
            cf = ratio_from_ring(ring, v * v, self.n_sta, self.n_lta, self.floor)
            mark = np.where(cf > self.on, 1, np.where(cf < self.off, 0, -1))
            before = np.concatenate([[us[0] if last_us is None else last_us], us[:-1]])
            breaks = set(np.flatnonzero(us - before >= 1000 * self.silence_ms).tolist())
            known = np.flatnonzero(mark >= 0)
            turns = known[np.diff(mark[known], prepend=-1) != 0]  # only where the mark changes
            after = [int(known[np.searchsorted(known, j)]) for j in breaks if np.searchsorted(known, j) < len(known)]
            for j in sorted({*turns.tolist(), *breaks, *after}):
                if j in breaks and open_i is not None:
                    if n + j - open_i >= self.min_n:
                        found.append((open_i, n + j, open_us, int(before[j]), "silence"))
                    open_i = open_us = None
                if mark[j] == 1 and open_i is None:
                    open_i, open_us = n + j, int(us[j])
                elif mark[j] == 0 and open_i is not None:
                    if n + j - open_i >= self.min_n:
                        found.append((open_i, n + j, open_us, int(us[j]), "below"))
                    open_i = open_us = None
            n, last_us = n + len(us), int(us[-1])
            ring = np.concatenate([ring, v * v])[-max(1, self.n_lta - 1):]
            if due is not None:
                break
        if due is not None:
            self.handle.registerTimer(due)
        if open_i is not None:
            quiet = last_us // 1000 + self.silence_ms
            if until > quiet:
                if n - open_i >= self.min_n:
                    found.append((open_i, n, open_us, last_us, "silence"))
                open_i = open_us = None
            else:
                self.handle.registerTimer((quiet // self.bucket_ms + 1) * self.bucket_ms)
        self.state.update((n, ring.tolist(), open_i, open_us, last_us, until, due, spans))
        if found:
            yield self._frame(key, found)

    def close(self) -> None:
        pass


def stream_trigger(sdf: DataFrame, key: Sequence[str], n_sta: int, n_lta: int, on: float, off: float, min_n: int = 0,
                   watermark: str = "1 minute", silence_ms: int = 60_000, floor: float = 1e-20, value: str = "v",
                   ts: str = "ts", bucket_ms: int = 60_000) -> DataFrame:
    """Detections (key, on_i, off_i, t_on, t_off, closed_by) as they end.

    ``bucket_ms``: rows of a trace that become due together; a task holds a bucket of a
    trace, or up to ``SPAN`` rows of several.  Needs ``spark.sql.streaming.stateStore.providerClass``
    set to the RocksDB provider.
    """
    fields = [sdf.schema[k] for k in key]
    out = T.StructType([
        *fields, T.StructField("on_i", T.LongType()), T.StructField("off_i", T.LongType()),
        T.StructField("t_on", T.TimestampType()), T.StructField("t_off", T.TimestampType()), T.StructField("closed_by", T.StringType()),
    ])
    rows = sdf.select(*key, ts, value).withWatermark(ts, watermark)
    return rows.groupBy(*key).transformWithStateInPandas(
        _Trigger(list(key), n_sta, n_lta, on, off, min_n, floor, value, ts, silence_ms, bucket_ms), out, "Append", "EventTime"
    )
