"""Run logs as live streams with a state per run that expires by itself.

Every operator keeps a few values per run in the state store and touches only the runs of a batch,
so what a batch costs does not grow with the history. A run that has not been seen for ``ttl``
loses its state and starts afresh if it comes back. Rows of a run must come in order from batch to
batch; within a batch any order will do. The rows that one run adds in one batch are sorted in one
task; a long backlog of a single run is better worked by ``logs.Carried``, which spreads it over
tasks and keeps state for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000


def _sorted(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """The batch's rows of one key in order."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


def _fields(df: DataFrame, *names: str) -> str:
    """Schema text of columns; such that begin with an underscore lose their name on the way to Python."""
    hidden = [n for n in names if n.startswith("_")]
    if hidden:
        raise ValueError(f"rename columns that begin with an underscore: {', '.join(hidden)}")
    kinds = dict(df.dtypes)
    return ", ".join(f"{n} {kinds[n]}" for n in names)


def _plain(x: Any) -> Any:
    """A NumPy value as Python has it, missing as None."""
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
        return None
    return x.item() if hasattr(x, "item") else x


class _TopStep(StatefulProcessor):
    """Largest step so far, one value."""

    def __init__(self, by: str, order: str, step: str, state: str, ttl: int | None) -> None:
        self.by, self.order, self.step, self.schema, self.ttl = by, order, step, state, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", self.schema, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = _sorted(rows, self.order)
        before = self.top.get() if self.top.exists() else None
        steps = d[self.step].cummax()
        steps = steps.ffill()
        if before is not None:
            steps = steps.fillna(before[0]).clip(lower=before[0])
        if len(steps) and pd.notna(steps.iloc[-1]):
            self.top.update((int(steps.iloc[-1]),))
        yield pd.DataFrame({self.by: [key[0]] * len(d), self.order: d[self.order], self.step: steps.astype("Int64")})

    def close(self) -> None:
        """Nothing is held outside the state store."""


def monotonic_step(df: DataFrame, by: str, order: str, step: str, ttl: int | None = None) -> DataFrame:
    """Steps that never go back; a run unseen for ``ttl`` milliseconds starts at its own next step.

    Null steps take the largest before them, null at the start of a run.
    """
    out = _fields(df, by, order, step)
    work = _TopStep(by, order, step, "top long", ttl)
    return df.select(by, order, step).groupBy(by).transformWithStateInPandas(work, out, "append", "processingTime")


class _Patience(StatefulProcessor):
    """Best value per source as a map, evaluations since the last best as a value."""

    def __init__(self, by: str, step: str, source: str, value: str, n: int, min_steps: int, key: str, ttl: int | None) -> None:
        self.by, self.step, self.source, self.value = by, step, source, value
        self.n, self.min_steps, self.key, self.ttl = n, min_steps, key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getMapState("best", self.key, "value double", self.ttl)
        self.since = handle.getValueState("since", "n long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows), ignore_index=True)
        v = d[self.value].astype(float)
        low = v.where(np.isfinite(v))  # a value that is no number is no smaller
        per = low.groupby([d[self.step], d[self.source]], dropna=False).min().rename("low").reset_index()
        per = per.sort_values(self.step, kind="stable")
        bar = per.groupby(self.source, dropna=False)["low"].transform(lambda x: x.cummin().ffill().shift())
        names = [None if pd.isna(x) else _plain(x) for x in per[self.source].unique()]
        held = {n: self.best.getValue((n,))[0] for n in names if self.best.containsKey((n,))}
        before = per[self.source].map({n: x for n, x in held.items() if n is not None}).astype(float)
        if None in held:
            before = before.where(per[self.source].notna(), held[None])
        bar = np.fmin(bar.astype(float), before).fillna(np.inf)
        hits = (per["low"] < bar).groupby(per[self.step]).any().sort_index()
        # evaluations since the last hit, or since the state's last one
        hit, at = hits.to_numpy(bool), np.arange(len(hits))
        last = np.maximum.accumulate(np.where(hit, at, -1))
        since = np.where(last >= 0, at - last, at + 1 + (self.since.get()[0] if self.since.exists() else 0))
        lowest = per.groupby(self.source, dropna=False)["low"].min()
        for name, x in zip(lowest.index, lowest):
            name = None if pd.isna(name) else _plain(name)
            x = np.fmin(x, held.get(name, np.nan))
            if np.isfinite(x):  # also if it is no better: seen, so not to expire
                self.best.updateValue((name,), (float(x),))
        self.since.update((int(since[-1]),))
        step = hits.index.to_numpy()
        stop = (self.n > 0) & (step >= self.min_steps) & (since >= self.n)
        out = {self.by: [key[0]] * len(hits), self.step: step.astype("int64"), "improved": hit, "since": since.astype("int64"), "stop": stop}
        yield pd.DataFrame(out)

    def close(self) -> None:
        """Nothing is held outside the state store."""


def early_stop(
    df: DataFrame, by: str, step: str, source: str, value: str, n: int, min_steps: int = 0, ttl: int | None = None
) -> DataFrame:
    """Per evaluation of a run: improved, evaluations since, stop.

    All rows of one evaluation must come in one batch, as one log line does. Rows without a step are
    no evaluation.
    """
    _fields(df, step, value)
    out = f"{_fields(df, by)}, {step} long, improved boolean, since long, stop boolean"
    work = _Patience(by, step, source, value, n, min_steps, _fields(df, source), ttl)
    rows = df.select(by, step, source, value).where(F.col(step).isNotNull())
    return rows.groupBy(by).transformWithStateInPandas(work, out, "append", "processingTime")


class _Newest(StatefulProcessor):
    """Newest time of a run, one value."""

    def __init__(self, by: str, order: str, time: str, delay: int, ttl: int | None) -> None:
        self.by, self.order, self.time, self.delay, self.ttl = by, order, time, delay, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "time long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        d = _sorted(rows, self.order)
        held = self.newest.get()[0] if self.newest.exists() else None
        top = d[self.time].astype("Int64").cummax().ffill()
        before = top.shift()
        if held is not None:
            before = before.fillna(held).clip(lower=held)
        late = (d[self.time].astype("Int64") < before - self.delay).fillna(False).astype(bool)
        last = [x for x in (held, _plain(top.iloc[-1]) if pd.notna(top.iloc[-1]) else None) if x is not None]
        if last:
            self.newest.update((int(max(last)),))
        yield pd.DataFrame({self.by: [key[0]] * len(d), self.order: d[self.order], self.time: d[self.time], "late": late})

    def close(self) -> None:
        """Nothing is held outside the state store."""


def with_late_side(df: DataFrame, by: str, order: str, time: str, delay: int, ttl: int | None = None) -> DataFrame:
    """Adds ``late`` instead of dropping rows: more than ``delay`` behind the newest before it.

    ``time`` is a long; a null time is not late.
    """
    out = f"{_fields(df, by, order, time)}, late boolean"
    work = _Newest(by, order, time, delay, ttl)
    return df.select(by, order, time).groupBy(by).transformWithStateInPandas(work, out, "append", "processingTime")


class _Stale(StatefulProcessor):
    """Newest time of a track and one timer, moved whenever the track is seen."""

    def __init__(self, by: str, time: str, limit_ms: int) -> None:
        self.by, self.time, self.limit = by, time, limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us long, due long", None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a batch without data may come as a frame without columns
        times = [f[self.time] for f in rows if self.time in f.columns]
        newest = max((int(t.max()) for t in times if t.notna().any()), default=None)
        held = self.seen.get() if self.seen.exists() else None
        if newest is not None and (held is None or newest > held[0]):
            if held is not None:
                self.handle.deleteTimer(held[1])
            # a timer fires when the watermark is past it
            due = newest // 1000 + self.limit
            self.seen.update((newest, due))
            self.handle.registerTimer(due)
        yield pd.DataFrame({self.by: [], "last_us": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        self.seen.clear()
        yield pd.DataFrame({self.by: [key[0]], "last_us": [last]})

    def close(self) -> None:
        """Nothing is held outside the state store."""


def stale(df: DataFrame, by: str, time: str, limit_ms: int, delay: str) -> DataFrame:
    """(by, last_us) of each track once nothing was seen of it for ``limit_ms`` of event time.

    The clock is the watermark: ``delay`` behind the newest ``time`` of the stream. A track that is
    stale loses its state; if it comes back it can become stale again.
    """
    # the watermark first: a column made before it loses its name on the way to the state
    d = df.withWatermark(time, delay).select(by, time, F.unix_micros(time).alias("seen_us"))
    work = _Stale(by, "seen_us", limit_ms)
    out = f"{_fields(df, by)}, last_us long"
    return d.groupBy(by).transformWithStateInPandas(work, out, "append", "eventTime")


class _PerfWindows(StatefulProcessor):
    """Sums of the windows that a run may still add to."""

    def __init__(self, by: str, step: str, seconds: str, memory: str, every: int, open_windows: int, ttl: int | None) -> None:
        self.by, self.step, self.seconds, self.memory = by, step, seconds, memory
        self.every, self.open, self.ttl = every, open_windows, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getMapState("sums", "window long", "last long, total double, n long, peak double", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for d in rows:  # one frame at a time: the order of steps does not matter here
            d = d[d[self.step].notna()]
            w = ((d[self.step] - 1) // self.every).astype("int64").rename("window")
            s = d[self.seconds].astype(float)
            parts.append(
                pd.DataFrame({"last": d[self.step].astype("int64"), "total": s, "n": s.notna().astype("int64"), "peak": d[self.memory].astype(float)})
                .groupby(w).agg({"last": "max", "total": "sum", "n": "sum", "peak": "max"})
            )
        new = pd.concat(parts).groupby(level=0).agg({"last": "max", "total": "sum", "n": "sum", "peak": "max"})
        held = {k[0]: v for k, v in self.sums.iterator()}  # the few windows that are open
        for window in new.index.intersection(list(held)):
            last, total, n, peak = held[window]
            at = new.loc[window]
            peaks = [x for x in (_plain(float(at["peak"])), peak) if x is not None]
            new.loc[window, "last"] = max(int(new.at[window, "last"]), last)
            new.loc[window, "total"] = float(at["total"]) + total
            new.loc[window, "n"] = int(new.at[window, "n"]) + n
            new.loc[window, "peak"] = max(peaks, default=np.nan)
        # only windows that stay open meet the store, each a call of its own
        oldest = max([*held, *new.index[-1:]], default=0) - self.open
        for window, last, total, n, peak in new[new.index > oldest].itertuples():
            self.sums.updateValue((int(window),), (int(last), float(total), int(n), _plain(float(peak))))
        for window in [w for w in held if w <= oldest]:
            self.sums.removeKey((window,))
        yield pd.DataFrame(
            {
                self.by: [key[0]] * len(new), "window": new.index, "last_step": new["last"].to_numpy(),
                "step_s": (new["total"] / new["n"].where(new["n"] > 0)).to_numpy(), "n": new["n"].to_numpy(), "peak_mem": new["peak"].to_numpy(),
            }
        )

    def close(self) -> None:
        """Nothing is held outside the state store."""


def perf_windows(
    df: DataFrame, by: str, step: str, seconds: str, memory: str, every: int = 50, open_windows: int = 2, ttl: int | None = None
) -> DataFrame:
    """Seconds per step and peak memory of windows of ``every`` steps, each time a batch adds to one.

    A run keeps its last ``open_windows`` windows; rows for older ones would start them anew, so they
    must not come. The newest row of a window is its result: see :class:`Upserts`.
    """
    _fields(df, step, seconds, memory)
    out = f"{_fields(df, by)}, window long, last_step long, step_s double, n long, peak_mem double"
    work = _PerfWindows(by, step, seconds, memory, every, open_windows, ttl)
    return df.select(by, step, seconds, memory).groupBy(by).transformWithStateInPandas(work, out, "update", "processingTime")
