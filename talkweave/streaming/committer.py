"""Lookback-based commits of re-decoded segments: a batch fold and a stateful stream.

Each update of a session carries the segments of its latest window. Segments that end
before now - lookback (all, at the last update) and after what is committed are appended;
the text of a repeated segment isn't. State is what decides: the committed boundary and the last segment;
committed segments are emitted, not kept. Batch and stream share one walk over a session's updates, linear in their segments.

A stream may give sessions an idle time: one that stays silent for so long in event time, without a final update, is ended as if its latest
update had been final, and what is remembered of it goes. For that the latest update's segments are kept, which are those of one window.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LOOKBACK, SLACK, REPEAT_GAP = 1.0, 1e-6, 0.5
UPDATES = "session string, update_seq long, segments array<struct<start: double, end: double, text: string>>, window_start double, now_total double, final boolean, lookback double"
COMMITS = "session string, update_seq long, start double, end double, text string"


def cutoff(now: float, lookback: float, window_start: float, final: bool) -> float:
    """What ends after this waits. At or before the window's start it would hold back everything, so it is lifted."""
    usual = max(0.0, now - lookback)
    return now if final else float("inf") if usual <= window_start else usual


class Session:
    """What a session remembers between updates, and the walk over them."""

    def __init__(self, until: float = 0.0, last: str = "", last_end: float = 0.0, any_: bool = False) -> None:
        self.until, self.last, self.last_end, self.any = until, last, last_end, any_

    def commit(self, updates: pd.DataFrame) -> list[tuple]:
        """Newly committed segments of rows of UPDATES, by update_seq: (update_seq, start, end, text)."""
        out = []
        for u in updates.sort_values("update_seq", kind="stable").to_dict("records"):
            shift = float(u["window_start"])
            lookback = LOOKBACK if u["lookback"] is None or pd.isna(u["lookback"]) else float(u["lookback"])
            final = bool(u["final"]) if u["final"] is not None and not pd.isna(u["final"]) else False
            cut = cutoff(float(u["now_total"]), lookback, shift, final)
            segments = [] if u["segments"] is None else list(u["segments"])
            for end, start, _, text in sorted(((s["end"] or 0.0) + shift, (s["start"] or 0.0) + shift, i, s["text"] or "") for i, s in enumerate(segments)):
                if end > cut or end <= self.until + SLACK:
                    continue
                self.until = end
                if self.any and text.strip() == self.last.strip() and start - self.last_end <= REPEAT_GAP:
                    continue
                self.last, self.last_end, self.any = text, end, True
                out.append((u["update_seq"], start, end, text))
        return out


def committed(updates: DataFrame) -> DataFrame:
    """G1, G2 over all updates of a session: session, commits (array), text, duration."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        session = Session()
        commits = session.commit(pdf)
        rows = [dict(zip(("update_seq", "start", "end", "text"), c, strict=True)) for c in commits]
        return pd.DataFrame([(pdf["session"].iloc[0], rows, "".join(c[3] for c in commits).strip(), session.until)], columns=["session", "commits", "text", "duration"])

    item = "struct<update_seq: bigint, start: double, end: double, text: string>"
    return updates.groupBy("session").applyInPandas(run, f"session string, commits array<{item}>, text string, duration double")


class Committer(StatefulProcessor):
    """G1 for a stream: rows of one session in micro-batch order, by update_seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("committed", "until double, last string, last_end double, any boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        session = Session(*(self.state.get() if self.state.exists() else ()))
        out = [(key[0], *c) for c in session.commit(pd.concat(list(rows)))]
        self.state.update((session.until, session.last, session.last_end, session.any))
        yield pd.DataFrame(out, columns=["session", "update_seq", "start", "end", "text"])

    def close(self) -> None:
        pass


class ExpiringCommitter(StatefulProcessor):
    """G1, G3 with an end for sessions that never say final: a timer per session, moved on by every update."""

    def __init__(self, idle: float, event_time: str) -> None:
        self.idle, self.event_time = int(idle * 1000), event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("committed", "until double, last string, last_end double, any boolean, update string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        updates = pd.concat(list(rows)).sort_values("update_seq", kind="stable")
        known = self.state.get() if self.state.exists() else None
        session = Session(*(known[:4] if known else ()))
        out = [(key[0], *c) for c in session.commit(updates)]
        newest = updates.iloc[-1].to_dict()
        at = int(updates[self.event_time].max().timestamp() * 1000)
        kept = {c: newest[c] for c in ("update_seq", "window_start", "now_total", "lookback", "final")}
        kept = {c: None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for c, v in kept.items()}
        kept["segments"] = [(s["start"], s["end"], s["text"]) for s in (newest["segments"] if newest["segments"] is not None else [])]
        before = list(self.handle.listTimers())
        for timer in before:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max([at + self.idle, *before]))
        self.state.update((session.until, session.last, session.last_end, session.any, json.dumps(kept)))
        yield pd.DataFrame(out, columns=["session", "update_seq", "start", "end", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, last, last_end, any_, update = self.state.get()
        kept = json.loads(update)
        kept["segments"] = [dict(zip(("start", "end", "text"), x, strict=True)) for x in kept["segments"]]
        out = [] if kept["final"] else [(key[0], *c) for c in Session(until, last, last_end, any_).commit(pd.DataFrame([kept | {"final": True}]))]
        self.state.clear()
        yield pd.DataFrame(out, columns=["session", "update_seq", "start", "end", "text"])

    def close(self) -> None:
        pass


def commit_stream(updates: DataFrame, idle: float | None = None, event_time: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """Newly committed segments of a stream of updates (append as they come). Needs the RocksDB state store.

    idle: seconds of event time after which a silent session ends; event_time: the updates' column of it; delay: how late updates may come
    (later ones are dropped, as Spark does)."""
    if idle is None:
        return updates.groupBy("session").transformWithStateInPandas(Committer(), COMMITS, outputMode="update", timeMode="none")
    timed = updates.where(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
    return timed.groupBy("session").transformWithStateInPandas(ExpiringCommitter(idle, event_time), COMMITS, outputMode="update", timeMode="eventTime")
