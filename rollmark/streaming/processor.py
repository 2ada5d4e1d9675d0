"""Per-stream state for the live job: the same transitions as in batch, in event-time order.

Rows may come in any order within the stated lateness. They wait in the state, dealt to short spans
of event time, until the watermark has passed a span; then the span is sorted and folded. A timer
per span wakes the stream up, so a stream that falls silent is settled as well. With grace timeouts,
a timer per session in grace does the same, and the session ends when its grace does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rollmark.operators.chunked import Tally
from rollmark.operators.presence import CANDIDATE, GRACE, NOT_PRESENT, Rules, Tracker, advance_all, event_row, time_out
from rollmark.operators.temporal import STABLE, Holder

OUTPUT = (
    "stream_id STRING, frame_index BIGINT, event_seq INT, us BIGINT, identity STRING, event_type STRING, "
    "previous_state STRING, new_state STRING, reason STRING, started_us BIGINT, last_seen_us BIGINT, "
    "observation_count INT, interruption_count INT"
)
LATE = "LATE"
_COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]
_NULLABLE = dict.fromkeys(["frame_index", "started_us", "last_seen_us"], "Int64") | dict.fromkeys(
    ["observation_count", "interruption_count"], "Int32"
)
_FRAME = ["us", "frame_index", "identity", "best_candidate", "recognized", "quality_status"]


def evidence(window: list[list], candidate: str | None) -> tuple:
    """Leader, its weight, its share and the unknown weight of the last frames (identity, poor)."""
    votes = [name for name, poor in window if not poor]
    names = [name for name in votes if name is not None]
    if not names:
        return candidate, 0, 0.0, len(votes)
    leader = max(dict.fromkeys(names), key=names.count)
    return leader, names.count(leader), names.count(leader) / len(votes), len(votes) - len(names)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS).astype(_NULLABLE)


class PresenceProcessor(StatefulProcessor):
    """Smooths one stream and emits its presence events; rows older than the watermark come out as late."""

    def __init__(self, temporal: Mapping[str, float], presence: Mapping[str, float], span_ms: int, grace_timeout: bool) -> None:
        self.temporal = dict(temporal)
        self.rules = Rules.of(presence)
        self.gap = int(round(temporal["max_gap_seconds"] * 1e6))
        self.span_ms, self.grace_timeout = span_ms, grace_timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stream = handle.getValueState("stream", "state STRING")
        self.known = handle.getMapState("known", "identity STRING", "created BIGINT, last_state STRING")
        # spans that wait, with their number of parts, and the rows of each part
        self.spans = handle.getMapState("spans", "until BIGINT", "parts INT")
        self.waiting = handle.getMapState("waiting", "until BIGINT, part INT", "rows STRING")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Put rows aside, a part for each span and Arrow batch."""
        watermark = max(0, timerValues.getCurrentWatermarkInMs()) * 1000
        late = []
        for frames in rows:
            parts: dict[int, list] = {}
            for row in zip(*(frames[c].tolist() for c in _FRAME), strict=True):
                if row[0] < watermark:
                    late.append((key[0], row[1], 0, row[0], row[2], LATE, None, None, "older than the watermark", *[None] * 4))
                else:
                    parts.setdefault((row[0] // 1000 // self.span_ms + 1) * self.span_ms, []).append(row)
            for until, part in parts.items():
                number = self.spans.getValue((until,))[0] if self.spans.containsKey((until,)) else 0
                if not number:
                    self.handle.registerTimer(until)
                self.waiting.updateValue((until, number), (json.dumps(part),))
                self.spans.updateValue((until,), (number + 1,))
        yield _frame(late)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Fold all spans that are over, whichever timer it was; the other timers then find nothing left."""
        watermark = timerValues.getCurrentWatermarkInMs()
        over = sorted(until for (until,) in list(self.spans.keys()) if until <= watermark)
        state = json.loads(self.stream.get()[0]) if self.stream.exists() else {}
        live = {name: Tracker(**fields) for name, fields in state.get("live", {}).items()}
        for until in over:
            frames = []
            for part in range(self.spans.getValue((until,))[0]):
                frames += json.loads(self.waiting.getValue((until, part))[0])
                self.waiting.removeKey((until, part))
            self.spans.removeKey((until,))
            yield _frame(self._fold(key[0], sorted(frames, key=lambda f: (f[0], f[1])), state, live))
        ended = self._ended(key[0], watermark // self.span_ms * self.span_ms * 1000, state, live)
        if ended:
            yield _frame(ended)
        if over or ended:
            state["live"] = {n: asdict(t) for n, t in live.items()}
            self.stream.update((json.dumps(state),))
            if self.grace_timeout:
                for tracker in live.values():
                    if tracker.state == GRACE:
                        self.handle.registerTimer(-(-(tracker.lost_at + self.rules.grace) // 1000 // self.span_ms) * self.span_ms)

    def _fold(self, stream: str, frames: list[list], state: dict, live: dict[str, Tracker]) -> list[tuple]:
        holder, tally = Holder(**state.get("holder", {})), Tally(state.get("count", 0))
        window, last = state.get("window", []), state.get("last")
        out = []
        for now, frame, name, candidate, recognized, quality in frames:
            out += self._ended(stream, now, state, live)
            if last is not None and now - last > self.gap:
                holder, window = Holder(), []
                tally.set(0)
            last = now
            seen = name if recognized else None
            window = (window + [[seen, quality == "poor"]])[-int(self.temporal["window_size"]) :]
            verdict = holder.advance(seen, evidence(window, candidate), tally, self.temporal)
            active = (holder.stable or None) if verdict == STABLE else None
            created, before = self._known(active, frame, live) if active else (0, NOT_PRESENT)
            events = advance_all(live, active, created, now, self.rules)
            state["frame"], state["seq"] = frame, 0
            for seq, (who, tracker, event) in enumerate(events):
                if event[2] == CANDIDATE:
                    event = (event[0], before, *event[2:])
                elif event[2] in ("ABSENT", NOT_PRESENT):
                    self.known.updateValue((who,), (tracker.created, event[2]))
                out.append(event_row(stream, frame, seq, now, who, tracker, event, self.rules))
                state["seq"] = seq + 1
        state |= {"holder": asdict(holder), "count": tally.count, "window": window, "last": last}
        return out

    def _ended(self, stream: str, upto: int, state: dict, live: dict[str, Tracker]) -> list[tuple]:
        """Sessions whose grace is over by ``upto``; they follow the events of the frame before."""
        out = []
        for who, tracker, event, at in time_out(live, upto, self.rules) if self.grace_timeout else ():
            self.known.updateValue((who,), (tracker.created, event[2]))
            out.append(event_row(stream, state["frame"], state["seq"], at, who, tracker, event, self.rules))
            state["seq"] += 1
        return out

    def _known(self, name: str, frame: int, live: Mapping[str, Tracker]) -> tuple[int, str]:
        """When the identity was first stable in this stream, and its last idle state."""
        if name in live:
            return live[name].created, NOT_PRESENT
        if self.known.containsKey((name,)):
            created, last_state = self.known.getValue((name,))
            return created, last_state
        return frame, NOT_PRESENT

    def close(self) -> None:
        pass
