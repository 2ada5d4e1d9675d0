"""Presence events and sessions from stabilised frames.

Each identity of a stream has a ``Tracker`` while it is a candidate, present or in grace.
Only those few are kept: an idle identity carries no state, so a frame costs as many steps
as identities were seen within the last grace period or entry window. Silence alone ends
nothing; sessions close on a later frame, as the rules demand.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rollmark.functions.scalars import is_active, seconds_between, session_key
from rollmark.operators.chunked import CHUNK_ROWS, Tally, chunked_scan
from rollmark.operators.ordering import ROWS_PER_CELL, cut, neighbour
from rollmark.session import broadcast_if_small, materialize

#: States, event types and reasons.
NOT_PRESENT, CANDIDATE, PRESENT, GRACE, ABSENT = "NOT_PRESENT", "CANDIDATE", "PRESENT", "GRACE", "ABSENT"
CHANGED, ENTERED, UPDATED = "STATE_CHANGED", "ENTRY_CONFIRMED", "PRESENCE_UPDATED"
LOST, RESUMED, ENDED = "GRACE_STARTED", "PRESENCE_RESUMED", "SESSION_ENDED"
REASONS = {
    "first": "first stable identity observation recorded; entering candidate confirmation",
    "entered": "stable identity observed for {min_entry_observations} frames in {entry_window_seconds}s window",
    "expired": "entry window expired without sufficient stable observations",
    "updated": "presence confirmed with ongoing stable observations",
    "lost": "stable observation lost; grace timer started ({grace_period_seconds}s allowance)",
    "resumed": "identity reappeared before grace period expiration; session resumed",
    "absent": "identity absent beyond configured grace period ({grace_period_seconds}s)",
    "longest": "maximum session duration safeguard reached ({max_session_duration_seconds}s)",
}


@dataclass
class Rules:
    """Presence settings with durations in microseconds and the reason texts filled in."""

    entries: int
    window: int
    grace: int
    longest: int
    reasons: dict[str, str]

    @classmethod
    def of(cls, settings: Mapping[str, float]) -> Rules:
        micros = {k: int(round(v * 1e6)) for k, v in settings.items() if k.endswith("_seconds")}
        return cls(
            int(settings["min_entry_observations"]),
            micros["entry_window_seconds"],
            micros["grace_period_seconds"],
            micros["max_session_duration_seconds"],
            {k: text.format(**settings) for k, text in REASONS.items()},
        )


@dataclass
class Tracker:
    """One identity that is a candidate, present or in grace. Times are microseconds."""

    created: int
    state: str = CANDIDATE
    entries: list[int] = field(default_factory=list)
    lost_at: int = 0
    started: int = 0
    last_seen: int = 0
    seen: int = 0
    interruptions: int = 0

    def advance(self, here: bool, now: int, rules: Rules) -> tuple[str, str, str, str] | None:
        """Take one frame; the event is (type, previous state, new state, reason key)."""
        before = self.state
        if before == CANDIDATE:
            return self._confirm(now, rules) if here else self._doubt(now, rules)
        if now - self.started >= rules.longest:
            return self.close("longest")
        if here:
            self.last_seen = now
            self.seen += 1
            self.state = PRESENT
            if before == PRESENT:
                return UPDATED, PRESENT, PRESENT, "updated"
            self.interruptions += 1
            return RESUMED, GRACE, PRESENT, "resumed"
        if before == PRESENT:
            self.state = GRACE
            self.lost_at = now
            return LOST, PRESENT, GRACE, "lost"
        return self.close("absent") if now - self.lost_at >= rules.grace else None

    def _confirm(self, now: int, rules: Rules):
        self.entries = [t for t in self.entries if t >= now - rules.window] + [now]
        if len(self.entries) < rules.entries:
            return None
        self.state = PRESENT
        self.started = self.last_seen = now
        self.seen, self.entries = len(self.entries), []
        return ENTERED, CANDIDATE, PRESENT, "entered"

    def _doubt(self, now: int, rules: Rules):
        if now - self.entries[0] <= rules.window:
            return None
        self.state = NOT_PRESENT
        return CHANGED, CANDIDATE, NOT_PRESENT, "expired"

    def close(self, reason: str) -> tuple[str, str, str, str]:
        before, self.state = self.state, ABSENT
        return ENDED, before, ABSENT, reason


def time_out(live: dict[str, Tracker], upto: int, rules: Rules) -> list[tuple[str, Tracker, tuple, int]]:
    """Close what has been in grace for the whole period by ``upto``; the last part is when that was so."""
    over = sorted((t.lost_at + rules.grace, t.created, n) for n, t in live.items() if t.state == GRACE and t.lost_at + rules.grace <= upto)
    return [(name, live[name], live.pop(name).close("absent"), at) for at, _, name in over]


def advance_all(
    live: dict[str, Tracker], active: str | None, created: int, now: int, rules: Rules
) -> Iterator[tuple[str, Tracker, tuple]]:
    """One frame for every live identity: the active one first, then the others as created."""
    if active is not None:
        tracker = live.get(active)
        if tracker is None:
            tracker = live[active] = Tracker(created, entries=[now])
            yield active, tracker, (CHANGED, NOT_PRESENT, CANDIDATE, "first")
        else:
            event = tracker.advance(True, now, rules)
            if event:
                yield active, tracker, event
    for name in sorted((n for n in live if n != active), key=lambda n: live[n].created):
        event = live[name].advance(False, now, rules)
        if event:
            yield name, live[name], event
    for name in [n for n, t in live.items() if t.state in (NOT_PRESENT, ABSENT)]:
        del live[name]


EVENT_FIELDS = [
    T.StructField("stream_id", T.StringType()),
    T.StructField("frame_index", T.LongType()),
    T.StructField("event_seq", T.IntegerType()),
    T.StructField("_us", T.LongType()),
    T.StructField("identity", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("previous_state", T.StringType()),
    T.StructField("new_state", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("_started", T.LongType()),
    T.StructField("_last_seen", T.LongType()),
    T.StructField("observation_count", T.IntegerType()),
    T.StructField("interruption_count", T.IntegerType()),
]
_FOLDED = T.StructType([T.StructField("mode", T.StringType()), *EVENT_FIELDS])


def event_row(stream: str, frame: int, seq: int, now: int, name: str, tracker: Tracker, event: tuple, rules: Rules):
    kind, before, after, reason = event
    session = (tracker.started, tracker.last_seen, tracker.seen, tracker.interruptions)
    in_session = session if kind != CHANGED else (None, None, None, None)
    return (stream, frame, seq, now, name, kind, before, after, rules.reasons.get(reason, reason), *in_session)


def _presence_fold(policies: Mapping[str, Rules]):
    """All policies advance on a chunk together; the state has the live trackers of each."""

    def fold(pdf: pd.DataFrame, state: dict | None, tally: Tally, emit: bool):
        rows, left = [], {}
        columns = ("stream_id", "frame_index", "_us", "active", "created")
        frames = [pdf[c].tolist() for c in columns]
        for mode, rules in policies.items():
            live = {name: Tracker(**fields) for name, fields in (state or {}).get(mode, {}).items()}
            for stream, frame, now, active, created in zip(*frames, strict=True):
                if active is None and not live:
                    continue
                for seq, (name, tracker, event) in enumerate(advance_all(live, active, created, now, rules)):
                    if emit:
                        rows.append((mode, *event_row(stream, frame, seq, now, name, tracker, event, rules)))
            if live:
                left[mode] = {name: asdict(tracker) for name, tracker in live.items()}
        out = pd.DataFrame(rows, columns=_FOLDED.fieldNames()).astype(_NULLABLE) if emit else None
        return out, left

    return fold


_NEVER = 1 << 62


class PresenceTables:
    """What a chunk makes of an identity that is present or in grace when it begins.

    Such a session either lasts through the chunk, and then leaves it with its own start and with counts
    that are its entry's and a few more, or ends in it, and what follows doesn't depend on it any more.
    Both hold as long as the session doesn't reach its longest duration, and for one in grace, if it
    isn't over before the identity is seen. Identities that aren't seen in the chunk need its first and
    last time only. What isn't covered (candidates, longest sessions) runs again.
    """

    def __init__(self, policies: Mapping[str, Rules]) -> None:
        self.policies = dict(policies)

    def table(self, rows: pd.DataFrame) -> dict:
        times, active = rows["_us"].tolist(), rows["active"].tolist()
        created = dict(zip(active, rows["created"].tolist(), strict=True))
        places: dict[str, list[int]] = {}
        for place, name in enumerate(active):
            if name is not None:
                places.setdefault(name, []).append(place)
        modes = {}
        for mode, rules in self.policies.items():
            modes[mode] = {
                name: {state: self._through(times, here, state, created[name], rules) for state in (PRESENT, GRACE)}
                for name, here in places.items()
            }
        return {"first": times[0], "last": times[-1], "modes": modes}

    def _through(self, times: list[int], here: list[int], state: str, created: int, rules: Rules) -> dict:
        """How a session that is ``state`` at the start goes on; its start and grace are open."""
        tracker = Tracker(created, state, lost_at=_NEVER, started=_NEVER)
        first = here[0]
        out = {"waits": times[first - 1] if state == GRACE and first else None, "ends": None, "then": None}
        at = first if state == GRACE else 0
        live: Tracker | None = tracker
        turn = 0
        while at < len(times):
            while turn < len(here) and here[turn] < at:
                turn += 1
            seen = turn < len(here) and here[turn] == at
            if live is None:
                if turn == len(here):
                    break
                at = here[turn]
                live = Tracker(created, entries=[times[at]])
                at += 1
                continue
            live.advance(seen, times[at], rules)
            if live.state in (NOT_PRESENT, ABSENT):
                if live is tracker:
                    out["ends"] = times[at]
                live = None
                at += 1
                continue
            at = self._next(live, times, at + 1, here[turn + seen] if turn + seen < len(here) else len(times), rules)
        if live is tracker:
            out["through"] = asdict(tracker)
        elif live is not None:
            out["then"] = asdict(live)
        return out

    def _next(self, live: Tracker, times: list[int], at: int, seen: int, rules: Rules) -> int:
        """The next frame that can change anything: one that shows the identity, or at which a period is over."""
        if live.state == PRESENT:
            return at
        if live.state == GRACE:
            over = min(live.lost_at + rules.grace, live.started + rules.longest)
        else:
            over = live.entries[0] + rules.window + 1
        return min(seen, bisect_left(times, over, at))

    def leave(self, table: dict, empty_exit: dict, entry: dict, ran: tuple[dict, dict]) -> tuple[dict, bool]:
        """Identities don't act on each other, so each is looked up on its own."""
        out, certain = {}, True
        for mode, rules in self.policies.items():
            alone, before, behind = (d.get(mode, {}) for d in (empty_exit, *ran))
            live = dict(alone)
            for name, fields in entry.get(mode, {}).items():
                known = table["modes"][mode].get(name)
                if known is None:
                    found = self._unseen(fields, table["first"], table["last"], rules)
                else:
                    found = self._seen(fields, known, alone.get(name, {}), table["last"], rules)
                if found is None:
                    certain &= before.get(name) == fields
                    found = (behind if name in before else alone).get(name)
                live.pop(name, None)
                if found:
                    live[name] = found
            if live:
                out[mode] = live
        return out, certain

    def _unseen(self, fields: dict, first: int, last: int, rules: Rules) -> dict:
        """State behind frames without the identity, empty if it is idle then."""
        if fields["state"] == CANDIDATE:
            return {} if last - fields["entries"][0] > rules.window else fields
        lost = first if fields["state"] == PRESENT else fields["lost_at"]
        if last - lost >= rules.grace or last - fields["started"] >= rules.longest:
            return {}
        return fields | {"state": GRACE, "lost_at": lost}

    def _seen(self, fields: dict, known: dict, alone: dict, last: int, rules: Rules) -> dict | None:
        """State behind frames with the identity; ``alone`` if it is idle at first."""
        if fields["state"] == CANDIDATE:
            waits = known[GRACE]["waits"]
            return alone if waits is not None and waits - fields["entries"][0] > rules.window else None
        way = known[fields["state"]]
        until = last if way["ends"] is None else way["ends"]
        if until - fields["started"] >= rules.longest:
            return None
        if way["waits"] is not None and way["waits"] - fields["lost_at"] >= rules.grace:
            return None
        if way["ends"] is not None:
            return way["then"] or {}
        made = way["through"]
        lost = fields["lost_at"] if made["lost_at"] == _NEVER else made["lost_at"]
        counts = {c: fields[c] + made[c] for c in ("seen", "interruptions")}
        return fields | counts | {"state": made["state"], "last_seen": made["last_seen"], "lost_at": lost}


#: Pandas types that keep NULL integers apart from floats.
_NULLABLE = {
    "_started": "Int64",
    "_last_seen": "Int64",
    "observation_count": "Int32",
    "interruption_count": "Int32",
}


def presence_events(
    stabilised: DataFrame,
    settings: Mapping[str, float],
    chunk_rows: int = CHUNK_ROWS,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Presence events of all identities of every stream, written once to the checkpoint folder."""
    return presence_events_by_policy(stabilised, {"": settings}, chunk_rows, rows_per_cell).drop("mode")


def presence_events_by_policy(
    stabilised: DataFrame,
    policies: Mapping[str, Mapping[str, float]],
    chunk_rows: int = CHUNK_ROWS,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Presence events under several policies, told apart by ``mode``, from one fold over the frames.

    A frame counts for its stable identity only while the state is stable. ``created``, the
    first such frame of an identity, orders the events inside a frame.
    """
    active = F.when(F.col("is_stable"), F.col("stable_identity"))
    frames = materialize(
        stabilised.select(
            "stream_id", "frame_index", F.unix_micros("ts").alias("_us"), F.nullif(active, F.lit("")).alias("active")
        )
    )
    first = (
        frames.where(F.col("active").isNotNull())
        .groupBy("stream_id", "active")
        .agg(F.min("frame_index").alias("created"))
    )
    placed = frames.join(broadcast_if_small(first), ["stream_id", "active"], "left").select(
        "stream_id",
        F.floor((F.col("frame_index") - 1) / F.lit(chunk_rows)).cast("bigint").alias("_chunk"),
        "frame_index",
        "_us",
        "active",
        F.coalesce("created", F.lit(0)).alias("created"),
    )
    several = not frames.where(F.col("frame_index") > chunk_rows).isEmpty()
    rules = {mode: Rules.of(settings) for mode, settings in policies.items()}
    tables = PresenceTables(rules)
    folded = materialize(chunked_scan(placed, "stream_id", "frame_index", _presence_fold(rules), _FOLDED, several, tables=tables))
    return with_previous_states(folded, rows_per_cell)


def with_previous_states(folded: DataFrame, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """Finish raw events: session keys, times, and what state a new candidate came from.

    The event before a candidacy of the same identity, if any, closed a session or an
    earlier candidacy, so its new state is the candidate's previous one; only these events are sorted.
    """
    idle = F.col("new_state").isin(CANDIDATE, NOT_PRESENT, ABSENT)
    rows = cut(folded.where(idle), ["mode", "stream_id", "identity"], "frame_index", rows_per_cell)
    near = neighbour(rows, {"_before": "new_state"}, following=False).df.select(*folded.columns, "_before")
    near = near.unionByName(folded.where(~idle).withColumn("_before", F.lit(None).cast("string")))
    started = F.timestamp_micros("_started")
    candidacy = F.col("new_state") == CANDIDATE
    return near.select(
        "mode",
        "stream_id",
        "frame_index",
        "event_seq",
        F.timestamp_micros("_us").alias("ts"),
        "identity",
        "event_type",
        F.when(candidacy, F.coalesce("_before", F.lit(NOT_PRESENT))).otherwise(F.col("previous_state")).alias(
            "previous_state"
        ),
        "new_state",
        F.when(
            F.col("_started").isNotNull(), session_key(F.col("stream_id"), F.col("identity"), started)
        ).alias("session_id"),
        "reason",
        started.alias("started_at"),
        F.timestamp_micros("_last_seen").alias("last_seen_at"),
        "observation_count",
        "interruption_count",
    )


def closed_sessions(events: DataFrame) -> DataFrame:
    """One row per finished session, from its closing event."""
    return events.where(F.col("event_type") == ENDED).select(
        "session_id",
        "stream_id",
        "identity",
        "started_at",
        "last_seen_at",
        F.col("ts").alias("ended_at"),
        F.lit(ABSENT).alias("state"),
        seconds_between(F.col("started_at"), F.col("ts")).alias("duration_seconds"),
        "observation_count",
        "interruption_count",
        "reason",
    )


def open_sessions(events: DataFrame) -> DataFrame:
    """Sessions without a closing event as of their latest event."""
    last = F.max_by(
        F.struct(
            "stream_id",
            "identity",
            "started_at",
            "last_seen_at",
            F.col("ts").alias("as_of"),
            F.col("new_state").alias("state"),
            "observation_count",
            "interruption_count",
        ),
        F.struct("frame_index", "event_seq"),
    )
    latest = events.where("session_id IS NOT NULL").groupBy("session_id").agg(last.alias("_s")).select("session_id", "_s.*")
    still = latest.where(is_active(F.col("state"), F.lit(None)))
    return still.select(
        "session_id",
        "stream_id",
        "identity",
        "started_at",
        "last_seen_at",
        F.lit(None).cast("timestamp").alias("ended_at"),
        "state",
        seconds_between(F.col("started_at"), F.col("as_of")).alias("duration_seconds"),
        "observation_count",
        "interruption_count",
        F.col("as_of").alias("state_since"),
    )


def grace_sweep(open_sessions_df: DataFrame, at: Column, settings: Mapping[str, float]) -> DataFrame:
    """Sessions that a sweep at a given time would end: in grace for the whole period."""
    rules = Rules.of(settings)
    over = (F.col("state") == GRACE) & (F.unix_micros(at) - F.unix_micros("state_since") >= rules.grace)
    return _ended(open_sessions_df.where(over), at, rules.reasons["absent"])


def stop_sessions(open_sessions_df: DataFrame, at: Column, reason: str = "runtime_shutdown") -> DataFrame:
    """Close every open session at a given time."""
    return _ended(open_sessions_df, at, f"session closed due to {reason}")


def _ended(sessions: DataFrame, at: Column, reason: str) -> DataFrame:
    return sessions.drop("state_since").withColumns(
        {
            "ended_at": at,
            "state": F.lit(ABSENT),
            "duration_seconds": seconds_between(F.col("started_at"), at),
            "reason": F.lit(reason),
        }
    )


def identity_states(identities: DataFrame, events: DataFrame) -> DataFrame:
    """Presence state of the asked identities in every stream that has events of them.

    An identity without events is NOT_PRESENT, with a NULL stream.
    """
    last = (
        events.groupBy("stream_id", "identity")
        .agg(
            F.max_by(F.struct("new_state", "session_id"), F.struct("ts", "frame_index", "event_seq")).alias("_s"),
        )
        .select("stream_id", "identity", "_s.*")
    )
    open_now = F.col("new_state").isin(PRESENT, GRACE)
    return identities.join(last, "identity", "left").select(
        "stream_id",
        "identity",
        F.coalesce("new_state", F.lit(NOT_PRESENT)).alias("state"),
        F.when(open_now, F.col("session_id")).alias("active_session_id"),
    )


def session_counts(closed: DataFrame, still_open: DataFrame) -> DataFrame:
    """Number of active and archived sessions."""
    flags = closed.select(F.lit(False).alias("active")).unionByName(still_open.select(F.lit(True).alias("active")))
    return flags.agg(F.count_if("active").alias("active_sessions"), F.count_if(~F.col("active")).alias("archived_sessions"))


def entry_counts(stable_frames: DataFrame, window_seconds: float) -> DataFrame:
    """Stable sightings of each identity within the trailing window of every sighting.

    Time is cut into spans of several windows; rows of the last window of a span are copied
    to the next one, so a window never needs more than one (stream, identity, span) group.
    A sighting adds one when it comes and takes it back when its window is over; the running
    sum of these steps is the count, so the work doesn't grow with the sightings of a window.
    """
    window = int(round(window_seconds * 1e6))
    span = max(1, 16 * window)  # a window of no length counts sightings of the same moment
    us = F.unix_micros("ts")
    home = F.floor(us / F.lit(span)).cast("bigint")
    late = F.pmod(us, F.lit(span)) >= F.lit(span - window)
    copies = F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home)))
    spread = stable_frames.withColumn("_us", us).withColumn("_home", home).select("*", copies.alias("_span"))
    comes = F.struct(F.col("_us").alias("at"), F.lit(1).alias("step"))
    goes = F.struct((F.col("_us") + window + 1).alias("at"), F.lit(-1).alias("step"))
    steps = spread.withColumn("_step", F.explode(F.array(comes, goes))).withColumn("_at", F.col("_step.at"))
    upto = Window.partitionBy("stream_id", "identity", "_span").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    counted = steps.withColumn("entries_in_window", F.sum("_step.step").over(upto))
    return counted.where("_span = _home AND _step.step = 1").drop("_us", "_home", "_span", "_step", "_at")
