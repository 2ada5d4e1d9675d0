"""Smoothing and presence against hand sequences and a plain model written from the rules."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rollmark.operators import presence as pre
from rollmark.operators import temporal as tem
from rollmark.policies import PRESENCE, TEMPORAL, preset

START = datetime(2026, 8, 17, 10, 0, 0, tzinfo=timezone.utc)
OBS = (
    "stream_id STRING, frame_index BIGINT, ts TIMESTAMP, identity STRING, best_candidate STRING, similarity DOUBLE, "
    "recognized BOOLEAN, quality_status STRING"
)
STABLE = "stream_id STRING, frame_index BIGINT, ts TIMESTAMP, stable_identity STRING, is_stable BOOLEAN"
BALANCED = preset(TEMPORAL)


def observe(spark, frames, stream="s", step=0.1):
    """Frames: name, None for unknown, (name, 'poor'), or ('+', seconds) for a pause."""
    rows, at = [], 0.0
    for frame in frames:
        if isinstance(frame, tuple) and frame[0] == "+":
            at += frame[1]
            continue
        name, quality = frame if isinstance(frame, tuple) else (frame, "good")
        rows.append(
            (stream, len(rows) + 1, START + timedelta(seconds=at), name, name or "Alice", 0.8 if name else 0.1, name is not None, quality)
        )
        at += step
    return spark.createDataFrame(rows, OBS)


def states(spark, frames, settings=BALANCED):
    rows = tem.stabilise(observe(spark, frames), settings).orderBy("frame_index").collect()
    return [(r.state, r.stable_identity) for r in rows], rows


A4 = ["Alice"] * 4


def test_settles_on_the_fourth_frame(spark):
    got, rows = states(spark, A4)
    assert [s for s, _ in got] == ["unstable"] * 3 + ["stable"]
    assert rows[3].consecutive_stable_count == 4 and rows[3].confidence_score == 1.0


def test_unknowns_are_absorbed_then_expire(spark):
    got, _ = states(spark, A4 + [None] * 4)
    assert got[4:] == [("stable", "Alice")] * 3 + [("unknown", None)]


def test_blip_and_switch(spark):
    got, rows = states(spark, A4 + ["Bob", "Alice"])
    assert got[4:] == [("switching", "Alice"), ("stable", "Alice")]
    assert (rows[4].challenger_identity, rows[4].challenger_evidence) == ("Bob", 1)
    got, _ = states(spark, A4 + ["Bob"] * 3)
    assert got[4:] == [("switching", "Alice")] * 2 + [("stable", "Bob")]


def test_poor_frames_never_settle(spark):
    got, _ = states(spark, [("Alice", "poor")] * 4 + A4)
    assert all(s == "unstable" for s, _ in got[:7]) and got[7] == ("stable", "Alice")


def test_gap_starts_afresh(spark):
    got, rows = states(spark, A4 + [("+", 10.0), "Alice"])
    assert got[4][0] == "unstable" and rows[4].observations_count == 1


def test_switched_off(spark):
    rows = tem.pass_through(observe(spark, ["Alice", None])).orderBy("frame_index").collect()
    assert [(r.state, r.is_stable) for r in rows] == [("stable", True), ("unknown", False)]


def model_stabilise(frames, settings):
    """Plain restatement of the smoothing rules: (state, identity, count, challenger, evidence)."""
    out, window, last = [], [], None
    held, count, unknowns, rival, rivals = None, 0, 0, None, 0
    for now, name, candidate, quality in frames:
        if last is not None and now - last > settings["max_gap_seconds"] * 1e6:
            window, held, count, unknowns, rival, rivals = [], None, 0, 0, None, 0
        last = now
        window = (window + [(name, quality)])[-settings["window_size"] :]
        good = [n for n, q in window if q != "poor"]
        tally = {}
        for n in good:
            if n is not None:
                tally[n] = tally.get(n, 0) + 1
        leader, weight = candidate, 0
        for n, w in tally.items():
            if w > weight:
                leader, weight = n, w
        share = weight / len(good) if good else 0.0
        if held is None:
            if weight >= settings["min_observations"] and share >= settings["min_stable_ratio"]:
                held, count, unknowns, rival, rivals, state = leader, weight, 0, None, 0, "stable"
            else:
                state = "unknown" if good.count(None) >= settings["min_observations"] else "unstable"
            shown = held
        elif name == held:
            count, unknowns, rival, rivals, state, shown = count + 1, 0, None, 0, "stable", held
        elif name is None:
            unknowns += 1
            if unknowns <= settings["max_unknown_observations"]:
                state, shown = "stable", held
            else:
                held, count, state, shown = None, 0, "unknown", None
        else:
            unknowns = 0
            rivals = rivals + 1 if rival == name else 1
            rival, shown, state = name, held, "switching"
            if rivals >= settings["challenger_switch_threshold"]:
                held, count, rival, rivals, state = name, rivals, None, 0, "stable"
                shown = held
        out.append((state, shown, count, rival, rivals))
    return out


def random_frames(seed, n, names=("A", "B", "C")):
    rng, now, frames, base = random.Random(seed), 0, [], "A"
    for _ in range(n):
        now += int(rng.choice([0.1, 0.2, 0.5, 0.5, 0.5, 1.0, 2.5 if rng.random() < 0.1 else 0.3]) * 1e6)
        if rng.random() < 0.05:
            base = rng.choice(names)
        roll = rng.random()
        name = None if roll < 0.12 else rng.choice(names) if roll < 0.22 else base
        frames.append((now, name, name or base, "poor" if rng.random() < 0.1 else "good"))
    return frames


def observed(spark, streams):
    rows = []
    for stream, frames in streams.items():
        for i, (now, name, candidate, quality) in enumerate(frames, 1):
            rows.append((stream, i, START + timedelta(microseconds=now), name, candidate, 0.5, name is not None, quality))
    return spark.createDataFrame(rows, OBS)


@pytest.mark.parametrize("mode,chunk", [("fast", 40), ("balanced", 37), ("stable", 1000), ("balanced", 500_000)])
def test_smoothing_matches_model_whatever_the_chunks(spark, mode, chunk):
    settings = preset(TEMPORAL, mode)
    streams = {f"s{i}": random_frames(i, 400) for i in range(3)}
    streams["steady"] = [(i * 100_000, "A", "A", "good") for i in range(400)]
    got = {}
    for r in tem.stabilise(observed(spark, streams), settings, chunk_rows=chunk).collect():
        got[r.stream_id, r.frame_index] = (
            r.state, r.stable_identity, r.consecutive_stable_count, r.challenger_identity, r.challenger_evidence,
        )
    for stream, frames in streams.items():
        for i, expected in enumerate(model_stabilise(frames, settings), 1):
            assert got[stream, i] == expected, (stream, i)


def stable_frames(spark, frames, stream="s"):
    rows = [(stream, i, START + timedelta(seconds=at), name, name is not None) for i, (at, name) in enumerate(frames, 1)]
    return spark.createDataFrame(rows, STABLE)


def events_of(spark, frames, **overrides):
    settings = preset(PRESENCE, overrides.pop("mode", "balanced"), **overrides)
    rows = pre.presence_events(stable_frames(spark, frames), settings)
    return rows, [(r.event_type, r.identity, r.new_state) for r in rows.orderBy("frame_index", "event_seq").collect()]


def test_entry_needs_three_sightings(spark):
    rows, got = events_of(spark, [(0, "Alice"), (0.5, "Alice"), (1.0, "Alice")])
    assert got == [("STATE_CHANGED", "Alice", "CANDIDATE"), ("ENTRY_CONFIRMED", "Alice", "PRESENT")]
    assert rows.where("event_type = 'ENTRY_CONFIRMED'").first().observation_count == 3


def test_candidate_times_out(spark):
    _, got = events_of(spark, [(0, "Alice"), (10, None)])
    assert got[-1] == ("STATE_CHANGED", "Alice", "NOT_PRESENT")


def test_grace_and_resume_keep_the_session(spark):
    rows, got = events_of(spark, [(0, "Alice"), (0.5, "Alice"), (1, "Alice"), (2, None), (4, "Alice")])
    assert [e for e, _, _ in got[2:]] == ["GRACE_STARTED", "PRESENCE_RESUMED"]
    last = rows.where("event_type = 'PRESENCE_RESUMED'").first()
    assert last.interruption_count == 1
    assert rows.where("session_id is not null").select("session_id").distinct().count() == 1


def test_grace_sweep_ends_after_the_period(spark):
    rows, _ = events_of(spark, [(0, "Alice"), (1, "Alice"), (2, None)], mode="fast")
    still = pre.open_sessions(rows)
    at = F.lit(START + timedelta(seconds=8))
    ended = pre.grace_sweep(still, at, preset(PRESENCE, "fast")).first()
    assert ended.duration_seconds == 7.0 and ended.state == "ABSENT"
    assert pre.grace_sweep(still, F.lit(START + timedelta(seconds=6)), preset(PRESENCE, "fast")).isEmpty()
    stopped = pre.stop_sessions(still, at).first()
    assert stopped.reason == "session closed due to runtime_shutdown"


def test_two_identities(spark):
    rows, _ = events_of(spark, [(0, "Alice"), (1, "Alice"), (2, "Bob"), (3, "Bob")], mode="fast")
    asked = spark.createDataFrame([("Alice",), ("Bob",), ("Cora",)], "identity STRING")
    got = {r.identity: r.state for r in pre.identity_states(asked, rows).collect()}
    assert got == {"Alice": "GRACE", "Bob": "PRESENT", "Cora": "NOT_PRESENT"}


def test_longest_session_is_cut(spark):
    frames = [(0, "Alice"), (1, "Alice"), (40, "Alice"), (41, "Alice")]
    rows, got = events_of(spark, frames, mode="fast", max_session_duration_seconds=30.0)
    assert got[2] == ("SESSION_ENDED", "Alice", "ABSENT") and got[3][2] == "CANDIDATE"
    assert rows.where("frame_index = 4").first().previous_state == "ABSENT"
    assert "safeguard" in rows.where("event_type = 'SESSION_ENDED'").first().reason


def model_presence(frames, settings):
    """All identities, literally: every known identity hears of every frame."""
    w, g, m = (int(settings[k] * 1e6) for k in ("entry_window_seconds", "grace_period_seconds", "max_session_duration_seconds"))
    people, out = {}, []
    for i, (now, active) in enumerate(frames, 1):
        if active and active not in people:
            people[active] = dict(state="NOT_PRESENT", entries=[], lost=0, start=0)
        order = ([active] if active else []) + [p for p in people if p != active]
        for who in order:
            p, here = people[who], who == active
            state = p["state"]
            event = None
            if state in ("PRESENT", "GRACE") and now - p["start"] >= m:
                event, p["state"] = "SESSION_ENDED", "ABSENT"
            elif state in ("NOT_PRESENT", "ABSENT"):
                if here:
                    event, p["state"], p["entries"] = "STATE_CHANGED", "CANDIDATE", [now]
            elif state == "CANDIDATE":
                if here:
                    p["entries"] = [t for t in p["entries"] + [now] if t >= now - w]
                    if len(p["entries"]) >= settings["min_entry_observations"]:
                        event, p["state"], p["start"] = "ENTRY_CONFIRMED", "PRESENT", now
                elif now - p["entries"][0] > w:
                    event, p["state"] = "STATE_CHANGED", "NOT_PRESENT"
            elif state == "PRESENT":
                if here:
                    event = "PRESENCE_UPDATED"
                else:
                    event, p["state"], p["lost"] = "GRACE_STARTED", "GRACE", now
            elif here:
                event, p["state"] = "PRESENCE_RESUMED", "PRESENT"
            elif now - p["lost"] >= g:
                event, p["state"] = "SESSION_ENDED", "ABSENT"
            if event:
                out.append((i, who, event, state, p["state"]))
    return out


@pytest.mark.parametrize("chunk,cell", [(500_000, 1_000_000), (29, 1_000_000), (111, 20)])
def test_presence_matches_model_whatever_the_chunks(spark, chunk, cell):
    settings = preset(PRESENCE, max_session_duration_seconds=60.0)
    streams = {f"s{i}": [(now, name) for now, name, _, _ in random_frames(i + 50, 500, "ABCD")] for i in range(3)}
    streams["steady"] = [(i * 500_000, "A") for i in range(500)]
    rows = [
        (s, i, START + timedelta(microseconds=now), name, name is not None)
        for s, frames in streams.items()
        for i, (now, name) in enumerate(frames, 1)
    ]
    events = pre.presence_events(spark.createDataFrame(rows, STABLE), settings, chunk, cell)
    got = events.orderBy("stream_id", "frame_index", "event_seq").collect()
    for stream, frames in streams.items():
        mine = [(r.frame_index, r.identity, r.event_type, r.previous_state, r.new_state) for r in got if r.stream_id == stream]
        assert mine == model_presence(frames, settings), stream


def test_a_long_presence_settles_in_few_rounds(spark, caplog):
    """One identity present over 50 chunks, now and then lost for a while; another comes and goes."""
    rng = random.Random(3)
    settings = preset(PRESENCE, max_session_duration_seconds=1e6)
    frames = [(i * 500_000, None if i % 37 == 0 else "B" if rng.random() < 0.05 else "A") for i in range(1500)]
    rows = [("s", i, START + timedelta(microseconds=now), name, name is not None) for i, (now, name) in enumerate(frames, 1)]
    stable = spark.createDataFrame(rows, STABLE)
    with caplog.at_level("INFO", logger="rollmark.operators.chunked"):
        cut = pre.presence_events(stable, settings, 30).orderBy("frame_index", "event_seq").collect()
    rounds = [r.args[0] for r in caplog.records if "settled" in r.getMessage()]
    assert len(rounds) == 1 and rounds[0] <= 3
    assert cut == pre.presence_events(stable, settings).orderBy("frame_index", "event_seq").collect()


def test_policies_fold_together(spark):
    frames = random_frames(77, 400, "AB")
    rows = [("s", i, START + timedelta(microseconds=now), name, name is not None) for i, (now, name, _, _) in enumerate(frames, 1)]
    policies = {mode: preset(PRESENCE, mode) for mode in PRESENCE}
    both = pre.presence_events_by_policy(spark.createDataFrame(rows, STABLE), policies, 41).collect()
    for mode, settings in policies.items():
        got = [(r.frame_index, r.identity, r.event_type, r.previous_state, r.new_state) for r in sorted(both, key=lambda r: (r.frame_index, r.event_seq)) if r.mode == mode]
        assert got == model_presence([(now, name) for now, name, _, _ in frames], settings), mode


def test_entry_counts_by_brute_force(spark):
    rng = random.Random(9)
    rows = [("s", i, START + timedelta(seconds=rng.random() * 300), rng.choice("AB"), True) for i in range(400)]
    frames = spark.createDataFrame(rows, STABLE).withColumnRenamed("stable_identity", "identity")
    got = {r.frame_index: r.entries_in_window for r in pre.entry_counts(frames, 5.0).collect()}
    for _, i, t, who, _ in rows:
        window = [x for _, _, x, w, _ in rows if w == who and t - timedelta(seconds=5) <= x <= t]
        assert got[i] == len(window)


def test_fixed_rate_times(spark):
    rows = spark.createDataFrame([(0,), (30,)], "frame_index BIGINT")
    got = [r.ts for r in tem.fixed_rate_times(rows, F.lit(START), 30.0).orderBy("frame_index").collect()]
    assert (got[1] - got[0]).total_seconds() == 1.0


def test_presets_and_overrides(spark):
    assert preset(TEMPORAL, "odd")["window_size"] == 7
    assert preset(PRESENCE, "fast", scale=2.0)["grace_period_seconds"] == 10.0
    with pytest.raises(ValueError):
        preset(TEMPORAL, "fast", nonsense=1)
