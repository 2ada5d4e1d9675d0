"""Stable identities from noisy per-frame observations.

Evidence (the leading identity of the last few frames and its weight) comes from window
functions. Only the remaining state machine is Python: ``Holder`` with five fields, folded
over bounded chunks by ``chunked_scan`` and reused by the streaming job.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rollmark.operators.chunked import CHUNK_ROWS, Tally, chunked_scan
from rollmark.operators.ordering import (
    ROWS_PER_CELL,
    cut,
    neighbour,
    positions,
    running_totals,
    with_halo,
)
from rollmark.session import spread_by

STABLE, UNSTABLE, UNKNOWN, SWITCHING = "stable", "unstable", "unknown", "switching"


def to_observations(results: DataFrame) -> DataFrame:
    """Recognition results to observations: identity only if recognised, quality 'none' if absent."""
    columns = set(results.columns)
    quality = F.coalesce("quality_status", F.lit("none")) if "quality_status" in columns else F.lit("none")
    return results.withColumns(
        {"identity": F.when(F.col("recognized"), F.col("identity")), "quality_status": quality}
    )


def number_frames(rows: DataFrame, tie_cols: list[str], rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """1-based ``frame_index`` per stream in time order."""
    timed = rows.withColumn("_us", F.unix_micros("ts"))
    return positions(timed, ["stream_id"], "_us", "frame_index", tie_cols, rows_per_cell).drop("_us")


def fixed_rate_times(rows: DataFrame, start: Column, fps: float) -> DataFrame:
    """Time stamps of evenly spaced frames: start + frame_index / fps."""
    micros = F.unix_micros(start) + F.round(F.col("frame_index") * F.lit(1e6 / fps)).cast("bigint")
    return rows.withColumn("ts", F.timestamp_micros(micros))


def _gap(previous: Column, settings: Mapping[str, float]) -> Column:
    limit = int(round(settings["max_gap_seconds"] * 1e6))
    return F.coalesce(F.col("_us") - previous > F.lit(limit), F.lit(False))


def gap_segments(
    observations: DataFrame, settings: Mapping[str, float], rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Number the stretches of each stream that are separated by long gaps, from 0."""
    timed = observations.withColumn("_us", F.unix_micros("ts"))
    near = neighbour(cut(timed, ["stream_id"], "frame_index", rows_per_cell), {"_prev": "_us"}, following=False)
    flag = F.when(_gap(F.col("_prev"), settings), 1).otherwise(0).cast("bigint")
    return running_totals(near, {"gap_segment": flag}).df.select(*observations.columns, "gap_segment")


def window_consensus(
    observations: DataFrame, settings: Mapping[str, float], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Evidence of the last ``window_size`` frames since the last gap, beside every frame.

    Poor frames take a place in the window but carry no weight. The leader is the identity
    of greatest weight, first seen first; without evidence it is the frame's own candidate.
    Streams are cut into chunks with a halo of one window, so no stream is sorted whole.
    """
    size = int(settings["window_size"])
    timed = observations.withColumn("_us", F.unix_micros("ts"))
    haloed = with_halo(timed, "frame_index", chunk_rows, max(1, size - 1))
    spread = spread_by(haloed, "stream_id", "_chunk")
    order = Window.partitionBy("stream_id", "_chunk").orderBy("frame_index")
    recognised = F.col("recognized") & F.col("identity").isNotNull()
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    seen = F.struct(
        F.col("_segment").alias("segment"),
        (F.col("quality_status") == "poor").alias("poor"),
        F.when(recognised, F.col("identity")).alias("identity"),
    )
    segmented = spread.withColumn("_gap", _gap(F.lag("_us").over(order), settings))
    segmented = segmented.withColumn("_segment", F.sum(F.col("_gap").cast("int")).over(upto))
    windowed = segmented.withColumn("_w", F.collect_list(seen).over(order.rowsBetween(1 - size, 0))).where(~F.col("_halo"))
    dealt = windowed.withColumn("_w", F.filter("_w", lambda e: e["segment"] == F.col("_segment")))
    voted = dealt.withColumn("_v", F.filter("_w", lambda e: ~e["poor"])).withColumn(
        "_ids", F.filter(F.transform("_v", lambda e: e["identity"]), lambda i: i.isNotNull())
    )
    ranked = voted.withColumn("_names", F.array_distinct("_ids")).withColumn(
        "_weights", F.transform("_names", lambda n: F.size(F.filter("_ids", lambda i: i == n)))
    )
    weight = F.coalesce(F.array_max("_weights"), F.lit(0))
    total = F.size("_v")
    leader = F.when(
        F.size("_names") > 0, F.get("_names", (F.array_position("_weights", weight) - 1).cast("int"))
    ).otherwise(F.col("best_candidate"))
    return ranked.select(
        *observations.columns,
        "_chunk",
        F.col("_gap").alias("after_gap"),
        leader.alias("leader"),
        weight.alias("leader_weight"),
        total.alias("total_weight"),
        (total - F.size("_ids")).alias("unknown_weight"),
        F.when(total > 0, weight / total).otherwise(F.lit(0.0)).alias("consensus_ratio"),
        F.size("_w").alias("window_count"),
    )


#: A chunk's lead is this part of a chunk: long enough that the state of most chunks is known from it.
LEADS = 32


@dataclass
class Holder:
    """The identity a stream holds on to, and what speaks against it."""

    stable: str | None = None
    unknowns: int = 0
    challenger: str | None = None
    challenges: int = 0

    def advance(self, seen: str | None, evidence: tuple, tally: Tally, settings: Mapping[str, float]) -> str:
        """Take one frame (recognised identity or None, evidence) and return the state name."""
        leader, weight, ratio, unknown_weight = evidence
        if self.stable is None:
            enough = settings["min_observations"]
            if weight >= enough and ratio >= settings["min_stable_ratio"]:
                self._hold(leader, int(weight), tally)
                self.unknowns = 0
                return STABLE
            return UNKNOWN if unknown_weight >= enough else UNSTABLE
        if seen is None:
            self.unknowns += 1
            if self.unknowns <= settings["max_unknown_observations"]:
                return STABLE
            self.stable = None
            tally.set(0)
            return UNKNOWN
        self.unknowns = 0
        if seen == self.stable:
            tally.add()
            self.challenger, self.challenges = None, 0
            return STABLE
        self.challenges = self.challenges + 1 if seen == self.challenger else 1
        self.challenger = seen
        if self.challenges < settings["challenger_switch_threshold"]:
            return SWITCHING
        self._hold(seen, self.challenges, tally)
        return STABLE

    def _hold(self, identity: str, count: int, tally: Tally) -> None:
        self.stable = identity
        self.challenger, self.challenges = None, 0
        tally.set(count)


_FOLDED = T.StructType(
    [
        T.StructField("mode", T.StringType()),
        T.StructField("stream_id", T.StringType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("_us", T.LongType()),
        T.StructField("stable_identity", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("observations_count", T.IntegerType()),
        T.StructField("consecutive_stable_count", T.LongType()),
        T.StructField("active_candidate", T.StringType()),
        T.StructField("challenger_identity", T.StringType()),
        T.StructField("challenger_evidence", T.IntegerType()),
        T.StructField("unknown_count", T.IntegerType()),
    ]
)


def window_evidence(rows: pd.DataFrame, settings: Mapping[str, float]) -> dict[str, np.ndarray]:
    """``window_consensus`` over sorted rows (_us, seen, votes, best_candidate) as arrays, a few passes per window place."""
    size, n = int(settings["window_size"]), len(rows)
    us = rows["_us"].to_numpy()
    us = us if us.dtype.kind == "i" else us.astype("float64")  # a missing time is no gap
    gap = np.zeros(n, bool)
    gap[1:] = us[1:] - us[:-1] > int(round(settings["max_gap_seconds"] * 1e6))
    segment = np.cumsum(gap)
    codes, names = pd.factorize(rows["seen"])
    votes = rows["votes"].to_numpy(bool)

    def back(values: np.ndarray, places: int, fill: object) -> np.ndarray:
        return np.concatenate([np.full(min(places, n), fill, values.dtype), values[: max(n - places, 0)]])

    count, total = np.zeros(n, np.int32), np.zeros(n, np.int32)
    held = []
    for place in range(size):
        inside = back(segment, place, -1) == segment
        count += inside
        voting = inside & back(votes, place, False)
        total += voting
        held.append(np.where(voting, back(codes, place, -1), -1))
    unknown, weight, first = total.copy(), np.zeros(n, np.int32), np.full(n, -1)
    for code in held[::-1]:  # the identity seen first wins
        known = code >= 0
        unknown -= known
        alike = np.sum([code == other for other in held], axis=0, dtype=np.int32) * known
        better = alike > weight
        weight, first = np.where(better, alike, weight), np.where(better, code, first)
    named = np.append(np.asarray(names, object), None)[first]
    return {
        "gap": gap,
        "leader": np.where(first >= 0, named, rows["best_candidate"].to_numpy(object)),
        "weight": weight,
        "ratio": np.divide(weight, total, out=np.zeros(n), where=total > 0),
        "unknown": unknown,
        "count": count,
    }


def _stabiliser_fold(policies: Mapping[str, Mapping[str, float]]):
    def fold(pdf: pd.DataFrame, state: dict | None, tally: Tally, emit: bool, start: int = 0, upto: int | None = None):
        settings = policies[pdf["mode"].iloc[0]] if len(pdf) else {}
        pdf = pdf.iloc[:upto]
        arrays = window_evidence(pdf, settings)
        chosen = {name: values[start:] for name, values in arrays.items()}
        pdf = pdf.iloc[start:]
        holder = Holder(**state) if state else Holder()
        leader, weight, ratio, unknown = (chosen[c].tolist() for c in ("leader", "weight", "ratio", "unknown"))
        results = []
        for at, (gap, seen) in enumerate(zip(chosen["gap"].tolist(), pdf["seen"].tolist(), strict=True)):
            if gap:
                holder = Holder()
                tally.set(0)
            name = holder.advance(seen, (leader[at], weight[at], ratio[at], unknown[at]), tally, settings)
            if emit:
                results.append(
                    (holder.stable, name, tally.count, holder.challenger, holder.challenges, holder.unknowns, not tally.was_set)
                )
        if not emit:
            return None, asdict(holder)
        stable, names, counts, challengers, challenges, unknowns, fresh = zip(*results) if results else [()] * 7
        out = pdf[["mode", "stream_id", "frame_index", "_us"]].assign(
            stable_identity=stable,
            state=names,
            ratio=chosen["ratio"],
            observations_count=chosen["count"],
            consecutive_stable_count=counts,
            active_candidate=chosen["leader"],
            challenger_identity=challengers,
            challenger_evidence=challenges,
            unknown_count=unknowns,
            _fresh=fresh,
        )
        return out, asdict(holder)

    return fold


def stabilise(observations: DataFrame, settings: Mapping[str, float], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Stable identity and state after every frame.

    ``observations`` has stream_id, frame_index (dense from 1 per stream, in time order),
    ts, identity, best_candidate, recognized and quality_status.
    """
    return stabilise_by_policy(observations, {"": settings}, chunk_rows).drop("mode")


def stabilise_by_policy(
    observations: DataFrame, policies: Mapping[str, Mapping[str, float]], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``stabilise`` under several policies, told apart by ``mode``, from one pass over the observations."""
    recognised = F.col("recognized") & F.col("identity").isNotNull()
    longest = max(int(settings["window_size"]) for settings in policies.values())
    lead = max(1, longest - 1, chunk_rows // LEADS)
    narrow = observations.select(
        F.explode(F.array(*[F.lit(mode) for mode in policies])).alias("mode"),
        "stream_id",
        "frame_index",
        F.unix_micros("ts").alias("_us"),
        F.when(recognised, F.col("identity")).alias("seen"),
        F.coalesce(F.col("quality_status") != "poor", F.lit(False)).alias("votes"),
        "best_candidate",
    )
    rows = with_halo(narrow.withColumn("_stream", F.concat_ws("#", "mode", "stream_id")), "frame_index", chunk_rows, lead)
    several = not observations.where(F.col("frame_index") > chunk_rows).isEmpty()
    folded = chunked_scan(
        rows, "_stream", "frame_index", _stabiliser_fold(policies), _FOLDED, several, tally_col="consecutive_stable_count"
    )
    return folded.select(
        "mode",
        "stream_id",
        "frame_index",
        F.timestamp_micros("_us").alias("ts"),
        "stable_identity",
        "state",
        F.when(F.col("stable_identity").isNotNull(), F.least("ratio", F.lit(1.0)))
        .otherwise(F.lit(0.0))
        .alias("confidence_score"),
        "observations_count",
        "consecutive_stable_count",
        "active_candidate",
        "challenger_identity",
        "challenger_evidence",
        (F.col("state") == STABLE).alias("is_stable"),
        "unknown_count",
    )


def pass_through(observations: DataFrame) -> DataFrame:
    """Output shape of ``stabilise`` when smoothing is switched off."""
    stable = F.coalesce(F.col("recognized") & F.col("identity").isNotNull(), F.lit(False))
    return observations.select(
        "stream_id",
        "frame_index",
        "ts",
        F.col("identity").alias("stable_identity"),
        F.when(stable, F.lit(STABLE)).otherwise(F.lit(UNKNOWN)).alias("state"),
        F.when(F.col("recognized"), F.col("similarity")).otherwise(F.lit(0.0)).alias("confidence_score"),
        F.lit(1).alias("observations_count"),
        stable.cast("bigint").alias("consecutive_stable_count"),
        F.col("best_candidate").alias("active_candidate"),
        F.lit(None).cast("string").alias("challenger_identity"),
        F.lit(0).alias("challenger_evidence"),
        stable.alias("is_stable"),
        F.lit(0).alias("unknown_count"),
    )


def current_state(stabilised: DataFrame) -> DataFrame:
    """Last known state of every stream."""
    latest = F.max_by(
        F.struct(
            F.col("stable_identity").alias("current_stable_identity"),
            "consecutive_stable_count",
            F.col("unknown_count").alias("consecutive_unknown_count"),
            "challenger_identity",
            F.col("challenger_evidence").alias("challenger_count"),
            F.col("observations_count").alias("window_size"),
        ),
        "frame_index",
    )
    return stabilised.groupBy("stream_id").agg(latest.alias("_s")).select("stream_id", "_s.*")
