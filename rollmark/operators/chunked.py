"""Sequential folds over long ordered streams, cut into bounded chunks.

A state machine must see the rows of a stream in order, but one stream may hold a third of
all rows. ``chunked_scan`` therefore folds (stream, chunk) groups of bounded size in
parallel. Where a stream has several chunks, a chunk also gets a lead, the last rows before
it. It is folded from the state that the lead alone leads to, and its rows are written with
the states at its edges. Where a chunk's first state isn't the last one of the chunk before,
it is folded again from that one, until all agree, so the result is exactly that of one
sequential run. State machines that soon forget their past are folded once.

One that may hold on to its past for many chunks brings ``Tables``: each chunk then also
yields what it makes of the states it may be entered with, open fields referring to the
entry. These are composed along the chunks of a stream without looking at rows again; only
a chunk whose table doesn't cover its entry runs once more.

A counter that only ever grows or is set anew would never be forgotten, so it is kept out
of the compared state: a fold reports it as a ``Tally``, the chunks' tallies are summed
with a window over the chunk table, and rows before a chunk's first setting get that sum.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rollmark.operators.ordering import join_groups
from rollmark.session import materialize, spread_by

CHUNK_ROWS = 200_000


@dataclass
class Tally:
    """A counter: ``count`` since it was last set, or since the chunk began if never set."""

    count: int = 0
    was_set: bool = False

    def add(self) -> None:
        self.count += 1

    def set(self, value: int) -> None:
        self.count = value
        self.was_set = True


class Tables(Protocol):
    """Transition tables of a fold."""

    def table(self, rows: pd.DataFrame) -> dict:
        """What a chunk makes of the states it may be entered with; plain values only."""

    def leave(self, table: dict, empty_exit: dict, entry: dict, ran: tuple[dict, dict]) -> tuple[dict, bool]:
        """The state behind the chunk for an entry, and whether it is certain.

        ``empty_exit`` is the state behind the chunk if it is entered without any, ``ran`` an entry and
        exit that are known. If neither these nor the table cover a part of the entry, the answer has
        what is likely there.
        """


_LOG = logging.getLogger(__name__)

#: Column in which a fold without tables says that the tally wasn't set yet since the chunk began.
_FRESH = "_fresh"

#: fold(rows sorted by order, state or None, tally, emit rows?) -> (rows or None, state); without tables it also
#: takes start and upto, the places between which rows are folded, and emits a row for each row.
Fold = Callable[..., "tuple[pd.DataFrame | None, dict]"]


def chunked_scan(
    rows: DataFrame,
    key: str,
    order_col: str,
    fold: Fold,
    schema: T.StructType,
    several: bool,
    chunk_col: str = "_chunk",
    tables: Tables | None = None,
    tally_col: str = "",
) -> DataFrame:
    """Fold each stream ``key`` in ``order_col`` order and return the rows the fold emits.

    ``several`` says whether any stream has more than one chunk. Folds with ``tables`` have no tally. Without,
    rows have a lead (``with_halo``) and ``tally_col`` is the column of the emitted tally.
    """
    keys = [key, chunk_col]
    if not several:

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return fold(pdf.sort_values(order_col), None, Tally(), True)[0][schema.fieldNames()]

        alone = rows if tables else rows.where(~F.col("_halo"))
        return spread_by(alone, *keys).groupBy(*keys).applyInPandas(whole, schema)

    if tables is None:
        return _verify(spread_by(rows, *keys), key, order_col, fold, schema, chunk_col, tally_col)
    rows = materialize(spread_by(rows, *keys))
    settled = _compose(rows, key, order_col, fold, chunk_col, tables)

    def replay(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        state = json.loads(entry["_state"].iloc[0]) if len(entry) and entry["_state"].iloc[0] else None
        return fold(pdf.sort_values(order_col), state, Tally(), True)[0]

    return rows.groupBy(*keys).cogroup(settled.groupBy(*keys)).applyInPandas(replay, schema)


def _compose(rows: DataFrame, key: str, order_col: str, fold: Fold, chunk_col: str, tables: Tables) -> DataFrame:
    """The state with which each chunk starts: tables are walked along each stream and applied, gaps run again."""
    keys = [key, chunk_col]
    key_fields = [rows.schema[key], rows.schema[chunk_col]]

    def text(*names: str) -> list[T.StructField]:
        return [T.StructField(name, T.StringType()) for name in names]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        _, state = fold(pdf, None, Tally(), False)
        row = pdf[keys].iloc[:1].assign(_exit=json.dumps(state, sort_keys=True), _table=json.dumps(tables.table(pdf)))
        return row.assign(_ran=None, _ran_exit=None)

    def again(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        ran = entry["_ran"].iloc[0]
        _, state = fold(pdf.sort_values(order_col), json.loads(ran), Tally(), False)
        return entry[[*keys, "_exit", "_table", "_ran"]].assign(_ran_exit=json.dumps(state, sort_keys=True))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entries along a stream; where one isn't covered, what is known of the chunk stands in for its exit."""
        entry, entries, gaps = {}, [], []
        pdf = pdf.sort_values(chunk_col)
        for texts in pdf[["_exit", "_table", "_ran", "_ran_exit"]].itertuples(index=False):
            empty_exit, table, *ran = (json.loads(t) if t else {} for t in texts)
            entries.append(json.dumps(entry, sort_keys=True))
            entry, certain = tables.leave(table, empty_exit, entry, tuple(ran))
            gaps.append(not certain)
        return pdf[keys].assign(_state=entries, _gap=gaps)

    summary = T.StructType([*key_fields, *text("_exit", "_table", "_ran", "_ran_exit")])
    walked = T.StructType([*key_fields, *text("_state"), T.StructField("_gap", T.BooleanType())])
    known = materialize(rows.groupBy(*keys).applyInPandas(first, summary))
    rounds = 1
    while True:
        entries = materialize(known.groupBy(key).applyInPandas(walk, walked))
        gaps = entries.where("_gap")
        if gaps.isEmpty():
            _LOG.info("chunks settled in %d rounds", rounds)
            return entries.select(*keys, "_state")
        asked = materialize(known.drop("_ran", "_ran_exit").join(gaps.select(*keys, F.col("_state").alias("_ran")), keys))
        wanted = rows.join(asked.select(*keys), keys, "left_semi")
        redone = wanted.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(again, summary)
        known = materialize(known.join(asked.select(*keys), keys, "left_anti").unionByName(redone))
        rounds += 1


def _verify(
    rows: DataFrame, key: str, order_col: str, fold: Fold, schema: T.StructType, chunk_col: str, tally_col: str
) -> DataFrame:
    """Fold every chunk once from the state that its lead suggests; do again what turns out to start otherwise."""
    keys = [key, chunk_col]
    extra = [rows.schema[key], rows.schema[chunk_col]]
    extra += [T.StructField(_FRESH, T.BooleanType()), T.StructField("_summary", T.StringType())]
    full = T.StructType([*schema.fields, *extra])

    def run(pdf: pd.DataFrame, guess: bool, text: str | None) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col)
        lead = pdf["_halo"].to_numpy(bool)
        if lead.all():  # the stream ends before this chunk
            return pd.DataFrame(columns=full.fieldNames(), dtype=object)
        if guess:
            entry = fold(pdf, None, Tally(), False, upto=int(lead.sum()))[1] if lead.any() else None
        else:
            entry = json.loads(text) if text else None
        tally = Tally()
        out, state = fold(pdf, entry, tally, True, start=int(lead.sum()))
        entry, state = (None if s is None else json.dumps(s, sort_keys=True) for s in (entry, state))
        summary = json.dumps({"entry": entry, "exit": state, "add": tally.count, "set": tally.was_set})
        noted = pd.Series([summary, *[None] * (len(out) - 1)], out.index, dtype=object)  # with the chunk's first row
        return out.assign(**{k: pdf[k] for k in keys}, _summary=noted)[full.fieldNames()]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, True, None)

    def again(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        return run(pdf, False, entry["_state"].iloc[0])

    along = Window.partitionBy(key).orderBy(chunk_col)
    parsed = F.from_json("_summary", "entry string, exit string, add bigint, set boolean")
    done = materialize(rows.groupBy(*keys).applyInPandas(first, full))
    rounds = 1
    while True:
        known = materialize(done.where("_summary IS NOT NULL").select(*keys, parsed.alias("_s")).select(*keys, "_s.*"))
        entries = known.select("*", F.lag("exit").over(along).alias("_state"))
        stale = materialize(entries.where(~F.col("_state").eqNullSafe(F.col("entry"))).select(*keys, "_state"))
        if stale.isEmpty():
            break
        wanted = join_groups(rows, stale.select(*keys), keys, "left_semi")
        redone = wanted.groupBy(*keys).cogroup(stale.groupBy(*keys)).applyInPandas(again, full)
        kept = join_groups(done, stale.select(*keys), keys, "left_anti")
        done = materialize(kept.unionByName(redone))
        rounds += 1
    _LOG.info("chunks settled in %d rounds", rounds)
    up_to = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = Window.partitionBy(key, "_run").orderBy(chunk_col).rowsBetween(Window.unboundedPreceding, 0)
    counted = known.withColumn("_run", F.sum(F.col("set").cast("int")).over(up_to)).withColumn("_sum", F.sum("add").over(summed))
    before = materialize(counted.select(*keys, F.coalesce(F.lag("_sum").over(along), F.lit(0)).alias("_before")))
    rows_out = join_groups(done, before, keys, "left")
    total = F.col(tally_col) + F.when(F.col(_FRESH), F.col("_before")).otherwise(0)
    return rows_out.withColumn(tally_col, total).select(*schema.fieldNames())
