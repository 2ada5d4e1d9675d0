"""Scalar column helpers: rounding, durations, dates, names and keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

def round_half_even(column: str, places: int) -> Column:
    """Round a double column by its exact binary value, ties to even, as Python's ``round`` does.

    The built-in ``round`` works on the shortest decimal text, so 0.03405 (stored slightly
    below) would go up. Here the product with the power of ten is taken with its rounding
    error (both factors cut into halves of 26 bits), which decides the ties.
    """
    power = float(10**places)
    cut = 134217729.0  # 2**27 + 1
    power_high = power * cut - (power * cut - power)
    power_low = power - power_high
    high = f"({column} * {cut}D - ({column} * {cut}D - {column}))"
    low = f"({column} - {high})"
    product = f"({column} * {power}D)"
    error = (
        f"((({high} * {power_high}D - {product}) + {high} * {power_low}D + {low} * {power_high}D)"
        f" + {low} * {power_low}D)"
    )
    whole = f"cast(floor({product}) as double)"
    beyond = f"(({product} - ({whole} + 0.5D)) + {error})"
    up = f"({beyond} > 0 or ({beyond} = 0 and pmod({whole}, 2D) = 1D))"
    return F.expr(f"(case when {up} then {whole} + 1D else {whole} end) / {power}D")


def with_rounding(df: DataFrame, places: Mapping[str, int]) -> DataFrame:
    """``round_half_even`` on several columns, in steps that keep each expression small."""
    cut = 134217729.0
    first, second, third, last = [], [], [], {}
    for name, digits in places.items():
        power = float(10**digits)
        high = power * cut - (power * cut - power)
        low = power - high
        p, c, h, e = (f"_{part}_{name}" for part in "pche")
        first += [f"{name} * {power}D as {p}", f"{name} * {cut}D as {c}"]
        second.append(f"{c} - ({c} - {name}) as {h}")
        third.append(
            f"({p} - (floor({p}) + 0.5D)) + ((({h} * {high}D - {p}) + {h} * {low}D + ({name} - {h}) * {high}D)"
            f" + ({name} - {h}) * {low}D) as {e}"
        )
        up = f"{e} > 0 or ({e} = 0 and pmod(floor({p}), 2) = 1)"
        last[name] = F.expr(f"(floor({p}) + if({up}, 1, 0)) / {power}D")
    steps = df.selectExpr("*", *first).selectExpr("*", *second).selectExpr("*", *third)
    return steps.select(*[last[c].alias(c) if c in last else F.col(c) for c in df.columns])


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds from one timestamp to another, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6))


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 text to timestamp: ``Z`` and offsets are honoured, naive text is UTC, junk is NULL."""
    return F.try_to_timestamp(text)


def parse_date(text: Column) -> Column:
    """Strict ``YYYY-MM-DD`` to date, NULL for anything else."""
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(strict, F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def clean_identity(name: Column) -> Column:
    """Trimmed identity name, NULL when nothing is left."""
    return F.nullif(F.trim(name), F.lit(""))


def is_named(identity: Column) -> Column:
    """False for missing, empty and unknown identities."""
    return F.coalesce((identity != "") & (identity != "Unknown"), F.lit(False))


def image_path(identity: Column, number: Column) -> Column:
    """Relative path of a numbered image: ``Name/Name_0007.jpg``."""
    return F.concat(identity, F.lit("/"), F.format_string("%s_%04d.jpg", identity, number.cast("int")))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def session_key(stream: Column, identity: Column, started_at: Column) -> Column:
    """Deterministic session id: the same session gets the same id in every run."""
    return F.sha2(F.concat_ws("#", stream, identity, F.unix_micros(started_at).cast("string")), 256)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def duration_status(seconds: Column, min_present_seconds: float) -> Column:
    """Attendance status of a closed stay."""
    return F.when(seconds >= F.lit(float(min_present_seconds)), F.lit("PRESENT")).otherwise(F.lit("PARTIAL"))


def is_active(state: Column, ended_at: Column) -> Column:
    """Whether a presence session is still open."""
    return state.isin("PRESENT", "GRACE") & ended_at.isNull()


def journal_minutes(seconds: Column) -> Column:
    """Minutes with one decimal, for the attendance journal."""
    return F.format_string("%.1f", seconds / 60.0)


def journal_check_out(check_out: Column) -> Column:
    return F.coalesce(F.date_format(check_out, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("In Progress"))
