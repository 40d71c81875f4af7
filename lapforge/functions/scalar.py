"""Scalar column functions: durations, labels, parsing and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapforge.schema import NANOS

DASH = "—"


def seconds(duration_ns: Column) -> Column:
    return duration_ns / F.lit(float(NANOS))


def clock_text(value: Column) -> Column:
    """Seconds as HH:MM:SS.mmm, the milliseconds cut off and not rounded."""
    within_minute = (value % 3600) % 60
    fraction = within_minute - F.floor(within_minute)
    return F.format_string(
        "%02d:%02d:%02d.%03d", F.floor(value / 3600), F.floor((value % 3600) / 60),
        F.floor(within_minute), F.floor(fraction * 1000))


def lap_text(duration_ns: Column) -> Column:
    """First ten characters of a duration's clock text: tenths appear only if a fraction exists."""
    whole = F.floor(duration_ns / F.lit(NANOS))
    rest = duration_ns % F.lit(NANOS)
    clock = F.format_string(
        "%02d:%02d:%02d", F.floor(whole / 3600) % 24, F.floor(whole / 60) % 60, whole % 60)
    tenth = F.concat(F.lit("."), F.floor(rest / F.lit(NANOS // 10)).cast("string"))
    return F.when(duration_ns.isNotNull(), F.concat(clock, F.when(rest != 0, tenth).otherwise("")))


def _nearest_step(value: Column, scaled: list[int]) -> Column:
    """Whole number nearest to value * sum(scaled), ties to even, decided on the exact product.

    Multiplying by 10 or 100 already rounds and can create a tie that is none (21.95 is below its
    own decimal text). Products with powers of two are exact, and so are the differences below, as
    their terms lie within a factor of two of each other.
    """
    floor = F.floor(value * sum(scaled))
    rest = value * scaled[0] - (floor + F.lit(0.5))
    for factor in scaled[1:]:
        rest = rest + value * factor
    return floor + F.when(rest > 0, 1).when(rest == 0, F.pmod(floor, F.lit(2))).otherwise(0)


def round_cents(value: Column) -> Column:
    """Two decimals the way a correctly rounded decimal conversion gives them; for values >= 0."""
    return _nearest_step(value, [64, 32, 4]) / F.lit(100.0)


def frame_seconds(frame: Column, fps: Column) -> Column:
    """Frame time to two decimals, ties to even; the frame rate is cut to an integer first."""
    return round_cents(frame / fps.cast("int"))


def distance_text(distance: Column, has_curb: Column) -> Column:
    return F.when(has_curb & distance.isNotNull(),
                  F.concat(distance.cast("bigint").cast("string"), F.lit("px"))).otherwise("N/A")


def parse_flag(text: Column) -> Column:
    """"True"/"False" text; anything else, NULL included, is false."""
    return F.coalesce(F.lower(F.trim(text)) == "true", F.lit(False))


def parse_distance(text: Column) -> Column:
    """First run of digits as a number, NULL if there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).cast("double")


def one_decimal(value: Column) -> Column:
    """One decimal, correctly rounded; Java's own formatting rounds the decimal text half up."""
    value = value.cast("double")
    tenths = _nearest_step(F.abs(value), [8, 2])
    sign = F.when(value < 0, "-").otherwise("")
    text = F.format_string("%s%d.%d", sign, F.floor(tenths / 10), tenths % 10)
    return F.when(value.isNotNull(), text)


def percent_text(value: Column) -> Column:
    return F.concat(one_decimal(value), F.lit("%"))


def thousands(value: Column) -> Column:
    return F.format_number(value, 0)


def clamp_value(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def circuit_key(name: Column) -> Column:
    """File-name key: lower case, blanks and slashes as underscores."""
    return F.translate(F.lower(name), " /", "__")


def utc_text(moment: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# -- session stems -------------------------------------------------------------------------------


def stem_parts(stem: Column) -> Column:
    return F.split(stem, "_")


def session_option(stem: Column, event_name: Column, session_label: Column) -> Column:
    """Label of a three-part stem, the stem itself otherwise."""
    parts = stem_parts(stem)
    label = F.concat(F.lit("Round "), parts[1], F.lit(": "), event_name, F.lit(" - "), session_label)
    return F.when(F.size(parts) == 3, label).otherwise(stem)


def option_round(label: Column) -> Column:
    """Sort key of a label: its round number, 999 when it has none."""
    text = F.regexp_extract(label, r"Round ([^:]*)", 1)
    return F.coalesce(text.try_cast("int"), F.lit(999))


def header_round(stem: Column) -> Column:
    """Round from a stem of three or more parts, else 1."""
    parts = stem_parts(stem)
    return F.when(F.size(parts) >= 3, parts[1].try_cast("int")).otherwise(F.lit(1))


def header_session(stem: Column) -> Column:
    parts = stem_parts(stem)
    return F.when(F.size(parts) >= 3, parts[2]).otherwise(F.lit("Q"))
