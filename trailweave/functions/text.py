"""Parsing, formatting and small arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailweave.functions.paths import UUID

# Accepted text shapes.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
_ZONED = r"^([^Z+]{11}[^Z+-]*)(Z|([+-])([0-9]{2}):([0-9]{2}))\z"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"


def rfc3339(text: Column) -> Column:
    """Timestamp of a strict RFC 3339 text, otherwise NULL.

    One shape test and one cast.  Only offsets above 18:00, which Spark's zones do not know,
    and commas take the longer way: the local part is read as UTC and the offset taken off it.
    """
    cut = F.when(text.rlike(RFC3339), text)
    local = F.try_to_timestamp(F.concat(F.replace(F.regexp_extract(text, _ZONED, 1), F.lit(","), F.lit(".")), F.lit("Z")))
    minutes = F.regexp_extract(text, _ZONED, 4).try_cast("int") * 60 + F.regexp_extract(text, _ZONED, 5).try_cast("int")
    offset = F.coalesce(minutes, F.lit(0)) * F.when(F.regexp_extract(text, _ZONED, 3) == "-", -1).otherwise(1)
    odd = F.contains(text, F.lit(",")) | (~text.endswith("Z") & (F.substring(text, -5, 2) >= "18"))
    return F.when(odd, F.when(cut.isNotNull(), local - F.make_dt_interval(mins=offset))).otherwise(F.try_to_timestamp(cut))


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID)


def is_email(text: Column) -> Column:
    return text.rlike(EMAIL)


def parse_sequence(text: Column) -> Column:
    """Steps written with arrows, commas or line breaks."""
    parts = F.split(text, "→|->|[,\\r\\n]")
    return F.filter(
        F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+\z", "")), lambda p: p != ""
    )


def pct(part: Column, whole: Column) -> Column:
    """Whole-number percentage, cut not rounded; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor(part * 100 / whole)).cast("bigint")


def log_intensity(count: Column, busiest: Column) -> Column:
    """Opacity of a cell between 0.14 and 1, on a log scale."""
    share = F.when(busiest > 0, F.log1p(count) / F.log1p(busiest)).otherwise(1.0)
    return F.round(0.14 + 0.86 * share, 3)


def normalise_x(value: Column, low: Column, high: Column) -> Column:
    """Position in [0,1]; a log without span sits at 0."""
    span = F.when(high == low, F.lit(1.0)).otherwise((high - low).cast("double"))
    return (value - low).cast("double") / span


def band_label(first: Column, last: Column, members: Column) -> Column:
    ends = F.concat(first, F.lit(" … "), last, F.lit(" · "), members.cast("string"))
    return F.when(members == 1, first).otherwise(ends)


def variant_label(sequence: Column, length: Column, last: Column, members: Column) -> Column:
    """Type chain, shortened beyond three steps, and how many share it.

    ``sequence`` needs to hold only the first three steps of longer chains.
    """
    chain = (
        F.when(length == 0, "—")
        .when(length <= 3, F.array_join(sequence, " → "))
        .otherwise(
            F.concat(F.element_at(sequence, 1), F.lit(" → … → "), last, F.lit(" ("), length.cast("string"), F.lit(")"))
        )
    )
    return F.concat(chain, F.lit(" · "), members.cast("string"))


def deviation_detail(expected: Column, matched: Column, unexpected: Column, projected: Column) -> Column:
    """Why a subject does not follow a template, first reason first."""
    total = F.size(expected)
    return (
        F.when(
            matched < total,
            F.concat(
                F.lit("stopped at step "), (matched + 1).cast("string"), F.lit("/"), total.cast("string"),
                F.lit(" — missing “"), F.get(expected, matched.cast("int")), F.lit("”"),
            ),
        )
        .when(
            unexpected > 0,
            F.concat(
                F.lit("all steps in order, but "), unexpected.cast("string"), F.lit(" unexpected event(s)")
            ),
        )
        .when(projected > total, F.lit("all steps seen but with extra/repeated events"))
        .otherwise("out of order")
    )
