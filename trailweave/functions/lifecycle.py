"""Task and lifecycle phase of an event type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Trailing words of an event type and the phase they stand for.
ERROR_WORDS = "failed failure error errored rejected denied cancelled canceled aborted timeout timedout expired declined".split()
ACTIVE_WORDS = "started starting start initiated requested opened began begun resumed active created submitted queued scheduled".split()
COMPLETE_WORDS = "completed complete finished done succeeded success closed ended fulfilled".split()
INFO_WORDS = "updated changed modified noted logged progress progressed status info recorded observed".split()

# Phases by how much attention they deserve; ties in a cell go to the first.
PHASE_PRIORITY = ["error", "active", "info", "complete"]

_SPLIT = r"(?s)^(.+)[.\-_/]([^.\-_/]+)\z"


def _suffix(event_type: Column) -> Column:
    return F.lower(F.regexp_extract(event_type, _SPLIT, 2))


def phase(event_type: Column) -> Column:
    """``error``, ``active``, ``complete`` or ``info``; no marker means complete."""
    word = _suffix(event_type)
    return (
        F.when(word.isin(ERROR_WORDS), "error")
        .when(word.isin(ACTIVE_WORDS), "active")
        .when(word.isin(COMPLETE_WORDS), "complete")
        .when(word.isin(INFO_WORDS), "info")
        .when(F.lower(event_type).isin(ERROR_WORDS), "error")
        .otherwise("complete")
    )


def task(event_type: Column) -> Column:
    """The type without its lifecycle marker, in its original spelling."""
    marked = _suffix(event_type).isin(ERROR_WORDS + ACTIVE_WORDS + COMPLETE_WORDS + INFO_WORDS)
    return F.when(marked, F.regexp_extract(event_type, _SPLIT, 1)).otherwise(event_type)


def phase_priority(phase_col: Column) -> Column:
    """0 for the phase that wins ties, rising from there."""
    order = F.lit(len(PHASE_PRIORITY))
    for rank, name in reversed(list(enumerate(PHASE_PRIORITY))):
        order = F.when(phase_col == name, rank).otherwise(order)
    return order
