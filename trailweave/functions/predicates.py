"""Boolean columns that narrow a log, and the value objects that carry them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def subject_prefix(prefix: str, subject: str = "subject") -> Column:
    """Segment-aware subtree test: ``/order`` does not contain ``/orders/1``.

    An empty prefix or a bare slash means the whole log.
    """
    want = "/" + prefix.strip("/")
    if want == "/":
        return F.lit(True)
    column = F.col(subject)
    return (column == want) | column.startswith(want + "/")


def type_in(types: list[str]) -> Column:
    return F.col("type").isin(list(types)) if types else F.lit(True)


def id_from(low: str) -> Column:
    return F.col("id") >= low


def id_to(high: str) -> Column:
    return F.col("id") <= high


def source_contains(text: str) -> Column:
    return F.col("source").contains(text)


def needles(words: list[str]) -> Column:
    """Every word occurs in the type or in the subject, whatever the case."""
    tests = [
        F.lower(F.col("type")).contains(word.lower()) | F.lower(F.col("subject")).contains(word.lower())
        for word in words
    ]
    return reduce(and_, tests, F.lit(True))


def subject_range(low: str = "", high: str = "") -> Column:
    test = F.lit(True)
    if low:
        test = test & (F.col("subject") >= low)
    if high:
        test = test & (F.col("subject") <= high)
    return test


def no_types() -> Column:
    """The deliberately empty selection."""
    return F.lit(False)


def text_filter(query: str) -> Column:
    """Case-insensitive search in everything a listed event shows."""
    shown = F.concat_ws(" ", "subject", "type", "time", "source", "data")
    return F.lower(shown).contains(query.lower())


@dataclass(frozen=True)
class Stage:
    """One filter layer; every set field must hold."""

    subject: str = ""
    types: tuple[str, ...] = ()
    lower: str = ""
    upper: str = ""
    source: str = ""

    def predicate(self) -> Column:
        tests = []
        if self.subject:
            tests.append(subject_prefix(self.subject))
        if self.types:
            tests.append(type_in(list(self.types)))
        if self.lower:
            tests.append(id_from(self.lower))
        if self.upper:
            tests.append(id_to(self.upper))
        if self.source:
            tests.append(source_contains(self.source))
        return reduce(and_, tests, F.lit(True))

    def label(self) -> str:
        parts = [
            f"subject {self.subject}" if self.subject else "",
            f"type {'|'.join(self.types)}" if self.types else "",
            f"from {self.lower}" if self.lower else "",
            f"to {self.upper}" if self.upper else "",
            f"source {self.source}" if self.source else "",
        ]
        return " · ".join(part for part in parts if part) or "any"


@dataclass(frozen=True)
class SpaceFilter(Stage):
    """A stage plus free-text words, a subject range and the empty selection."""

    words: tuple[str, ...] = field(default=())
    subject_low: str = ""
    subject_high: str = ""
    nothing: bool = False

    def predicate(self) -> Column:
        if self.nothing and not self.types:
            return no_types()
        return super().predicate() & subject_range(self.subject_low, self.subject_high) & needles(list(self.words))


def all_stages(stages: list[Stage]) -> Column:
    """Scope, shared stages and lens all hold; empty layers cost nothing."""
    return reduce(and_, [stage.predicate() for stage in stages], F.lit(True))
