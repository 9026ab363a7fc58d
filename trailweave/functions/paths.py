"""Subject paths: id segments, patterns, prefixes, collections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a UUID and what field names point elsewhere.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
REFERENCE_FIELD = r"^(?!id\z)([^\n]+?)(ids|id|refs|ref)\z"
ID_SEGMENT = "{id}"

# Digits only; 16 or more hex digits; a UUID; 12 or more letters and digits with a digit
# among them; 4 or more of letters, digits, dashes and underscores with a digit and a dash or underscore.
_ID = (
    r"^(?:[0-9]+|[0-9A-Fa-f]{16,}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|(?=[^0-9]*+[0-9])(?:[0-9A-Za-z]{12,}|(?=[^_-]*+[_-])[0-9A-Za-z_-]{4,}))\z"
)


def is_id(segment: Column) -> Column:
    """Whether a path segment has the shape of a generated key."""
    return F.coalesce(segment.rlike(_ID), F.lit(False))


def segments(path: Column) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def collapse(segment: Column) -> Column:
    return F.when(is_id(segment), F.lit(ID_SEGMENT)).otherwise(segment)


def subject_pattern(subject: Column) -> Column:
    """``/orders/17/items`` becomes ``/orders/{id}/items``."""
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(subject), collapse), "/"))


def _trimmed(path: Column) -> Column:
    return F.regexp_replace(path, r"^/+|/+\z", "")


def whole_segments(path: Column) -> Column:
    """Segments between the outer slashes, empty ones inside included."""
    return F.split(_trimmed(path), "/", -1)


def matches_pattern(subject: Column, pattern: Column) -> Column:
    """Same number of segments; ``{id}`` in the pattern stands for any segment."""
    have, want = whole_segments(subject), whole_segments(pattern)
    same = F.forall(
        F.zip_with(have, want, lambda h, w: (w == ID_SEGMENT) | (h == w)), lambda ok: F.coalesce(ok, F.lit(False))
    )
    return (F.size(have) == F.size(want)) & same


def matches_literal(subject: Column, pattern: str) -> Column:
    """``matches_pattern`` for a pattern known when the query is written: one regex."""
    wanted = pattern.strip("/").split("/")

    def part(index: int, name: str) -> str:
        inner = 0 < index < len(wanted) - 1 or len(wanted) == 1
        return ("[^/]*" if inner else "[^/]+") if name == ID_SEGMENT else "".join(
            c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in name
        )

    return subject.rlike("^/*" + "/".join(part(i, name) for i, name in enumerate(wanted)) + r"/*\z")


def scope_prefix(pattern: Column) -> Column:
    """Literal path before the first ``{id}``, empty if there is none."""
    parts = segments(pattern)
    cut = F.array_position(parts, F.lit(ID_SEGMENT))
    kept = F.when(cut > 0, F.slice(parts, F.lit(1), (cut - 1).cast("int"))).otherwise(parts)
    return F.when(F.size(kept) > 0, F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise("")


def subject_scope(lane: Column, process: Column) -> Column:
    """Pattern of the subjects a process template speaks about."""
    name = _trimmed(F.regexp_replace(lane, r"^\s+|\s+\z", ""))
    tail = F.when(process != "", F.concat(F.lit("/"), process)).otherwise("")
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "")
        .when(name.contains("/"), subject_pattern(name))
        .otherwise(F.concat(F.lit("/"), name, F.lit("/" + ID_SEGMENT), F.coalesce(tail, F.lit(""))))
    )


def style_prefix(style: Column) -> Column:
    """Static start of a subject style such as ``/orders/{id}``, cut back to whole segments."""
    text = F.regexp_replace(style, r"^\s+|\s+\z", "")
    head = F.regexp_replace(F.substring_index(text, "{", 1), r"[^/]*\z", "")
    return F.regexp_replace(F.when(F.contains(text, F.lit("{")), head).otherwise(text), r"/+\z", "")


def first_segment(subject: Column) -> Column:
    """First path segment in lower case, empty when there is none."""
    return F.lower(F.regexp_extract(subject, "([^/]+)", 1))


def reference_stem(field: Column) -> Column:
    """``customerId`` gives ``customer``; empty when the name is no reference."""
    return F.regexp_extract(F.lower(field), REFERENCE_FIELD, 1)


def reference_suffix(field: Column) -> Column:
    return F.regexp_extract(F.lower(field), REFERENCE_FIELD, 2)


def reference_collection(field: Column) -> Column:
    """Naive plural of the collection a field refers to, NULL if it refers to none."""
    return plural_of(reference_stem(F.regexp_replace(field, r"^\s+|\s+\z", "")))


def plural_of(stem: Column) -> Column:
    return F.when(stem == "", F.lit(None)).when(stem.endswith("s"), stem).otherwise(F.concat(stem, F.lit("s")))


def common_path_prefix(first: Column, last: Column, members: Column) -> Column:
    """Shared path of a set of subjects given its smallest and largest member.

    The common prefix of a sorted set is the common prefix of its two ends, so the
    set itself is never gathered.
    """
    size = F.least(F.length(first), F.length(last))
    shared = F.size(
        F.filter(
            F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
            lambda n: F.substring(first, F.lit(1), n) == F.substring(last, F.lit(1), n),
        )
    )
    text = F.substring(first, F.lit(1), shared)
    cut = F.regexp_extract(text, r"(?s)^(.+)/[^/]*\z", 1)
    return F.when(members == 1, first).otherwise(cut)


def slugify(label: Column) -> Column:
    """Lower-case slug of letters, digits and single dashes."""
    kept = F.regexp_replace(F.lower(label), r"[^a-z0-9 \-_/]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[ \-_/]+", "-"), r"^-|-\z", "")


def apply_subject_style(style: Column, instance: Column, namespace: Column, name: Column) -> Column:
    """Subject of one instance; ``{...}`` placeholders become the instance id."""
    text = F.regexp_replace(style, r"^\s+|\s+\z", "")
    escaped = F.regexp_replace(instance, r"([\\$])", r"\\$1")
    # A lone brace swallows text up to the end, as an unfinished placeholder does.
    filled = F.regexp_replace(F.regexp_replace(text, r"\{[^}]*\z", ""), r"\{[^}]*\}|\}", escaped)
    base = F.coalesce(
        F.nullif(slugify(namespace), F.lit("")), F.nullif(slugify(name), F.lit("")), F.lit("entity")
    )
    rooted = F.when(filled.startswith("/"), filled).otherwise(F.concat(F.lit("/"), filled))
    return F.when(F.coalesce(text, F.lit("")) == "", F.concat(F.lit("/"), base, F.lit("/"), instance)).otherwise(rooted)
