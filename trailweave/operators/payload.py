"""Payload checks against declared fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.payloads import whole_json
from trailweave.functions.text import is_email, is_uuid, rfc3339
from trailweave.operators.machine import Model
from trailweave.session import checked_broadcast, small_table

# Rule name of payloads that cannot be read; not a violation of a field.
BROKEN = "invalid_json"

FIELD_SCHEMA = (
    "type string, fields array<struct<name:string,type:string,required:boolean,format:string,enum:array<string>>>"
)


def field_table(spark: SparkSession, model: Model) -> DataFrame:
    """Declared fields per event type, blank names left out."""
    by_type: dict[str, list] = {}
    for event_type, field in model.fields:
        fields = by_type.setdefault(event_type, [])
        if field.name.strip():
            fields.append({
                "name": field.name.strip(), "type": field.type, "required": field.required, "format": field.format,
                "enum": list(field.enum),
            })
    return small_table(spark, by_type.items(), FIELD_SCHEMA)


def parsed(log: DataFrame) -> DataFrame:
    """Adds ``value`` (the payload as a variant) and ``broken`` (text that is no JSON)."""
    text = F.coalesce("data", F.lit(""))
    value = whole_json(text)
    return log.withColumn("value", value).withColumn("broken", (text != "") & F.col("value").isNull())


def _fault(rule: str | Column, message: str | Column) -> Column:
    lift = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(lift(rule).alias("rule"), lift(message).alias("message"))


def _seen(value: Column, field: Column) -> Column:
    """A declared field next to what the payload holds under its name."""
    return F.struct(
        field.alias("field"), F.coalesce(F.schema_of_variant(value), F.lit("VOID")).alias("kind"),
        F.try_variant_get(value, "$", "string").alias("text"),
    )


def _check(seen: Column, strict_enum: bool) -> Column:
    """The fault of one field, NULL if there is none."""
    field, kind, text = seen["field"], seen["kind"], seen["text"]
    is_number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    number = text.try_cast("double")
    declared, form = field["type"], field["format"]
    missing = F.when(field["required"], _fault("required", "missing required field"))
    texty = ~declared.isin("integer", "number", "boolean")
    plain = texty & ~declared.isin("enum", "datetime")
    listed = (declared == "enum") | (F.lit(strict_enum) & plain)
    unlisted = listed & (F.size(field["enum"]) > 0) & ~F.array_contains(field["enum"], text)
    wants_time = (declared == "datetime") | (plain & (form == "date-time"))
    return (
        F.when(kind == "VOID", missing)
        .when(declared.isin("integer", "number") & ~is_number, _fault("type", F.concat(F.lit("expected type "), declared)))
        .when((declared == "integer") & (kind != "BIGINT") & (number != F.floor(number)), _fault("type", "expected an integer"))
        .when((declared == "boolean") & (kind != "BOOLEAN"), _fault("type", "expected type boolean"))
        .when(texty & (kind != "STRING"), _fault("type", "expected type string"))
        .when(unlisted, _fault("enum", F.concat(F.lit('value "'), text, F.lit('" is not one of the allowed values'))))
        .when(wants_time & rfc3339(text).isNull(), _fault("format", "expected an RFC 3339 date-time"))
        .when(plain & (form == "uuid") & ~is_uuid(text), _fault("format", "expected a UUID"))
        .when(plain & (form == "email") & ~is_email(text), _fault("format", "expected an email address"))
    )


def _faults(log: DataFrame, fields: DataFrame, strict_enum: bool) -> DataFrame:
    """Events with the list of their faults; broken payloads are one fault of their own.

    The payload is parsed once per event; all declared fields of its type are checked
    in place, so events are neither copied per field nor shuffled.
    """
    checked = parsed(log).withColumn("kind", F.schema_of_variant("value")).withColumn(
        "members", F.try_variant_get("value", "$", "map<string,variant>")
    )
    checked = checked.join(checked_broadcast(fields), "type", "left")
    no_object = F.col("kind").isNotNull() & (F.col("kind") != "VOID") & ~F.col("kind").startswith("OBJECT")

    def alone(rule: str, message: str) -> Column:
        return F.array(F.struct(F.lit("").alias("field"), F.lit(rule).alias("rule"), F.lit(message).alias("message")))

    def fault(seen: Column) -> Column:
        return F.struct(seen["field"]["name"].alias("field"), _check(seen, strict_enum).alias("fault"))

    def flat(found: Column) -> Column:
        return F.struct(found["field"].alias("field"), found["fault"]["rule"].alias("rule"), found["fault"]["message"].alias("message"))

    seen = F.transform("fields", lambda f: _seen(F.element_at("members", f["name"]), f))
    # Each field is checked once, before its fault is taken apart.
    each = F.transform(F.filter(F.transform(seen, fault), lambda f: f["fault"].isNotNull()), flat)
    found = (
        F.when(F.col("broken"), alone(BROKEN, "data is not valid JSON"))
        .when(no_object, alone("type", "data must be a JSON object"))
        .otherwise(each)
    )
    # Outer: an inner explode would check every payload twice, once to test for rows.
    return checked.select("id", "subject", "type", F.inline_outer(found)).where("rule IS NOT NULL")


def validate_payload(log: DataFrame, fields: DataFrame, strict_enum: bool = False) -> DataFrame:
    """One row per violation: id, subject, type, field, rule, message."""
    return _faults(log, fields, strict_enum).where(F.col("rule") != BROKEN)


def invalid_payloads(log: DataFrame) -> DataFrame:
    """Events whose payload text is not JSON at all."""
    return parsed(log).where("broken").select("id", "subject", "type")


def payload_faults(log: DataFrame, fields: DataFrame, strict_enum: bool = False) -> DataFrame:
    """Violations and broken payloads together, from one pass."""
    return _faults(log, fields, strict_enum)
