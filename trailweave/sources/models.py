"""Model and test-suite documents as tables, and the revision of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL_SCHEMA = """
id string, name string, namespace string, subjectStyle string,
nodes array<struct<id:string,label:string,start:boolean,end:boolean>>,
edges array<struct<id:string,type:string,from:string,to:string,cardinality:string>>,
steps array<struct<id:string,kind:string,name:string,phase:string,
  fields:array<struct<name:string,type:string,required:boolean,format:string,ref:string,enum:array<string>>>>>
"""

SUITE_SCHEMA = """
id string, name string, draftId string, draftRev string,
cases array<struct<id:string,name:string,
  steps:array<struct<type:string,subject:string,data:string>>,
  expect:struct<outcome:string,endState:string>>>
"""


def read_model_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path)


def model_nodes(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("model_id"), F.posexplode("nodes").alias("pos", "n")).select(
        "model_id", "pos", F.col("n.id").alias("node_id"), F.coalesce("n.label", F.lit("")).alias("label"),
        F.coalesce("n.start", F.lit(False)).alias("is_start"), F.coalesce("n.end", F.lit(False)).alias("is_end"),
    )


def model_edges(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("model_id"), F.posexplode("edges").alias("pos", "e")).select(
        "model_id", "pos", F.col("e.id").alias("edge_id"), F.coalesce("e.type", F.lit("")).alias("type"),
        F.col("e.from").alias("from_node"), F.col("e.to").alias("to_node"),
        F.coalesce("e.cardinality", F.lit("")).alias("cardinality"),
    )


def model_steps(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("id").alias("model_id"), F.posexplode("steps").alias("pos", "s")).select(
        "model_id", "pos", F.col("s.id").alias("step_id"), F.col("s.kind").alias("kind"),
        F.col("s.name").alias("name"), F.col("s.phase").alias("phase"), F.col("s.fields").alias("fields"),
    )


def model_fields(documents: DataFrame) -> DataFrame:
    """Declared payload fields; the first event step of a name is the one that counts."""
    steps = model_steps(documents).where("kind = 'event'")
    first = steps.groupBy("model_id", "name").agg(F.min_by("fields", "pos").alias("fields"))
    return first.select("model_id", F.col("name").alias("step_name"), F.posexplode("fields").alias("pos", "f")).select(
        "model_id", "step_name", "pos", F.trim("f.name").alias("name"), F.coalesce("f.type", F.lit("")).alias("type"),
        F.coalesce("f.required", F.lit(False)).alias("required"), F.coalesce("f.format", F.lit("")).alias("format"),
        F.coalesce("f.ref", F.lit("")).alias("ref"),
        F.coalesce("f.enum", F.array().cast("array<string>")).alias("enum"),
    )


def fields_by_type(fields: DataFrame, model_id: str) -> DataFrame:
    """Field rows of one model in the shape the payload check takes."""
    one = fields.where((F.col("model_id") == model_id) & (F.col("name") != ""))
    members = F.array_sort(F.collect_list(F.struct("pos", "name", "type", "required", "format", "enum")))
    shaped = F.transform(
        "m", lambda f: F.struct(f["name"].alias("name"), f["type"].alias("type"), f["required"].alias("required"),
                                f["format"].alias("format"), f["enum"].alias("enum")))
    return one.groupBy(F.col("step_name").alias("type")).agg(members.alias("m")).select("type", shaped.alias("fields"))


def read_suites(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Suites (suite_id, name, draft_id, draft_rev) and their cases."""
    return suite_tables(spark.read.schema(SUITE_SCHEMA).option("multiLine", True).json(path))


def suite_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    suites = documents.select(
        F.col("id").alias("suite_id"), "name", F.col("draftId").alias("draft_id"),
        F.coalesce("draftRev", F.lit("")).alias("draft_rev"),
    )
    cases = documents.select(
        F.col("id").alias("suite_id"), F.col("draftId").alias("model_id"), F.posexplode("cases").alias("pos", "c")
    ).select(
        "suite_id", "model_id", "pos", F.col("c.id").alias("case_id"), F.col("c.name").alias("name"),
        F.coalesce(F.col("c.steps.type"), F.array().cast("array<string>")).alias("steps"),
        F.col("c.expect.outcome").alias("outcome"), F.coalesce("c.expect.endState", F.lit("")).alias("end_state"),
    )
    return suites, cases


def _text(value: Column) -> Column:
    """A JSON string with the characters <, > and & escaped."""
    framed = F.regexp_extract(F.to_json(F.struct(F.coalesce(value, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)
    for mark, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        framed = F.replace(framed, F.lit(mark), F.lit(code))
    return framed


def _list(items: Column) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit("null")).otherwise(
        F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    )


def model_revision(documents: DataFrame) -> DataFrame:
    """(model_id, revision): 12 hex digits over everything that can change an outcome.

    Edges (type, ends, cardinality) and event steps with their fields count; layout,
    names and times do not.
    """
    edge = lambda e: F.concat(
        F.lit('{"Type":'), _text(e["type"]), F.lit(',"From":'), _text(e["from"]), F.lit(',"To":'), _text(e["to"]),
        F.when(F.coalesce(e["cardinality"], F.lit("")) != "", F.concat(F.lit(',"Cardinality":'), _text(e["cardinality"])))
        .otherwise(""), F.lit("}"),
    )
    field = lambda f: F.concat(
        F.lit('{"Name":'), _text(f["name"]), F.lit(',"Type":'), _text(f["type"]), F.lit(',"Format":'), _text(f["format"]),
        F.lit(',"Ref":'), _text(f["ref"]), F.lit(',"Required":'),
        F.when(F.coalesce(f["required"], F.lit(False)), "true").otherwise("false"),
        F.lit(',"Enum":'),
        F.when(f["enum"].isNull(), F.lit("null")).otherwise(
            F.concat(F.lit("["), F.array_join(F.transform(f["enum"], _text), ","), F.lit("]"))),
        F.lit("}"),
    )
    event = lambda s: F.concat(
        F.lit('{"Name":'), _text(s["name"]), F.lit(',"Fields":'), _list(F.transform(s["fields"], field)), F.lit("}")
    )
    events = F.filter("steps", lambda s: s["kind"] == "event")
    body = F.concat(
        F.lit('{"Edges":'), _list(F.transform("edges", edge)), F.lit(',"Events":'), _list(F.transform(events, event)), F.lit("}")
    )
    return documents.select(F.col("id").alias("model_id"), F.substring(F.sha2(body, 256), 1, 12).alias("revision"))


def drift(suites: DataFrame, revisions: DataFrame) -> DataFrame:
    """Suites and whether they were written against another revision of their model."""
    joined = suites.join(revisions.withColumnRenamed("model_id", "draft_id"), "draft_id", "left")
    changed = (F.col("draft_rev") != "") & F.col("revision").isNotNull() & (F.col("draft_rev") != F.col("revision"))
    return joined.select("suite_id", "draft_id", "draft_rev", "revision", changed.alias("drifted"))
