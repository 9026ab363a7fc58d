"""Process templates from a folder of BPMN files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.paths import subject_scope
from trailweave.session import cut_lineage

_NODE = "array<struct<_id:string,_name:string>>"
# Element names of flow nodes and what they stand for.
EVENT_KINDS = {"startEvent": "start", "intermediateCatchEvent": "catch", "intermediateThrowEvent": "throw", "endEvent": "end"}
TASKS = ["sendTask", "receiveTask", "serviceTask", "userTask", "task"]
GATEWAYS = ["exclusiveGateway", "parallelGateway", "inclusiveGateway"]
KINDS = {**EVENT_KINDS, **dict.fromkeys(TASKS, "task"), **dict.fromkeys(GATEWAYS, "gateway")}

_PROCESS = (
    "struct<_id:string,laneSet:struct<lane:" + _NODE + ">,"
    + "sequenceFlow:array<struct<_sourceRef:string,_targetRef:string>>,"
    + ",".join(f"{name}:{_NODE}" for name in KINDS)
    + ">"
)
SCHEMA = (
    "collaboration struct<participant:array<struct<_name:string,_processRef:string>>>, process array<" + _PROCESS + ">"
)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(template_id, process, subject_pattern, pos, type): expected events in order."""
    return template_rows(
        spark.read.format("xml")
        .schema(SCHEMA)
        .option("rowTag", "definitions")
        .option("ignoreNamespace", True)
        .load(path)
        .select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?\z", 1).alias("template_id"), "*")
    )


def template_rows(documents: DataFrame) -> DataFrame:
    """The rows of parsed template documents (``template_id`` and the columns of ``SCHEMA``).

    From the start event (or else a node nothing leads to) the first outgoing flow is
    followed until it ends or repeats.  All templates advance one node per round.
    """
    usable = F.filter("process", lambda p: (F.coalesce(p["_id"], F.lit("")) != "") | (F.size(p["sequenceFlow"]) > 0))
    named = F.filter(F.col("collaboration.participant._name"), lambda n: F.coalesce(n, F.lit("")) != "")
    documents = cut_lineage(
        documents.select(
            "template_id", F.get(usable, F.lit(0)).alias("p"),
            F.get(named, F.lit(0)).alias("participant"),
        )
    )
    lanes = F.filter(F.col("p.laneSet.lane._name"), lambda n: F.coalesce(n, F.lit("")) != "")
    process = F.coalesce("participant", "p._id", F.lit(""))
    heads = documents.select(
        "template_id", process.alias("process"),
        subject_scope(F.coalesce(F.get(lanes, F.lit(0)), F.lit("")), process).alias("subject_pattern"),
    )
    empty = F.array().cast("array<struct<kind:string,id:string,name:string>>")

    def typed_as(kind: str):
        return lambda n: F.struct(
            F.lit(kind).alias("kind"), n["_id"].alias("id"), F.coalesce(n["_name"], F.lit("")).alias("name")
        )

    typed = [F.coalesce(F.transform(F.col(f"p.{name}"), typed_as(kind)), empty) for name, kind in KINDS.items()]
    nodes = documents.select("template_id", F.posexplode(F.concat(*typed)).alias("at", "n")).select("template_id", "at", "n.*")
    flows = documents.select("template_id", F.posexplode("p.sequenceFlow").alias("at", "f")).select(
        "template_id", "at", F.col("f._sourceRef").alias("source"), F.col("f._targetRef").alias("target")
    )
    following = cut_lineage(flows.groupBy("template_id", "source").agg(F.min_by("target", "at").alias("target")))
    incoming = flows.select("template_id", F.col("target").alias("id")).distinct().withColumn("led_to", F.lit(True))
    # The first start event, otherwise the first node that no flow leads to.
    starts = (
        nodes.join(incoming, ["template_id", "id"], "left")
        .where("kind = 'start' OR led_to IS NULL")
        .groupBy("template_id")
        .agg(F.min_by("id", F.struct(F.col("kind") != "start", F.col("at"))).alias("id"))
    )
    walked = front = cut_lineage(starts.select("template_id", F.lit(0).alias("step"), "id"))
    step = 0
    while not front.isEmpty():
        step += 1
        ahead = front.withColumnRenamed("id", "source").join(following, ["template_id", "source"]).select(
            "template_id", F.lit(step).alias("step"), F.col("target").alias("id")
        )
        front = cut_lineage(ahead.join(walked.select("template_id", "id"), ["template_id", "id"], "left_anti").select(*walked.columns))
        walked = cut_lineage(walked.unionByName(front))
    events = walked.join(nodes, ["template_id", "id"]).where(
        F.col("kind").isin(*EVENT_KINDS.values()) & (F.col("name") != "")
    )
    return heads.join(events.select("template_id", F.col("step").alias("pos"), F.col("name").alias("type")), "template_id")
