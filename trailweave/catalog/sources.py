"""Reads, scoped scans, limits, catalogue, sinks."""

from pyspark.sql import functions as F

from trailweave.catalog.logs import CHAT, DOCS, ORDER, USER, with_logs
from trailweave.functions.predicates import Stage
from trailweave.sources import events, models, templates
from trailweave.sources.tables import chat_log, order_docs, order_log, table, user_log
from trailweave.operators.ordering import in_order

SCOPE = Stage(subject="/customers", types=("order.placed", "order.closed.F", "item.R"), lower="1995", upper="19980101")


def event_catalogue(spark, sf):
    chat = chat_log(spark, sf)
    log = user_log(spark, sf).select("type").unionByName(chat.select("type"))
    return events.event_types(log, chat.select("type"))


def mined_models(log):
    """One model document per subject: its own steps as edges, in name order."""
    steps = in_order(log).df.where("prev_type IS NOT NULL").select("subject", "prev_type", "type").distinct()
    edge = F.struct(
        F.concat("prev_type", F.lit(">"), "type").alias("id"), F.col("type"), F.col("prev_type").alias("from"),
        F.col("type").alias("to"), F.when(F.col("type") == "signup", "once").alias("cardinality"),
    )
    field = "array<struct<name:string,type:string,required:boolean,format:string,ref:string,enum:array<string>>>"
    return steps.groupBy(F.col("subject").alias("id")).agg(
        F.sort_array(F.collect_list(edge)).alias("edges")
    ).withColumn(
        "steps", F.array(F.struct(
            F.lit("s1").alias("id"), F.lit("event").alias("kind"), F.lit("click").alias("name"), F.lit("").alias("phase"),
            F.from_json(F.lit('[{"name":"k","type":"integer","required":true}]'), field).alias("fields"),
        ))
    )


def drifted(spark, sf):
    log = user_log(spark, sf)
    now = models.model_revision(mined_models(log))
    earlier = models.model_revision(mined_models(log.where(F.col("time") < "2024-01-28")))
    suites = earlier.select(
        F.concat(F.lit("suite-of-"), "model_id").alias("suite_id"), F.lit("mined").alias("name"),
        F.col("model_id").alias("draft_id"), F.col("revision").alias("draft_rev"),
    )
    return models.drift(suites, now)


def suite_documents(spark, sf):
    """Suites of a hundred neighbouring conversations: every conversation is a case."""
    step = F.struct("id", F.col("type"), F.col("subject"), F.lit("{}").alias("data"))
    cases = chat_log(spark, sf).groupBy("subject").agg(F.array_sort(F.collect_list(step)).alias("turns")).select(
        F.concat(F.lit("suite-"), (F.regexp_extract("subject", r"(\d+)\z", 1).cast("bigint") / 100).cast("bigint").cast("string")).alias("id"),
        F.struct(
            F.col("subject").alias("id"), F.concat(F.lit("talk "), "subject").alias("name"),
            F.transform("turns", lambda t: F.struct(t["type"].alias("type"), t["subject"].alias("subject"), t["data"].alias("data"))).alias("steps"),
            F.struct(F.when(F.size("turns") > 3, "reject").otherwise("accept").alias("outcome"),
                     F.lit(None).cast("string").alias("endState")).alias("expect")).alias("c"))
    return cases.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("cases")).select(
        "id", F.lit("talks").alias("name"), F.lit("chat").alias("draftId"), F.lit(None).cast("string").alias("draftRev"), "cases")


def suite_cases(spark, sf):
    _, cases = models.suite_tables(suite_documents(spark, sf))
    return cases.withColumn("steps", F.array_join("steps", " "))


def template_documents(spark, sf):
    """One process document per customer, as XML text read by its schema."""
    event = lambda tag, key, name: F.concat(F.lit(f'<{tag} id="{key}" name="'), name, F.lit('"/>'))
    flow = lambda a, b: F.lit(f'<sequenceFlow sourceRef="{a}" targetRef="{b}"/>')
    text = F.concat(
        F.lit('<definitions><collaboration><participant name="desk" processRef="p"/></collaboration><process id="p">'),
        event("endEvent", "z", F.concat(F.lit("left-"), F.col("c_nationkey").cast("string"))),
        event("intermediateCatchEvent", "m", F.lower("c_mktsegment")), F.lit('<task id="t" name="serve"/>'),
        event("startEvent", "a", F.lit("came")), flow("t", "m"), flow("a", "t"), flow("m", "z"), F.lit("</process></definitions>"))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("template_id"), F.from_xml(text, templates.SCHEMA, {"rowTag": "definitions"}).alias("d")
    ).select("template_id", "d.*")


QUERIES = {
    "read_suites": suite_cases,
    "read_templates": lambda s, d: templates.template_rows(template_documents(s, d)),
    "scan_scope": lambda s, d: events.scan_scope(order_log(s, d), SCOPE),
    "scan_subtree": lambda s, d: events.scan_subtree(order_docs(s, d), "orders/77"),
    "scan_type": lambda s, d: events.scan_type(user_log(s, d), "purchase", 500),
    "read_limit": lambda s, d: events.read_limit(order_log(s, d), 1000),
    "truncation": lambda s, d: events.truncation(order_log(s, d), 1000),
    "event_types": event_catalogue,
    "log_info": lambda s, d: events.log_info(order_log(s, d)),
    "write_cloudevents": lambda s, d: events.cloudevents(order_docs(s, d), "trailweave", "/_test/run-1", ids="id"),
    "export_replay": lambda s, d: events.replay_feed(user_log(s, d)),
    "model_edges": lambda s, d: models.model_edges(mined_models(user_log(s, d))),
    "model_fields": lambda s, d: models.model_fields(mined_models(user_log(s, d))),
    "model_revision": lambda s, d: models.model_revision(mined_models(user_log(s, d))),
    "drift": drifted,
}

_SCOPED = """FROM order_log WHERE (subject = '/customers' OR starts_with(subject, '/customers/'))
  AND type IN ('order.placed', 'order.closed.F', 'item.R') AND id >= '1995' AND id <= '19980101'"""


def _revision(name: str, rows: str) -> str:
    return f"""{name}_steps AS (
  SELECT DISTINCT subject, p, type FROM (
    SELECT subject, lag(type) OVER (PARTITION BY subject ORDER BY id) AS p, type FROM {rows}) WHERE p IS NOT NULL),
{name} AS (
  SELECT subject AS model_id, substr(sha256('{{"Edges":[' || string_agg(
    '{{"Type":"' || type || '","From":"' || p || '","To":"' || type || '"'
    || CASE WHEN type = 'signup' THEN ',"Cardinality":"once"' ELSE '' END || '}}', ',' ORDER BY p || '>' || type)
    || '],"Events":[{{"Name":"click","Fields":[{{"Name":"k","Type":"integer","Format":"","Ref":"","Required":true,"Enum":null}}]}}]}}'), 1, 12)
    AS revision
  FROM {name}_steps GROUP BY subject)"""


ORACLE = {
    "read_suites": with_logs(CHAT)
    + """, c AS (SELECT subject, string_agg(type, ' ' ORDER BY id) AS steps, count(*) AS n FROM chat_log GROUP BY subject),
       d AS (SELECT *, 'suite-' || (regexp_extract(subject, '[0-9]+$')::BIGINT // 100) AS suite_id FROM c)
       SELECT suite_id, 'chat' AS model_id, (row_number() OVER (PARTITION BY suite_id ORDER BY subject) - 1)::INT AS pos, subject AS case_id,
         'talk ' || subject AS name, steps, CASE WHEN n > 3 THEN 'reject' ELSE 'accept' END AS outcome, '' AS end_state FROM d""",
    "read_templates": """SELECT c_custkey::VARCHAR AS template_id, 'desk' AS process, '' AS subject_pattern, unnest([0, 2, 3])::INT AS pos,
       unnest(['came', lower(c_mktsegment), 'left-' || c_nationkey]) AS type FROM customer""",
    "scan_scope": with_logs(ORDER) + f"SELECT id, source, subject, type, time {_SCOPED}",
    "scan_subtree": with_logs(DOCS)
    + "SELECT id, source, subject, type, time, data FROM order_docs WHERE subject = '/orders/77' OR starts_with(subject, '/orders/77/')",
    "scan_type": with_logs(USER)
    + "SELECT id, source, subject, type, time, data FROM user_log WHERE type = 'purchase' ORDER BY id LIMIT 500",
    "read_limit": with_logs(ORDER) + "SELECT id, source, subject, type, time FROM order_log ORDER BY id LIMIT 1000",
    "truncation": with_logs(ORDER)
    + """SELECT count(*) AS total, least(count(*), 1000) AS loaded, count(*) >= 1000 AS truncated,
       greatest(count(*) - 1000, 0) AS not_loaded FROM order_log""",
    "event_types": with_logs(USER, CHAT)
    + """SELECT type, count(*) AS count, type IN (SELECT type FROM chat_log) AS has_schema
       FROM (SELECT type FROM user_log UNION ALL SELECT type FROM chat_log) GROUP BY type""",
    "log_info": with_logs(ORDER) + "SELECT count(*) AS events FROM order_log",
    "write_cloudevents": with_logs(DOCS)
    + """SELECT '{"specversion":"1.0","type":"' || type || '","source":"trailweave","id":"' || id
       || '","subject":"/_test/run-1' || subject || '","datacontenttype":"application/json","data":' || data || '}' AS value
       FROM order_docs""",
    "export_replay": with_logs(USER) + "SELECT subject AS s, type AS t, time AS ts, id FROM user_log",
    "model_edges": with_logs(USER, _revision("rev", "user_log"))
    + """SELECT subject AS model_id, (row_number() OVER (PARTITION BY subject ORDER BY p || '>' || type) - 1)::INT AS pos,
       p || '>' || type AS edge_id, type, p AS from_node, type AS to_node,
       CASE WHEN type = 'signup' THEN 'once' ELSE '' END AS cardinality FROM rev_steps""",
    "model_fields": with_logs(USER, _revision("rev", "user_log"))
    + """SELECT DISTINCT subject AS model_id, 'click' AS step_name, 0::INT AS pos, 'k' AS name, 'integer' AS type, true AS required,
       '' AS format, '' AS ref, []::VARCHAR[] AS enum FROM rev_steps""",
    "model_revision": with_logs(USER, _revision("rev", "user_log")) + "SELECT model_id, revision FROM rev",
    "drift": with_logs(USER, _revision("rev", "user_log"), _revision("old", "(SELECT * FROM user_log WHERE time < '2024-01-28')"))
    + """SELECT 'suite-of-' || old.model_id AS suite_id, old.model_id AS draft_id, old.revision AS draft_rev,
       rev.revision AS revision, old.revision <> rev.revision AS drifted
       FROM old LEFT JOIN rev ON old.model_id = rev.model_id""",
}
