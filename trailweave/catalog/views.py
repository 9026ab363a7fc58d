"""The composed views, and what lies behind a reference, a failure or a cell."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailweave.catalog import conformance as cf
from trailweave.catalog import discovery, relations, space
from trailweave.catalog.logs import CHAT, DOCS, with_logs
from trailweave.functions.predicates import Stage
from trailweave.operators import conformance as c
from trailweave.operators.relations import referenced_events
from trailweave.operators.space import drill
from trailweave.plans import views
from trailweave.sources.tables import chat_log, order_docs, order_log, user_log

COLUMNS = ["id", "source", "subject", "type", "time"]
CUSTOMERS = Stage(subject="/customers")


def mixed(spark, sf):
    """Orders and user activity in one log."""
    return order_log(spark, sf).select(*COLUMNS).unionByName(user_log(spark, sf).select(*COLUMNS))


def behind_orders(spark, sf):
    """Events of everything that any event of the log refers to."""
    docs = relations.catalogue_docs(spark, sf)
    return referenced_events(docs, docs).select("id", "subject", "type")


def drilled_variants(spark, sf):
    (bands, member), cells = space.variant_grid_parts(spark, sf)
    return drill(cells, bands, chat_log(spark, sf), member).groupBy("row", "col").agg(F.count(F.lit(1)).alias("events"))


def failing(spark, sf):
    return c.failing_sequences(cf.verdicts(spark, sf), order_docs(spark, sf)).select(
        "subject", "reason", "block", F.array_join("types", " ").alias("types"))


QUERIES = {
    "process_view_nodes": lambda s, d: views.process_view(mixed(s, d), scope=CUSTOMERS).nodes,
    "process_view_variants": lambda s, d: views.process_view(mixed(s, d), scope=CUSTOMERS).variants,
    "space_view_auto": lambda s, d: views.space_view(order_log(s, d)).marks.select("row", "col", "opacity"),
    "relations_view": lambda s, d: views.relations_view(relations.catalogue_docs(s, d))[2],
    "event_list": lambda s, d: views.event_list(order_docs(s, d), event_type="order.placed", search='Priority":"5-low').select(*COLUMNS),
    "model_view_fit": lambda s, d: views.model_view(mixed(s, d), cf.ORDER_MODEL).fit,
    "model_view_deviations": lambda s, d: views.model_view(mixed(s, d), cf.ORDER_MODEL).deviations,
    "model_view_unknown": lambda s, d: views.model_view(mixed(s, d), cf.ORDER_MODEL).unknown,
    "template_view": lambda s, d: views.template_view(mixed(s, d), cf.TEMPLATE).summary,
    "template_view_coverage": lambda s, d: views.template_view(mixed(s, d), cf.TEMPLATE).coverage,
    "referenced_events": behind_orders,
    "failing_sequences": failing,
    "drill_by_variant": drilled_variants,
}

ORACLE = {
    "process_view_nodes": discovery.ORACLE["nodes"],
    "process_view_variants": discovery.ORACLE["variants"],
    "space_view_auto": space.ORACLE["density_view"],
    "relations_view": relations.ORACLE["reference_edges"],
    "event_list": with_logs(DOCS)
    + """SELECT id, source, subject, type, time FROM (SELECT * FROM order_docs WHERE type = 'order.placed' ORDER BY id LIMIT 300)
       WHERE data ILIKE '%priority":"5-low%'""",
    "model_view_fit": cf.ORACLE["model_fit"],
    "model_view_deviations": cf.ORACLE["model_deviations"],
    "model_view_unknown": cf.ORACLE["unknown_types"],
    "template_view": cf.template_sql(cf.ORDER, "order_log", cf.TEMPLATE, "/customers/[^/]+/orders")
    + """SELECT (SELECT count(DISTINCT subject) FROM order_log) AS total_subjects, count(*) AS in_scope, count(*) FILTER (relevant) AS relevant,
       count(*) FILTER (conforming) AS conforming, count(*) FILTER (conforming) * 100 // count(*) FILTER (relevant) AS fit_pct FROM res""",
    "template_view_coverage": cf.ORACLE["step_coverage"],
    "referenced_events": """SELECT 'p' || lpad(p_partkey::VARCHAR, 12, '0') AS id, '/parts/' || p_partkey AS subject, 'part.created' AS type
       FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""",
    "failing_sequences": cf.JUDGED
    + """SELECT subject, any_value(reason) AS reason, 0::BIGINT AS block, string_agg(type, ' ' ORDER BY id) AS types
       FROM judged JOIN order_docs USING (subject) WHERE rejected GROUP BY subject""",
    "drill_by_variant": with_logs(CHAT) + space.SIG
    + """, t AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS val, count(*) OVER () AS n FROM chat_log),
       g AS (SELECT band, least(floor(val / (n - 1)::DOUBLE * 24), 23)::BIGINT AS col, min(id) AS a, max(id) AS b
             FROM t JOIN mem USING (subject) GROUP BY ALL)
       SELECT g.band AS row, g.col, count(*) AS events FROM g JOIN mem ON mem.band = g.band
       JOIN chat_log l ON l.subject = mem.subject AND l.id BETWEEN g.a AND g.b GROUP BY ALL""",
}
