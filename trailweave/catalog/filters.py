"""Predicates, stages, lookups and lists."""

from pyspark.sql import functions as F

from trailweave.catalog.logs import DOCS, ORDER, USER, with_logs
from trailweave.functions import predicates as p
from trailweave.functions.paths import matches_pattern
from trailweave.operators import counts, space
from trailweave.operators.discovery import discover
from trailweave.plans import views
from trailweave.sources.tables import order_docs, order_log, user_log

COLUMNS = ["id", "source", "subject", "type", "time"]
STAGES = [
    p.Stage(types=("order.placed", "item.A", "item.R")),
    p.Stage(source="ware"),
    p.Stage(subject="customers", lower="1996", upper="1999"),
]
FILTER = p.SpaceFilter(types=("click", "error"), source="app", words=("USERS", "r"), subject_low="/users/1", subject_high="/users/6")


def drilled(spark, sf):
    """What a click on each cell of the user grid would list, summed up per cell."""
    log = user_log(spark, sf)
    bands = space.subject_bands(log)
    cells = space.density(space.axis(log), bands)
    return space.drill(cells, bands, log).groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def approx_check(spark, sf):
    """The exact count, and whether the approximate one comes within five per cent."""
    log = order_docs(spark, sf)
    about = counts.distinct_subjects(log, approximate=True).withColumnRenamed("subjects", "about")
    return counts.distinct_subjects(log).crossJoin(about).select(
        "subjects", (F.abs(F.col("about") - F.col("subjects")) <= 0.05 * F.col("subjects")).alias("within_5_pct"))


QUERIES = {
    "subject_prefix": lambda s, d: order_docs(s, d).where(p.subject_prefix("/orders/1/")).select(*COLUMNS),
    "type_in": lambda s, d: user_log(s, d).where(p.type_in(["click", "view"])).select(*COLUMNS),
    "id_from": lambda s, d: user_log(s, d).where(p.id_from("00000000000000002500")).select(*COLUMNS),
    "id_to": lambda s, d: user_log(s, d).where(p.id_to("00000000000000002500")).select(*COLUMNS),
    "source_contains": lambda s, d: user_log(s, d).where(p.source_contains("p-2")).select(*COLUMNS),
    "stages": lambda s, d: order_log(s, d).where(p.all_stages(STAGES)).select(*COLUMNS),
    "scoped_layers": lambda s, d: views.scoped(
        order_log(s, d), p.Stage(subject="/customers"), STAGES[:2], p.Stage(types=("item.R",))
    ).select(*COLUMNS),
    "needles": lambda s, d: user_log(s, d).where(p.needles(["ERS/1", "C"])).select(*COLUMNS),
    "subject_range": lambda s, d: user_log(s, d).where(p.subject_range("/users/2", "/users/5")).select(*COLUMNS),
    "no_types": lambda s, d: user_log(s, d).where(p.no_types()).select(*COLUMNS),
    "space_filter": lambda s, d: user_log(s, d).where(FILTER.predicate()).select(*COLUMNS),
    "matches_pattern": lambda s, d: order_docs(s, d)
    .where(matches_pattern(F.col("subject"), F.lit("/orders/{id}/items/3")))
    .select(*COLUMNS),
    "last_n": lambda s, d: counts.last_n(order_log(s, d), counts.frame_size("-1000")).select(*COLUMNS),
    "event_lookup": lambda s, d: counts.event_lookup(user_log(s, d), "/users", "00000000000000000007"),
    "inspect_type": lambda s, d: counts.inspect(order_docs(s, d), event_type="order.placed"),
    "inspect_subject": lambda s, d: counts.inspect(order_docs(s, d), subject="/orders/42"),
    "drill": drilled,
    "subgraph_nodes": lambda s, d: discover(order_log(s, d)).subgraph("ITEM")[0],
    "subgraph_edges": lambda s, d: discover(order_log(s, d)).subgraph("ITEM")[1],
    "scoped_or_all_hit": lambda s, d: counts.scoped_or_all(user_log(s, d), "/users/3").select(*COLUMNS),
    "scoped_or_all_miss": lambda s, d: counts.scoped_or_all(user_log(s, d), "/nowhere").select(*COLUMNS),
    "text_filter": lambda s, d: order_docs(s, d).where(p.text_filter('Priority":"5-low')).select(*COLUMNS),
    "funnel": lambda s, d: counts.funnel(order_log(s, d), STAGES),
    "type_counts": lambda s, d: counts.type_counts(order_log(s, d), 4),
    "subject_counts": lambda s, d: counts.subject_counts(order_log(s, d)),
    "distinct_subjects": lambda s, d: counts.distinct_subjects(order_docs(s, d)),
    "distinct_subjects_approx": approx_check,
}

_U = with_logs(USER) + "SELECT id, source, subject, type, time FROM user_log WHERE "
_S1 = "type IN ('order.placed', 'item.A', 'item.R')"
_S2 = "contains(source, 'ware')"
_S3 = "starts_with(subject, '/customers/') AND id >= '1996' AND id <= '1999'"

# Density grid over name bands, shared by the checks of the grid and its drill-down.
GRID = ORDER + """,
names AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS at, count(*) OVER () AS n
          FROM (SELECT DISTINCT subject FROM order_log)),
banded AS (SELECT subject, ntile(70) OVER (ORDER BY subject) - 1 AS band FROM names),
span AS (SELECT epoch_us(min(time::TIMESTAMP)) AS lo, epoch_us(max(time::TIMESTAMP)) AS hi FROM order_log),
placed AS (SELECT o.*, band, least(floor((epoch_us(time::TIMESTAMP) - lo)::DOUBLE / (hi - lo)::DOUBLE * 120), 119)::BIGINT AS col,
             'complete' AS phase
           FROM order_log o JOIN banded USING (subject), span)"""

USER_GRID = USER + """,
banded AS (SELECT subject, ntile(70) OVER (ORDER BY subject) - 1 AS band FROM (SELECT DISTINCT subject FROM user_log)),
span AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM user_log),
placed AS (SELECT u.id, u.subject, band, least(floor((epoch_us(ts) - lo)::DOUBLE / (hi - lo)::DOUBLE * 120), 119)::BIGINT AS col
           FROM user_log u JOIN banded USING (subject), span)"""

ORACLE = {
    "subject_prefix": with_logs(DOCS)
    + "SELECT id, source, subject, type, time FROM order_docs WHERE subject = '/orders/1' OR subject LIKE '/orders/1/%'",
    "type_in": _U + "type = 'click' OR type = 'view'",
    "id_from": _U + "NOT id < '00000000000000002500'",
    "id_to": _U + "NOT id > '00000000000000002500'",
    "source_contains": _U + "source LIKE '%p-2%'",
    "stages": with_logs(ORDER) + f"SELECT id, source, subject, type, time FROM order_log WHERE {_S1} AND {_S2} AND {_S3}",
    "scoped_layers": with_logs(ORDER)
    + "SELECT id, source, subject, type, time FROM order_log WHERE type = 'item.R' AND source = 'warehouse'",
    "needles": _U + "(type ILIKE '%ers/1%' OR subject ILIKE '%ers/1%') AND (type ILIKE '%c%' OR subject ILIKE '%c%')",
    "subject_range": _U + "subject BETWEEN '/users/2' AND '/users/5'",
    "no_types": _U + "false",
    "space_filter": _U
    + """type IN ('click', 'error') AND source LIKE '%app%' AND (type || subject) ILIKE '%users%'
       AND (type ILIKE '%r%' OR subject ILIKE '%r%') AND subject >= '/users/1' AND subject <= '/users/6'""",
    "matches_pattern": with_logs(DOCS)
    + "SELECT id, source, subject, type, time FROM order_docs WHERE regexp_full_match(subject, '/orders/[^/]+/items/3')",
    "last_n": with_logs(ORDER) + "SELECT id, source, subject, type, time FROM order_log ORDER BY id DESC LIMIT 1000",
    "event_lookup": with_logs(USER)
    + """SELECT id, source, subject, type, time, data, CASE type WHEN 'error' THEN 'error' ELSE 'complete' END AS phase
       FROM user_log WHERE id = '00000000000000000007'""",
    "inspect_type": with_logs(DOCS)
    + """SELECT id, source, subject, type, time, data, (SELECT count(*) FROM order_docs WHERE type = 'order.placed') >= 300 AS capped
       FROM order_docs WHERE type = 'order.placed' ORDER BY id LIMIT 300""",
    "inspect_subject": with_logs(DOCS)
    + """SELECT id, source, subject, type, time, data, false AS capped
       FROM order_docs WHERE subject = '/orders/42' OR subject LIKE '/orders/42/%' ORDER BY id LIMIT 300""",
    "drill": with_logs(USER_GRID)
    + """, cells AS (SELECT band, col, min(id) AS a, max(id) AS b FROM placed GROUP BY band, col)
       SELECT c.band AS row, c.col AS col, count(*) AS events, min(p.id) AS first_id, max(p.id) AS last_id
       FROM cells c JOIN placed p ON p.band = c.band AND p.id BETWEEN c.a AND c.b GROUP BY c.band, c.col""",
    "scoped_or_all_hit": _U + "subject = '/users/3'",
    "scoped_or_all_miss": _U + "true",
    "text_filter": with_logs(DOCS)
    + """SELECT id, source, subject, type, time FROM order_docs WHERE data ILIKE '%priority":"5-low%'""",
    "funnel": with_logs(ORDER)
    + f"""SELECT 0::BIGINT AS stage, 'all' AS label, count(*) AS events, count(DISTINCT subject) AS subjects FROM order_log
       UNION ALL SELECT 1, 'type order.placed|item.A|item.R', count(*), count(DISTINCT subject) FROM order_log WHERE {_S1}
       UNION ALL SELECT 2, 'source ware', count(*), count(DISTINCT subject) FROM order_log WHERE {_S1} AND {_S2}
       UNION ALL SELECT 3, 'subject customers · from 1996 · to 1999', count(*), count(DISTINCT subject)
         FROM order_log WHERE {_S1} AND {_S2} AND {_S3}""",
    "type_counts": with_logs(ORDER)
    + """, c AS (SELECT type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, type) AS rank FROM order_log GROUP BY type)
       SELECT rank, type, n AS count FROM c WHERE rank <= 4
       UNION ALL SELECT 5, '+' || count(*) || ' more types', sum(n)::BIGINT FROM c WHERE rank > 4 HAVING count(*) > 0""",
    "subject_counts": with_logs(ORDER) + "SELECT subject, count(*) AS count FROM order_log GROUP BY subject",
    "distinct_subjects_approx": with_logs(DOCS) + "SELECT count(DISTINCT subject) AS subjects, true AS within_5_pct FROM order_docs",
    "distinct_subjects": with_logs(DOCS) + "SELECT count(DISTINCT subject) AS subjects FROM order_docs",
}
