"""Dotted charts, bands and density grids."""

from pyspark.sql import functions as F

from trailweave.catalog.filters import GRID
from trailweave.catalog.logs import CHAT, DOCS, ORDER, USER, with_logs
from trailweave.operators import space
from trailweave.plans import views
from trailweave.sources.tables import chat_log, order_docs, order_log, user_log


def _grid(spark, sf):
    log = order_log(spark, sf)
    bands = space.subject_bands(log)
    return bands, space.density(space.axis(log), bands)


def density_rows(spark, sf):
    bands, cells = _grid(spark, sf)
    return space.density_rows(cells, bands).select("band", "subjects", "count")


def variant_grid_parts(spark, sf):
    """Bands of equal behaviour with their members, and the cells over them."""
    log = chat_log(spark, sf)
    bands, member = space.variant_bands(log, 10)
    return (bands, member), space.density(space.axis(log), bands, member, 24)


def _view(spark, sf):
    shown = views.space_view(user_log(spark, sf), mode="dots", max_rows=60)
    return shown.marks.select("row", "id", F.round("x", 9).alias("x"), "phase", "subject")


QUERIES = {
    "axis_time": lambda s, d: space.axis_facts(order_log(s, d)),
    "axis_sequence": lambda s, d: space.axis_facts(chat_log(s, d)),
    "dotted_rows": lambda s, d: space.dotted_rows(space.axis(user_log(s, d)), 60),
    "dotted_points": lambda s, d: space.dotted_points(space.axis(user_log(s, d)), 60).withColumn("x", F.round("x", 9)),
    "dotted_points_sequence": lambda s, d: space.dotted_points(space.axis(chat_log(s, d)), 70).withColumn("x", F.round("x", 9)),
    "subject_bands": lambda s, d: space.subject_bands(order_log(s, d)),
    "variant_bands": lambda s, d: space.variant_bands(chat_log(s, d), 10)[0],
    "density": lambda s, d: _grid(s, d)[1],
    "density_rows": density_rows,
    "density_by_variant": lambda s, d: variant_grid_parts(s, d)[1],
    "density_view": lambda s, d: space.density_view(_grid(s, d)[1]).select("row", "col", "opacity"),
    "dominant_phase": lambda s, d: space.dominant_phase(
        user_log(s, d).withColumn("day", F.substring("time", 1, 13)), "day"),
    "auto_detail": lambda s, d: space.detail(order_docs(s, d)),
    "space_view": _view,
}

SIG = """, sig AS (SELECT subject, string_agg(type, chr(1) ORDER BY id) AS v, count(*) AS len, arg_min(type, id) AS a, arg_max(type, id) AS z
   FROM chat_log GROUP BY subject),
 vs AS (SELECT v, any_value(len) AS len, any_value(a) AS a, any_value(z) AS z, count(*) AS m,
        row_number() OVER (ORDER BY count(*) DESC, v) - 1 AS r, count(*) OVER () AS total FROM sig GROUP BY v),
 band AS (SELECT *, CASE WHEN total > 10 AND r >= 9 THEN 9 ELSE r END AS band FROM vs),
 mem AS (SELECT subject, band, len, a, z, sig.v FROM sig JOIN (SELECT v, band FROM band) b ON b.v = sig.v)
"""
_TOP = """, t AS (SELECT *, epoch_us(ts) AS val FROM user_log),
 sub AS (SELECT subject, count(*) AS count, min(val) AS f FROM t GROUP BY subject),
 top AS (SELECT * FROM sub ORDER BY count DESC, subject LIMIT 60),
 rows60 AS (SELECT row_number() OVER (ORDER BY f, subject) - 1 AS row, subject, count FROM top),
 dots AS (SELECT row, round((val - (SELECT min(val) FROM t)) / (SELECT max(val) - min(val) FROM t), 9) AS x, id, type,
   CASE type WHEN 'error' THEN 'error' ELSE 'complete' END AS phase, subject, time FROM t JOIN rows60 USING (subject))
"""

ORACLE = {
    "axis_time": with_logs(ORDER)
    + """SELECT count(*) AS events, true AS by_time, epoch_us(min(time::TIMESTAMP)) AS low, epoch_us(max(time::TIMESTAMP)) AS high FROM order_log""",
    "axis_sequence": with_logs(CHAT)
    + "SELECT count(*) AS events, false AS by_time, 0::BIGINT AS low, count(*) - 1 AS high FROM chat_log",
    "dotted_rows": with_logs(USER) + _TOP + "SELECT row, subject, count FROM rows60",
    "dotted_points": with_logs(USER) + _TOP + "SELECT row, x, id, type, phase, subject, time FROM dots",
    "dotted_points_sequence": with_logs(CHAT)
    + """, t AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS val, count(*) OVER () AS n FROM chat_log),
       top AS (SELECT subject, count(*) AS c, min(val) AS f FROM t GROUP BY subject ORDER BY c DESC, subject LIMIT 70),
       r AS (SELECT subject, row_number() OVER (ORDER BY f, subject) - 1 AS row FROM top)
       SELECT row, round(val / (n - 1), 9) AS x, id, type, 'complete' AS phase, subject, NULL::VARCHAR AS time FROM t JOIN r USING (subject)""",
    "subject_bands": with_logs(GRID)
    + """, b AS (SELECT band, min(subject) AS lo, max(subject) AS hi, count(*) AS m FROM banded GROUP BY band)
       SELECT band, CASE m WHEN 1 THEN lo ELSE lo || ' … ' || hi || ' · ' || m END AS label,
         CASE m WHEN 1 THEN lo WHEN 0 THEN '' ELSE CASE WHEN string_split(lo, '/')[3] = string_split(hi, '/')[3] THEN '/customers/' || string_split(lo, '/')[3] ELSE '/customers' END END AS prefix,
         lo AS "from", hi AS "to", m AS subjects FROM b""",
    "variant_bands": with_logs(CHAT) + SIG
    + """SELECT band, CASE WHEN band = 9 AND any_value(band.total) > 10 THEN '+' || (any_value(band.total) - 9) || ' more variants · ' || sum(m)
         ELSE CASE WHEN any_value(len) <= 3 THEN replace(any_value(v), chr(1), ' → ')
              ELSE any_value(a) || ' → … → ' || any_value(z) || ' (' || any_value(len) || ')' END || ' · ' || sum(m) END AS label,
         CASE WHEN sum(m) = 1 THEN (SELECT min(subject) FROM mem WHERE mem.band = band.band) ELSE '/conversations' END AS prefix,
         '' AS "from", '' AS "to", sum(m)::BIGINT AS subjects FROM band GROUP BY band""",
    "density": with_logs(GRID)
    + """SELECT band AS row, col, count(*) AS count, 'complete' AS phase, min(id) AS min_id, max(id) AS max_id FROM placed GROUP BY band, col""",
    "density_rows": with_logs(GRID)
    + "SELECT band, count(DISTINCT subject) AS subjects, count(*) AS count FROM placed GROUP BY band",
    "density_by_variant": with_logs(CHAT) + SIG
    + """, t AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS val, count(*) OVER () AS n FROM chat_log)
       SELECT band AS row, least(floor(val / (n - 1)::DOUBLE * 24), 23)::BIGINT AS col, count(*) AS count, 'complete' AS phase,
         min(id) AS min_id, max(id) AS max_id FROM t JOIN mem USING (subject) GROUP BY ALL""",
    "density_view": with_logs(GRID)
    + """, c AS (SELECT band AS row, col, count(*) AS n FROM placed GROUP BY band, col)
       SELECT row, col, round(0.14 + 0.86 * ln(1 + n) / ln(1 + max(n) OVER ()), 3) AS opacity FROM c""",
    "dominant_phase": with_logs(USER)
    + """SELECT substr(time, 1, 13) AS day, CASE WHEN count(*) FILTER (type = 'error') * 2 >= count(*) THEN 'error' ELSE 'complete' END AS phase,
       count(*) AS count FROM user_log GROUP BY 1""",
    "auto_detail": with_logs(DOCS)
    + """SELECT count(*) AS events, count(DISTINCT subject) AS subjects,
       CASE WHEN count(DISTINCT subject) > 70 OR count(*) > 6000 THEN 'density' ELSE 'dots' END AS mode FROM order_docs""",
    "space_view": with_logs(USER) + _TOP + "SELECT row, id, x, phase, subject FROM dots",
}
