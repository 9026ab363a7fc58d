"""Discovery of the order and chat processes."""

from pyspark.sql import functions as F

from trailweave.catalog.logs import CHAT, ORDER, USER, with_logs
from trailweave.operators import variants as v
from trailweave.operators.discovery import discover, share_of
from trailweave.operators.ordering import sequences
from trailweave.sources.tables import chat_log, order_log, user_log


def _order(spark, sf):
    return discover(order_log(spark, sf))


def _runs(spark, sf):
    return discover(order_log(spark, sf), keep=True)


def variant_share(spark, sf):
    found = _runs(spark, sf)
    return share_of(v.variants(found).select("sequence", "count"), found.totals)


def marked_log(spark, sf):
    """The activity of users with lifecycle markers by id."""
    marks = F.array(*map(F.lit, ("-started", ".completed", "_failed", "")))
    mark = F.element_at(marks, (F.substring("id", -2, 2).cast("int") % 4 + 1).cast("int"))
    return user_log(spark, sf).withColumn("type", F.concat("type", mark))


def cyclic_log(spark, sf):
    """Users as they turn from day to day: sparse steps, some of them in rings."""
    log = user_log(spark, sf)
    day = F.substring("time", 9, 2).cast("int")
    return log.select("id", "subject", F.concat(F.lit("d"), (F.floor(day / 4) % 5).cast("string")).alias("type")).where(
        day % 4 != 3).unionByName(log.where(day % 4 == 3).select("id", "subject", "type"))


QUERIES = {
    "sequences": lambda s, d: sequences(order_log(s, d)).select(
        "subject", "block", F.array_join("types", " ").alias("types")),
    "node_stats": lambda s, d: _order(s, d).node_stats,
    "node_stats_users": lambda s, d: discover(user_log(s, d)).node_stats,
    "boundary_types": lambda s, d: _order(s, d).boundary_types,
    "split_runs": lambda s, d: v.split_runs(discover(order_log(s, d), together=True)),
    "split_runs_users": lambda s, d: v.split_runs(discover(user_log(s, d), together=True)),
    "directly_follows": lambda s, d: _order(s, d).directly_follows,
    "directly_follows_users": lambda s, d: discover(user_log(s, d)).directly_follows,
    "directly_follows_unsplit": lambda s, d: discover(user_log(s, d), start_types=("",), end_types=("",)).directly_follows,
    "traces": lambda s, d: _order(s, d).totals.select("traces"),
    "graph_totals": lambda s, d: discover(chat_log(s, d)).totals,
    "concurrent_pairs": lambda s, d: _order(s, d).concurrent_pairs,
    "concurrent_groups": lambda s, d: _order(s, d).concurrent_groups,
    "canonicalise": lambda s, d: v.canonicalise(_runs(s, d)),
    "variants": lambda s, d: v.variants(_runs(s, d), 8),
    "variants_all": lambda s, d: v.variants(discover(chat_log(s, d), keep=True)),
    "variant_steps": lambda s, d: v.variant_steps(_runs(s, d), 8),
    "variant_share": variant_share,
    "edges": lambda s, d: _order(s, d).edges,
    "ranks": lambda s, d: _order(s, d).ranks,
    "nodes": lambda s, d: _order(s, d).nodes,
    "task_groups": lambda s, d: discover(marked_log(s, d)).task_groups(),
    "concurrent_groups_marked": lambda s, d: discover(marked_log(s, d)).concurrent_groups,
    "ranks_cyclic": lambda s, d: discover(cyclic_log(s, d)).ranks,
    "edges_cyclic": lambda s, d: discover(cyclic_log(s, d)).edges,
    "node_stats_marked": lambda s, d: discover(marked_log(s, d)).node_stats,
    "downstream_nodes": lambda s, d: _order(s, d).downstream("order.placed", 1)[0],
    "downstream_edges": lambda s, d: _order(s, d).downstream("order.placed", None)[1],
}


def graph(log: str, source: str) -> str:
    """Sequences, runs, edges, concurrency and canonical order of a log, in SQL."""
    return with_logs(log) + f""", s AS (
  SELECT subject, id, type, row_number() OVER w AS pos, lag(type) OVER w AS prev, lead(type) OVER w AS nxt
  FROM {source} WINDOW w AS (PARTITION BY subject ORDER BY id)),
starts AS (SELECT DISTINCT type FROM s WHERE prev IS NULL),
ends AS (SELECT DISTINCT type FROM s WHERE nxt IS NULL),
stats AS (SELECT type, count(*) AS count, count(*) FILTER (prev IS NULL) AS start_count,
          count(*) FILTER (nxt IS NULL) AS end_count FROM s GROUP BY type),
brk AS (SELECT *, (prev IS NULL OR (prev <> type AND prev IN (FROM ends) AND type IN (FROM starts)))::INT AS b FROM s),
runs AS (SELECT *, sum(b) OVER (PARTITION BY subject ORDER BY id)::BIGINT AS run FROM brk),
steps AS (SELECT *, row_number() OVER (PARTITION BY subject, run ORDER BY id) AS step,
          lag(type) OVER (PARTITION BY subject, run ORDER BY id) AS p FROM runs),
dfg AS (SELECT p AS f, type AS t, count(*) AS n FROM steps WHERE p IS NOT NULL GROUP BY ALL),
par AS (SELECT x.f AS a, x.t AS b, x.n AS fwd, y.n AS rev FROM dfg x JOIN dfg y ON x.f = y.t AND x.t = y.f
        WHERE x.f < x.t AND least(x.n, y.n) >= 2 AND abs(x.n - y.n)::DOUBLE / (x.n + y.n + 1) <= 0.5),
sym AS (SELECT a, b FROM par UNION SELECT b, a FROM par),
reach AS (SELECT a AS t, a AS m FROM sym UNION SELECT reach.t, sym.b FROM reach JOIN sym ON reach.m = sym.a),
grp AS (SELECT t AS type, min(m) AS grp FROM reach GROUP BY t),
flagged AS (SELECT steps.*, grp.grp, lag(grp.grp) OVER (PARTITION BY subject, run ORDER BY id) AS pg
            FROM steps LEFT JOIN grp USING (type)),
isl AS (SELECT *, sum(CASE WHEN grp = pg THEN 0 ELSE 1 END) OVER (PARTITION BY subject, run ORDER BY id) AS island FROM flagged),
canon AS (SELECT subject, run, row_number() OVER (PARTITION BY subject, run ORDER BY island, type, id) AS step, type FROM isl),
seqs AS (SELECT subject, run, string_agg(type, ' ' ORDER BY step) AS sequence, count(*) AS length FROM canon GROUP BY ALL),
tally AS (SELECT sequence, length, count(*) AS count FROM seqs GROUP BY sequence, length),
vars AS (SELECT sequence, length, count, (count * 100 // sum(count) OVER ())::BIGINT AS pct,
         row_number() OVER (ORDER BY count DESC, sequence) AS rank FROM tally),
edge AS (SELECT f, t, n, EXISTS (SELECT 1 FROM sym WHERE a = f AND b = t) AS parallel FROM dfg),
way AS (SELECT type AS t, 0::BIGINT AS d FROM starts UNION
        SELECT edge.t, d + 1 FROM way JOIN edge ON edge.f = way.t WHERE NOT parallel AND edge.f <> edge.t AND d < 30),
rank AS (SELECT stats.type, coalesce(max(d), 0) AS rank FROM stats LEFT JOIN way ON way.t = stats.type GROUP BY ALL)
"""


_G = graph(ORDER, "order_log")
_GU = graph(USER, "user_log")
_STATS = """SELECT type, type AS task, CASE type WHEN 'error' THEN 'error' ELSE 'complete' END AS phase,
  count, start_count, end_count FROM stats"""

_GC = graph(USER + """, cyclic_log AS (SELECT id, subject, CASE WHEN day % 4 = 3 THEN type ELSE 'd' || (day // 4) % 5 END AS type
  FROM (SELECT *, substr(time, 9, 2)::INT AS day FROM user_log))""", "cyclic_log")
_MARKED = """, marked AS (SELECT id, subject, type AS task, type || ['-started', '.completed', '_failed', ''][right(id, 2)::INT % 4 + 1] AS type,
  CASE right(id, 2)::INT % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'complete' WHEN 2 THEN 'error'
    ELSE CASE type WHEN 'error' THEN 'error' ELSE 'complete' END END AS phase FROM user_log)
"""

ORACLE = {
    "sequences": with_logs(ORDER)
    + """, p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY id) AS pos FROM order_log)
       SELECT subject, (pos - 1) // 1000 AS block, string_agg(type, ' ' ORDER BY pos) AS types FROM p GROUP BY ALL""",
    "node_stats": _G + _STATS,
    "node_stats_users": _GU + _STATS,
    "boundary_types": _G + "SELECT type, start_count > 0 AS starts, end_count > 0 AS ends FROM stats",
    "split_runs": _G + "SELECT subject, id, type, pos, run, step FROM steps",
    "split_runs_users": _GU + "SELECT subject, id, type, pos, run, step FROM steps",
    "directly_follows": _G + 'SELECT f AS "from", t AS "to", n AS count FROM dfg',
    "directly_follows_users": _GU + 'SELECT f AS "from", t AS "to", n AS count FROM dfg',
    "directly_follows_unsplit": _GU
    + 'SELECT prev AS "from", type AS "to", count(*) AS count FROM s WHERE prev IS NOT NULL GROUP BY ALL',
    "traces": _G + "SELECT count(DISTINCT (subject, run)) AS traces FROM runs",
    "graph_totals": graph(CHAT, "chat_log")
    + "SELECT count(DISTINCT subject) AS subjects, count(*) AS events, count(DISTINCT (subject, run)) AS traces FROM runs",
    "concurrent_pairs": _G + "SELECT a, b, fwd, rev FROM par",
    "concurrent_groups": _G + "SELECT string_agg(type, ',' ORDER BY type) AS members, count(*) AS size FROM grp GROUP BY grp",
    "canonicalise": _G + "SELECT subject, run, step, type FROM canon",
    "variants": _G + "SELECT rank, length, count, pct, 0::BIGINT AS block, sequence FROM vars WHERE rank <= 8",
    "variants_all": graph(CHAT, "chat_log") + "SELECT rank, length, count, pct, 0::BIGINT AS block, sequence FROM vars",
    "variant_steps": _G
    + """, top AS (SELECT rank, unnest(string_split(sequence, ' ')) AS type,
            generate_subscripts(string_split(sequence, ' '), 1) AS i FROM vars WHERE rank <= 8)
       SELECT rank, (min(i) - 1)::BIGINT AS start, type, count(*) AS n FROM top GROUP BY rank, type""",
    "variant_share": _G + "SELECT sequence, count, pct FROM vars",
    "edges": _G + 'SELECT f AS "from", t AS "to", n AS count, parallel FROM edge',
    "ranks": _G + "SELECT type, rank FROM rank",
    "nodes": _G
    + """SELECT type, type AS task, 'complete' AS phase, count, start_count, end_count, rank FROM stats JOIN rank USING (type)""",
    "task_groups": with_logs(USER)
    + _MARKED + """SELECT task, string_agg(type, ',' ORDER BY type) AS types, count(*) AS size FROM (SELECT DISTINCT type, task FROM marked)
       GROUP BY task HAVING count(*) >= 2""",
    "concurrent_groups_marked": graph(USER + _MARKED.replace("marked AS", "marked_log AS"), "marked_log")
    + "SELECT string_agg(type, ',' ORDER BY type) AS members, count(*) AS size FROM grp GROUP BY grp",
    "ranks_cyclic": _GC
    + """, st AS (SELECT f, t FROM edge WHERE NOT parallel AND f <> t),
       clo AS (SELECT f, t FROM st UNION SELECT clo.f, st.t FROM clo JOIN st ON st.f = clo.t),
       lev AS (SELECT type AS t, 0::BIGINT AS d FROM starts UNION SELECT st.t, d + 1 FROM lev JOIN st ON st.f = lev.t WHERE d < 30),
       lv AS (SELECT t, min(d) AS l FROM lev GROUP BY t),
       fwd AS (SELECT st.f, st.t FROM st LEFT JOIN lv a ON a.t = st.f LEFT JOIN lv b ON b.t = st.t
               WHERE NOT coalesce((st.t, st.f) IN (SELECT (f, t) FROM clo) AND a.l >= b.l, false)),
       way2 AS (SELECT type AS t, 0::BIGINT AS d FROM starts UNION SELECT fwd.t, d + 1 FROM way2 JOIN fwd ON fwd.f = way2.t WHERE d < 30)
       SELECT stats.type, coalesce(max(d), 0) AS rank FROM stats LEFT JOIN way2 ON way2.t = stats.type GROUP BY ALL""",
    "edges_cyclic": _GC + 'SELECT f AS "from", t AS "to", n AS count, parallel FROM edge',
    "node_stats_marked": with_logs(USER)
    + _MARKED + """, s AS (SELECT *, lag(type) OVER w IS NULL AS is_first, lead(type) OVER w IS NULL AS is_last
         FROM marked WINDOW w AS (PARTITION BY subject ORDER BY id))
       SELECT type, task, phase, count(*) AS count, count(*) FILTER (is_first) AS start_count, count(*) FILTER (is_last) AS end_count
       FROM s GROUP BY type, task, phase""",
    "downstream_nodes": _G
    + """SELECT 'order.placed' AS type, 0::BIGINT AS hop UNION ALL
       SELECT DISTINCT t, 1 FROM edge WHERE f = 'order.placed' AND NOT parallel AND t <> f""",
    "downstream_edges": _G
    + """, r AS (SELECT 'order.placed' AS t UNION SELECT edge.t FROM r JOIN edge ON edge.f = r.t WHERE NOT parallel)
       SELECT f AS "from", edge.t AS "to" FROM edge JOIN r ON r.t = edge.f WHERE NOT parallel""",
}

# Checks of the filters module that need the discovered graph.
SUBGRAPH = {
    "subgraph_nodes": _G
    + "SELECT type, type AS task, 'complete' AS phase, count, start_count, end_count FROM stats WHERE type ILIKE '%item%'",
    "subgraph_edges": _G
    + """SELECT f AS "from", t AS "to", n AS count, parallel FROM edge WHERE f ILIKE '%item%' AND t ILIKE '%item%'""",
}
ORACLE.update(SUBGRAPH)
