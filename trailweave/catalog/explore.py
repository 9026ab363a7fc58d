"""Replay, walking orders and comparison of subjects."""

from pyspark.sql import functions as F

from trailweave.catalog.logs import CHAT, ORDER, USER, with_logs
from trailweave.operators import explore
from trailweave.operators.variants import walk_order
from trailweave.sources.tables import chat_log, order_log, user_log

PINNED = ["/users/1", "/users/2", "/users/3"]



def thousandths(log):
    """The places in a log after each thousandth of its events."""
    total = log.agg(F.count(F.lit(1)).alias("n"))
    return log.sparkSession.range(1001).crossJoin(F.broadcast(total)).select(F.expr("id * n div 1000").alias("events"))


QUERIES = {
    "replay_points": lambda s, d: explore.replay_points(order_log(s, d), thousandths(order_log(s, d))),
    "running_counts": lambda s, d: explore.running_counts(order_log(s, d)),
    "replay_at": lambda s, d: explore.replay_at(order_log(s, d), 5000),
    "walk_order_chrono": lambda s, d: walk_order(order_log(s, d), "chrono"),
    "walk_order_variant": lambda s, d: walk_order(chat_log(s, d), "variant"),
    "walk_order_rare": lambda s, d: walk_order(chat_log(s, d), "rare"),
    "compare_nodes": lambda s, d: explore.compare_subjects(user_log(s, d), PINNED)[0],
    "compare_edges": lambda s, d: explore.compare_subjects(user_log(s, d), PINNED)[1],
}


def _walk(log, source):
    return with_logs(log) + f""", w AS (SELECT subject, min(id) AS first_id, count(*) AS length, string_agg(type, '>' ORDER BY id) AS v
         FROM {source} GROUP BY subject)
       SELECT subject, first_id, length, count(*) OVER (PARTITION BY v) AS population,
              count(*) OVER (PARTITION BY v) = 1 AS is_unique FROM w"""


_PINNED = with_logs(USER) + """, p AS (SELECT subject, type, lag(type) OVER (PARTITION BY subject ORDER BY id) AS prev
   FROM user_log WHERE subject IN ('/users/1', '/users/2', '/users/3'))"""

ORACLE = {
    "running_counts": with_logs(ORDER)
    + "SELECT id, subject, type, row_number() OVER (PARTITION BY type ORDER BY id) AS so_far FROM order_log",
    "replay_at": with_logs(ORDER)
    + """SELECT type, count(*) FILTER (n <= 5000) AS count FROM (SELECT type, row_number() OVER (ORDER BY id) AS n FROM order_log) GROUP BY type""",
    "replay_points": with_logs(ORDER)
    + """, r AS (SELECT type, row_number() OVER (ORDER BY id) AS n FROM order_log),
       p AS (SELECT DISTINCT k * (SELECT count(*) FROM r) // 1000 AS events FROM range(1001) t(k)),
       placed AS (SELECT type, (SELECT min(events) FROM p WHERE events >= n) AS events FROM r),
       c AS (SELECT p.events, k.type, count(placed.type) AS m FROM p CROSS JOIN (SELECT DISTINCT type FROM r) k
             LEFT JOIN placed ON placed.events = p.events AND placed.type = k.type GROUP BY ALL)
       SELECT events, type, (sum(m) OVER (PARTITION BY type ORDER BY events))::BIGINT AS count FROM c""",
    "walk_order_chrono": _walk(ORDER, "order_log"),
    "walk_order_variant": _walk(CHAT, "chat_log"),
    "walk_order_rare": _walk(CHAT, "chat_log"),
    "compare_nodes": _PINNED
    + """SELECT type, count(DISTINCT subject) AS shared_by, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM p GROUP BY type""",
    "compare_edges": _PINNED
    + """SELECT prev AS "from", type AS "to", count(DISTINCT subject) AS shared_by,
       string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM p WHERE prev <> type GROUP BY prev, type""",
}
