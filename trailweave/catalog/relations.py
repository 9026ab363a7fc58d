"""Subject tree and payload relations."""

from pyspark.sql import functions as F

from trailweave.catalog.logs import DOCS, with_logs
from trailweave.operators import relations as r
from trailweave.sources.tables import order_docs, table


def catalogue_docs(spark, sf):
    """Orders and items together with the parts they mention."""
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("id"),
        F.lit("catalogue").alias("source"),
        F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string")).alias("subject"),
        F.lit("part.created").alias("type"),
        F.lit(None).cast("string").alias("time"),
        F.concat(F.lit('{"brandRef":["'), F.col("p_brand"), F.lit('"],"orderId":null,"id":"'), F.col("p_partkey").cast("string"), F.lit('"}')).alias("data"),
    )
    return order_docs(spark, sf).unionByName(parts)


QUERIES = {
    "subject_tree": lambda s, d: r.subject_tree(order_docs(s, d)),
    "subject_tree_order": lambda s, d: r.tree_order(r.subject_tree(catalogue_docs(s, d))).select(
        "path", "parent", "place", "events", "instances"),
    "reference_edges": lambda s, d: r.References(catalogue_docs(s, d)).edges(),
    "reference_nodes": lambda s, d: r.References(catalogue_docs(s, d)).nodes(),
    "reference_edges_orders": lambda s, d: r.References(order_docs(s, d)).edges(),
    "resolve_references": lambda s, d: r.resolve_references(catalogue_docs(s, d)),
}

_TREE = """, n AS (SELECT CASE WHEN starts_with(type, 'item') THEN 2 WHEN type = 'order.placed' THEN 1 ELSE 0 END AS k,
                  string_split(subject, '/') AS p, subject FROM docs),
 levels AS (
  SELECT '/' || p[2] AS path, 1::BIGINT AS depth, p[2] AS seg, false AS is_id, NULL AS raw FROM n
  UNION ALL SELECT '/' || p[2] || '/{id}', 2, '{id}', true, p[3] FROM n
  UNION ALL SELECT '/orders/{id}/items', 3, 'items', false, NULL FROM n WHERE k = 2
  UNION ALL SELECT '/orders/{id}/items/{id}', 4, '{id}', true, p[5] FROM n WHERE k = 2),
 tree AS (SELECT path, depth, seg, is_id, count(*) AS events, count(DISTINCT raw) AS instances FROM levels GROUP BY ALL)
"""
_DOCS = with_logs(DOCS, "docs AS (SELECT id, subject, type FROM order_docs)")
_ALL = with_logs(
    DOCS,
    """docs AS (SELECT id, subject, type FROM order_docs UNION ALL
       SELECT 'p' || lpad(p_partkey::VARCHAR, 12, '0'), '/parts/' || p_partkey, 'part.created' FROM part)""",
)

ORACLE = {
    "subject_tree": _DOCS + _TREE + "SELECT path, depth, seg, is_id, events, instances FROM tree",
    "subject_tree_order": _ALL + _TREE
    + """, q AS (SELECT *, CASE depth WHEN 1 THEN '' ELSE left(path, length(path) - length(seg) - 1) END AS parent FROM tree)
       SELECT path, parent, row_number() OVER (PARTITION BY parent ORDER BY events DESC, seg) AS place, events, instances FROM q""",
    "reference_edges": """SELECT 'orders' AS "from", 'customer' AS "to", 'n:1' AS kind, 'customerId' AS via, count(*) AS count FROM orders
       UNION ALL SELECT 'parts', 'supplier', 'n:m', (
         SELECT 'item.' || arg_min(l_returnflag, (l_orderkey, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) || '.updated'
         FROM lineitem), count(*) FROM lineitem
       UNION ALL SELECT 'brand', 'orders', 'n:m', 'part.created', count(*) FROM part""",
    "reference_nodes": """SELECT 'orders' AS name, true AS known, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS events
       UNION ALL SELECT 'parts', true, count(*) FROM part
       UNION ALL SELECT unnest(['customer', 'supplier', 'brand']), false, 0""",
    "reference_edges_orders": """SELECT 'orders' AS "from", 'customer' AS "to", 'n:1' AS kind, 'customerId' AS via, count(*) AS count FROM orders
       UNION ALL SELECT 'part', 'supplier', 'n:m', (
         SELECT 'item.' || arg_min(l_returnflag, (l_orderkey, l_shipdate, l_partkey, l_suppkey, l_linenumber, l_extendedprice)) || '.updated'
         FROM lineitem), count(*) FROM lineitem""",
    "resolve_references": """WITH refs AS (
         SELECT '/customers/c' || o_custkey AS ref_subject, 0 AS e FROM orders
         UNION ALL SELECT '/parts/' || l_partkey, (l_partkey IN (SELECT p_partkey FROM part))::INT FROM lineitem
         UNION ALL SELECT '/suppliers/' || l_suppkey, 0 FROM lineitem)
       SELECT ref_subject, count(*) AS "references", max(e)::BIGINT AS events FROM refs GROUP BY ref_subject""",
}
