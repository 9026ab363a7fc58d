"""The derived logs once more, as SQL for the check engine."""

USER = """user_log AS (
  SELECT lpad(event_id::VARCHAR, 20, '0') AS id, 'app-' || (user_id % 4)::VARCHAR AS source,
         '/users/' || user_id::VARCHAR AS subject, event_type AS type,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS time, props AS data, ts
  FROM events)"""

CHAT = """chat_log AS (
  SELECT lpad(conv_id::VARCHAR, 12, '0') || '-' || lpad(turn::VARCHAR, 8, '0') AS id, 'chat' AS source,
         '/conversations/' || conv_id::VARCHAR AS subject, role AS type
  FROM conversations)"""

LINE_KEY = """strftime(l_shipdate, '%Y%m%d') || '.' || lpad(l_partkey::VARCHAR, 12, '0') || '.'
  || lpad(l_suppkey::VARCHAR, 10, '0') || '.' || lpad(l_linenumber::VARCHAR, 6, '0') || '.'
  || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0')"""

ORDER = f"""order_log AS (
  SELECT strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 12, '0') || '-' || k AS id,
         'shop' AS source, '/customers/' || o_custkey::VARCHAR || '/orders' AS subject,
         CASE k WHEN '0' THEN 'order.placed' ELSE 'order.closed.' || o_orderstatus END AS type,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS time, o_orderkey AS okey
  FROM orders, (VALUES ('0'), ('2')) v(k)
  UNION ALL
  SELECT strftime(o_orderdate, '%Y%m%d') || '-' || lpad(o_orderkey::VARCHAR, 12, '0') || '-1.' || {LINE_KEY},
         'warehouse', '/customers/' || o_custkey::VARCHAR || '/orders', 'item.' || l_returnflag,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ'), o_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

DOCS = f"""order_docs AS (
  SELECT lpad(o_orderkey::VARCHAR, 12, '0') || '-0' AS id, 'shop' AS source,
         '/orders/' || o_orderkey::VARCHAR AS subject, 'order.placed' AS type,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS time,
         '{{"customerId":"c' || o_custkey || '","total":' || round(o_totalprice)::BIGINT
           || CASE o_orderkey % 3 WHEN 0 THEN '.0' WHEN 1 THEN '.25' ELSE '' END
           || ',"priority":"' || o_orderpriority || '","placedAt":"'
           || CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
                   ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END || '"}}' AS data
  FROM orders
  UNION ALL
  SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '-1.' || {LINE_KEY}, 'warehouse',
         '/orders/' || l_orderkey || '/items/' || l_linenumber, 'item.' || l_returnflag || '.updated',
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ'),
         '{{"partId":"' || l_partkey || '","supplierId":"' || l_suppkey || '","quantity":' || l_quantity::BIGINT || '}}'
  FROM lineitem)"""


def with_logs(*logs: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(logs) + "\n"
