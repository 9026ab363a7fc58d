"""Templates, machines, payload checks and reports."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailweave.catalog.logs import CHAT, DOCS, ORDER, USER, with_logs
from trailweave.catalog.streams import middle_id
from trailweave.operators import conformance as c
from trailweave.operators import machine as m
from trailweave.operators import payload
from trailweave.operators.ordering import in_order
from trailweave.session import cut_lineage
from trailweave.sources import templates
from trailweave.sources.tables import chat_log, order_docs, order_log, table, user_log

TEMPLATE = c.Template(
    "order", ("order.placed", "item.A", "item.N", "item.R", "order.closed.F", "order.archived"), "/customers/1/orders"
)
CHAT_TEMPLATE = c.Template("chat", ("user", "assistant"), "/conversations/1")

_ITEMS = [(f"item.{flag}", state, "picked") for flag in "ANR" for state in ("open", "picked")]
_MOVES = [
    ("order.placed", "idle", "open"), ("order.placed", "done", "open"), *_ITEMS,
    ("order.closed.F", "picked", "done"), ("order.closed.O", "picked", "done"), ("order.returned", "done", "idle"),
]
ORDER_MODEL = m.Model(
    "orders",
    (m.Node("idle", "Idle", start=True), m.Node("open"), m.Node("picked", "Picked"), m.Node("done", end=True)),
    tuple(m.Edge(f"e{i}", *move) for i, move in enumerate(_MOVES)),
    subject_style="/customers/{id}/orders",
)
CHAT_MODEL = m.Model(
    "chat",
    (m.Node("begin", "Begin", start=True), m.Node("asked", "Asked"), m.Node("answered", "Answered", end=True),
     m.Node("later", "Later", start=True)),
    (m.Edge("c0", "system", "begin", "begin", "once"), m.Edge("c1", "user", "begin", "asked", "many"),
     m.Edge("c2", "assistant", "asked", "answered", "once"), m.Edge("c3", "user", "answered", "asked"),
     m.Edge("c4", "user", "later", "later")),
)
DOC_MODEL = m.Model(
    "docs",
    (m.Node("none", start=True), m.Node("placed", end=True), m.Node("moved", end=True)),
    (m.Edge("d0", "order.placed", "none", "placed"), m.Edge("d1", "item.A.updated", "none", "moved"),
     m.Edge("d2", "item.N.updated", "none", "moved"), m.Edge("d3", "item.A.updated", "moved", "moved"),
     m.Edge("d4", "item.R.updated", "none", "moved"), m.Edge("d5", "order.lost", "placed", "none")),
    (
        ("order.placed", m.Field("total", "integer", required=True)),
        ("order.placed", m.Field("priority", "enum", enum=("1-URGENT", "2-HIGH", "5-LOW"))),
        ("order.placed", m.Field("placedAt", "datetime", required=True)),
        ("order.placed", m.Field("customerId", "reference", required=True)),
        ("item.N.updated", m.Field("quantity", "string")),
        ("item.N.updated", m.Field("weight", "number", required=True)),
        ("item.R.updated", m.Field("supplierId", "string", format="email")),
        ("item.R.updated", m.Field("quantity", "boolean")),
        ("item.A.updated", m.Field("quantity", "number", required=True)),
    ),
)


def _checked(spark, sf):
    return c.template_check(order_log(spark, sf), TEMPLATE)


def _walked(log, model):
    return m.check_log(log, m.machine_of(log.sparkSession, model), with_edges=True)


def suite(spark, sf):
    """Every conversation as a test case; its length and first speaker say what to expect."""
    nodes, edges = m.model_tables(spark, CHAT_MODEL)
    turns = F.array_sort(F.collect_list(F.struct("id", "type")))
    written = chat_log(spark, sf).groupBy(F.col("subject").alias("case_id")).agg(turns.alias("turns"))  # a case is a short list
    cases = written.select(
        F.lit("chat").alias("model_id"), "case_id", F.col("turns.type").alias("steps"),
        F.when(F.size("turns") > 3, "reject").otherwise("accept").alias("outcome"),
        F.when(F.get("turns", F.lit(0))["type"] == "user", "answered").otherwise("begin").alias("end_state"),
    )
    return c.run_suite(cases, m.compile_machine(nodes, edges), nodes).select(
        "case_id", F.size("steps").cast("bigint").alias("length"), "outcome", "end_state", "passed", "detail")


def _verdicts(spark, sf):
    docs = order_docs(spark, sf)
    checked = _walked(docs, DOC_MODEL)
    faults = payload.payload_faults(docs, payload.field_table(spark, DOC_MODEL))
    return checked, c.stream_verdict(checked, faults)


def verdicts(spark, sf):
    return _verdicts(spark, sf)[1]


def report(spark, sf):
    checked, verdicts = _verdicts(spark, sf)
    return c.quality_report(verdicts, c.edge_coverage(checked, DOC_MODEL))


def coded_log(spark, sf):
    """The order log with customer codes, which are no generated keys, as segments."""
    return order_log(spark, sf).withColumn("subject", F.replace("subject", F.lit("/customers/"), F.lit("/customers/c")))


def customer_templates(spark, sf):
    """One process document per customer, on the orders of that customer; the first one speaks about all customers."""
    lane = F.when(F.col("c_custkey") == 1, "/customers/{id}/orders").otherwise(
        F.concat(F.lit("/customers/c"), F.col("c_custkey").cast("string"), F.lit("/orders")))
    item = F.concat(F.lit("item."), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("c_nationkey") % 3 + 1).cast("int")))
    last = F.concat(F.lit("order.closed."), F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O"))
    text = F.concat(
        F.lit('<definitions><process id="p"><laneSet><lane name="'), lane, F.lit('"/></laneSet><endEvent id="z" name="'), last,
        F.lit('"/><intermediateCatchEvent id="m" name="'), item, F.lit('"/><startEvent id="a" name="order.placed"/>'
              '<sequenceFlow sourceRef="a" targetRef="m"/><sequenceFlow sourceRef="m" targetRef="z"/></process></definitions>'))
    documents = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("template_id"), F.from_xml(text, templates.SCHEMA, {"rowTag": "definitions"}).alias("d"))
    return c.template_table(templates.template_rows(documents.select("template_id", "d.*")))


def _many_templates(spark, sf):
    return c.check_templates(coded_log(spark, sf), customer_templates(spark, sf))


def mined_machines(log):
    """One model per subject, from its own steps: states are types, every one may begin."""
    steps = cut_lineage(in_order(log).df.where("prev_type IS NOT NULL").select("subject", "prev_type", "type").distinct())
    place = F.row_number().over(Window.partitionBy("model_id").orderBy("node_id")) - 1
    nodes = steps.select(F.col("subject").alias("model_id"), F.explode(F.array("prev_type", "type")).alias("node_id")).distinct().select(
        "model_id", place.cast("int").alias("pos"), "node_id", F.lit("").alias("label"), F.lit(True).alias("is_start"), F.lit(False).alias("is_end"))
    number = F.row_number().over(Window.partitionBy("model_id").orderBy("from_node", "type")) - 1
    edges = steps.select(
        F.col("subject").alias("model_id"), F.concat("prev_type", F.lit(">"), "type").alias("edge_id"), "type",
        F.col("prev_type").alias("from_node"), F.col("type").alias("to_node"), F.lit("").alias("cardinality")).withColumn("pos", number.cast("int"))
    return m.compile_machine(nodes, edges)


def mined_fit(spark, sf):
    """The whole of each user's log against the model of that user's first half."""
    log = user_log(spark, sf)
    machines = cut_lineage(mined_machines(log.where(F.col("id") <= middle_id(log))))
    pairs = machines.select("model_id", F.col("model_id").alias("subject"))
    return m.check_many(log, machines, pairs).select("model_id", "length", "ok", "fail_ix", "reason", "end_node")


def _read_back(log):
    return log.where("type <> 'order.closed.P'")


VERDICT = ["subject", "length", "ok", "fail_ix", "reason", "end_node"]

QUERIES = {
    "template_check": lambda s, d: _checked(s, d),
    "template_check_chat": lambda s, d: c.template_check(chat_log(s, d), CHAT_TEMPLATE),
    "template_summary": lambda s, d: c.template_summary(chat_log(s, d), c.template_check(chat_log(s, d), CHAT_TEMPLATE)),
    "step_coverage": lambda s, d: c.step_coverage(_checked(s, d), TEMPLATE),
    "unexpected_types": lambda s, d: c.unexpected_types(order_log(s, d), TEMPLATE),
    "template_deviations": lambda s, d: c.template_deviations(_checked(s, d)),
    "sample_patterns": lambda s, d: c.sample_patterns(order_docs(s, d)),
    "expected_presence": lambda s, d: c.expected_presence(order_log(s, d), TEMPLATE),
    "compile_machine": lambda s, d: order_log(s, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(
        m.transitions(m.machine_of(s, ORDER_MODEL)), "type"),
    "check_sequence": lambda s, d: _walked(order_log(s, d), ORDER_MODEL).select(*VERDICT),
    "check_sequence_path": lambda s, d: m.check_log_path(order_log(s, d), m.machine_of(s, ORDER_MODEL)).select("subject", "pos", "node"),
    "check_sequence_path_once": lambda s, d: m.check_log_path(chat_log(s, d), m.machine_of(s, CHAT_MODEL)).select("subject", "pos", "node"),
    "check_templates": lambda s, d: _many_templates(s, d),
    "templates_summary": lambda s, d: c.templates_summary(_many_templates(s, d)),
    "check_models": mined_fit,
    "check_sequence_once": lambda s, d: _walked(chat_log(s, d), CHAT_MODEL).select(*VERDICT),
    "model_fit": lambda s, d: c.model_fit(_walked(order_log(s, d), ORDER_MODEL)),
    "model_deviations": lambda s, d: c.model_deviations(_walked(order_log(s, d), ORDER_MODEL)),
    "unused_types": lambda s, d: c.unused_types(order_log(s, d), ORDER_MODEL),
    "unknown_types": lambda s, d: c.unknown_types(order_log(s, d), ORDER_MODEL),
    "edge_coverage": lambda s, d: c.edge_coverage(_walked(order_log(s, d), ORDER_MODEL), ORDER_MODEL),
    "run_suite": suite,
    "validate_payload": lambda s, d: payload.validate_payload(order_docs(s, d), payload.field_table(s, DOC_MODEL)),
    "stream_verdict": lambda s, d: _verdicts(s, d)[1],
    "quality_report": report,
    "quality_failures": lambda s, d: c.failures_by_reason(_verdicts(s, d)[1]),
    "round_trip": lambda s, d: c.round_trip(
        order_log(s, d), _read_back(order_log(s, d)), m.machine_of(s, ORDER_MODEL)),
    "round_trip_differences": lambda s, d: c.round_trip_differences(order_log(s, d), _read_back(order_log(s, d))),
}


def _edges(model: m.Model) -> str:
    rows = ", ".join(
        f"({i}, '{e.type}', '{e.source}', '{e.target}', {str(e.cardinality == 'once').lower()})" for i, e in enumerate(model.edges)
    )
    return f"edge(pos, type, src, dst, once) AS (VALUES {rows})"


def walk_sql(logs: list[str], source: str, model: m.Model, where: str = "true") -> str:
    """Step-by-step walk of every subject from every start state, as recursion."""
    starts = ", ".join(f"({i}, '{n.id}')" for i, n in enumerate(model.nodes) if n.start)
    ends = ", ".join(f"'{n.id}'" for n in model.nodes if n.end)
    labels = ", ".join(f"('{n.id}', '{n.label or n.id}')" for n in model.nodes)
    return with_logs(*logs, _edges(model)) + f""", start(ord, node) AS (VALUES {starts}), lab(node, label) AS (VALUES {labels}),
s AS (SELECT subject, type, id, row_number() OVER (PARTITION BY subject ORDER BY id) AS pos,
      count(*) OVER (PARTITION BY subject) AS len FROM {source} WHERE {where}),
w AS (
  SELECT subject, ord, 0::BIGINT AS pos, node AS cur, []::VARCHAR[] AS seen, -1::BIGINT AS fail, 0 AS kind, '' AS bad, -1 AS took
  FROM (SELECT DISTINCT subject FROM s), start
  UNION ALL
  SELECT w.subject, w.ord, s.pos,
    CASE WHEN e.src IS NULL OR (e.once AND list_contains(w.seen, s.type)) THEN w.cur ELSE e.dst END,
    CASE WHEN e.once THEN list_append(w.seen, s.type) ELSE w.seen END,
    CASE WHEN e.src IS NULL OR (e.once AND list_contains(w.seen, s.type)) THEN s.pos - 1 ELSE -1 END,
    CASE WHEN e.src IS NULL THEN 1 WHEN e.once AND list_contains(w.seen, s.type) THEN 2 ELSE 0 END, s.type,
    CASE WHEN e.src IS NULL OR (e.once AND list_contains(w.seen, s.type)) THEN -1 ELSE e.pos END
  FROM w JOIN s ON s.subject = w.subject AND s.pos = w.pos + 1 LEFT JOIN edge e ON e.src = w.cur AND e.type = s.type
  WHERE w.fail = -1),
last AS (SELECT w.*, len, coalesce(label, '') AS label,
           fail = -1 AND ({f"cur IN ({ends})" if ends else "true"}) AS good,
           CASE WHEN fail = -1 THEN len ELSE fail END AS fx
         FROM w JOIN (SELECT subject, ord, max(pos) AS pos FROM w GROUP BY ALL) USING (subject, ord, pos)
         JOIN (SELECT DISTINCT subject, len FROM s) USING (subject) LEFT JOIN lab ON lab.node = cur),
best AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY subject ORDER BY good DESC, CASE WHEN good THEN 0 ELSE fx END DESC, ord) = 1),
verdict AS (SELECT subject, ord, len AS length, good AS ok, CASE WHEN good THEN -1 ELSE fx END::BIGINT AS fail_ix,
  CASE WHEN good THEN '' WHEN kind = 1 THEN 'no transition from state "' || label || '" via event type "' || bad || '"'
       WHEN kind = 2 THEN 'event type "' || bad || '" may occur at most once per subject'
       ELSE 'sequence ends in non-terminal state "' || label || '"' END AS reason, cur AS end_node FROM best)
"""


def template_sql(log: str, source: str, template: c.Template, pattern: str) -> str:
    steps = ", ".join(f"'{t}'" for t in template.expected)
    n = len(template.expected)
    return with_logs(log) + f""", x AS (SELECT [{steps}] AS exp),
q AS (SELECT subject, list(type ORDER BY id) AS ts, count(*) AS length FROM {source} WHERE regexp_full_match(subject, '{pattern}') GROUP BY subject),
p AS (SELECT subject, length, list_filter(ts, lambda t: t IN ({steps})) AS pr FROM q),
k AS (SELECT subject, length, len(pr)::BIGINT AS projected, length - len(pr) AS unexpected,
  list_reduce(list_transform(pr, lambda t: [t]), lambda a, t: CASE WHEN a[1] = '#' THEN
      CASE WHEN len(a) <= {n} AND exp[len(a)] = t[1] THEN list_append(a, t[1]) ELSE a END
    ELSE t END, ['#']) AS got, exp FROM p, x),
chk AS (SELECT subject, length, projected, unexpected, (len(got) - 1)::BIGINT AS matched, projected > 0 AS relevant,
  projected = {n} AND len(got) - 1 = {n} AND unexpected = 0 AS conforming, exp FROM k),
res AS (SELECT subject, length, projected, unexpected, matched, relevant, conforming,
  CASE WHEN relevant AND NOT conforming THEN
    CASE WHEN matched < {n} THEN 'stopped at step ' || (matched + 1) || '/{n} — missing “' || exp[matched + 1] || '”'
         WHEN unexpected > 0 THEN 'all steps in order, but ' || unexpected || ' unexpected event(s)'
         ELSE 'all steps seen but with extra/repeated events' END END AS detail FROM chk)
"""


_T = template_sql(ORDER, "order_log", TEMPLATE, "/customers/[^/]+/orders")
_TC = template_sql(CHAT, "chat_log", CHAT_TEMPLATE, "/conversations/[^/]+")
_W = walk_sql([ORDER], "order_log", ORDER_MODEL)
_WC = walk_sql([CHAT], "chat_log", CHAT_MODEL)
_WD = walk_sql([DOCS], "order_docs", DOC_MODEL)
_V = "SELECT subject, length, ok, fail_ix, reason, end_node FROM verdict"
_MANY = with_logs(ORDER) + """, o AS (SELECT replace(subject, '/customers/', '/customers/c') AS subject, type, id FROM order_log),
tpl AS (SELECT c_custkey::VARCHAR AS template_id, CASE WHEN c_custkey = 1 THEN '' ELSE '/customers/c' || c_custkey || '/orders' END AS scope,
  ['order.placed', 'item.' || ['A', 'N', 'R'][c_nationkey % 3 + 1], 'order.closed.' || CASE c_custkey % 2 WHEN 0 THEN 'F' ELSE 'O' END] AS exp
  FROM customer),
seqs AS (SELECT subject, list(type ORDER BY id) AS ts FROM o GROUP BY subject),
q AS (SELECT template_id, subject, exp, ts, list_filter(ts, lambda t: list_contains(exp, t)) AS pr
      FROM seqs JOIN tpl ON scope = subject OR scope = ''),
e AS (SELECT template_id, subject, exp, unnest(pr) AS t, generate_subscripts(pr, 1) AS i FROM q),
p1 AS (SELECT template_id, subject, min(i) AS i1 FROM e WHERE t = exp[1] GROUP BY ALL),
p2 AS (SELECT template_id, subject, min(i) AS i2 FROM e JOIN p1 USING (template_id, subject) WHERE t = exp[2] AND i > i1 GROUP BY ALL),
p3 AS (SELECT template_id, subject, min(i) AS i3 FROM e JOIN p2 USING (template_id, subject) WHERE t = exp[3] AND i > i2 GROUP BY ALL),
k AS (SELECT template_id, subject, len(ts) AS length, len(pr) AS projected, len(ts) - len(pr) AS unexpected,
  (i1 IS NOT NULL)::BIGINT + (i2 IS NOT NULL)::BIGINT + (i3 IS NOT NULL)::BIGINT AS matched, exp
  FROM q LEFT JOIN p1 USING (template_id, subject) LEFT JOIN p2 USING (template_id, subject) LEFT JOIN p3 USING (template_id, subject)),
res AS (SELECT template_id, subject, length, projected, unexpected, matched, projected > 0 AS relevant,
  projected = 3 AND matched = 3 AND unexpected = 0 AS conforming,
  CASE WHEN projected > 0 AND NOT (projected = 3 AND matched = 3 AND unexpected = 0) THEN
    CASE WHEN matched < 3 THEN 'stopped at step ' || (matched + 1) || '/3 — missing “' || exp[matched + 1] || '”'
         WHEN unexpected > 0 THEN 'all steps in order, but ' || unexpected || ' unexpected event(s)'
         ELSE 'all steps seen but with extra/repeated events' END END AS detail FROM k)
"""
_MINED = with_logs(USER) + """, h AS (SELECT subject, type, lag(type) OVER (PARTITION BY subject ORDER BY id) AS prev FROM user_log
  WHERE id::BIGINT <= (SELECT (min(id::BIGINT) + max(id::BIGINT)) // 2 FROM user_log)),
ed AS (SELECT DISTINCT subject, prev, type FROM h WHERE prev IS NOT NULL),
nd AS (SELECT subject, min(least(prev, type)) AS first FROM ed GROUP BY subject),
s AS (SELECT subject, type, lag(type) OVER w AS prev, row_number() OVER w - 1 AS ix, count(*) OVER (PARTITION BY subject) AS length
      FROM user_log WINDOW w AS (PARTITION BY subject ORDER BY id)),
bad AS (SELECT s.*, nd.first, CASE WHEN ix = 0 THEN NOT EXISTS (FROM ed WHERE ed.subject = s.subject AND ed.type = s.type)
          ELSE NOT EXISTS (FROM ed WHERE ed.subject = s.subject AND ed.prev = s.prev AND ed.type = s.type) END AS fails
        FROM s JOIN nd USING (subject)),
f AS (SELECT subject, any_value(length) AS length, min(ix) FILTER (fails) AS fx, arg_min(type, ix) FILTER (fails) AS ft,
        coalesce(arg_min(prev, ix) FILTER (fails), any_value(first)) AS cur, arg_max(type, ix) AS last FROM bad GROUP BY subject)
SELECT subject AS model_id, length, fx IS NULL AS ok, coalesce(fx, -1) AS fail_ix,
  CASE WHEN fx IS NULL THEN '' ELSE 'no transition from state "' || cur || '" via event type "' || ft || '"' END AS reason,
  CASE WHEN fx IS NULL THEN last ELSE cur END AS end_node FROM f"""
_PATH = "SELECT subject, w.pos, cur AS node FROM w JOIN verdict USING (subject, ord) WHERE w.fail = -1"
_COVER = """(SELECT count(DISTINCT took) FROM w JOIN verdict USING (subject, ord) WHERE took >= 0)"""

_FAULTS = """faults AS (
  SELECT id, subject, type, 'total' AS field, 'type' AS rule, 'expected an integer' AS message FROM order_docs
    WHERE type = 'order.placed' AND contains(data, '.25,')
  UNION ALL SELECT id, subject, type, 'priority', 'enum', 'value "' || (data->>'$.priority') || '" is not one of the allowed values'
    FROM order_docs WHERE type = 'order.placed' AND (data->>'$.priority') NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
  UNION ALL SELECT id, subject, type, 'placedAt', 'format', 'expected an RFC 3339 date-time'
    FROM order_docs WHERE type = 'order.placed' AND length(data->>'$.placedAt') = 10
  UNION ALL SELECT id, subject, type, unnest(['quantity', 'weight']), unnest(['type', 'required']),
    unnest(['expected type string', 'missing required field']) FROM order_docs WHERE type = 'item.N.updated'
  UNION ALL SELECT id, subject, type, unnest(['supplierId', 'quantity']), unnest(['format', 'type']),
    unnest(['expected an email address', 'expected type boolean']) FROM order_docs WHERE type = 'item.R.updated')"""

JUDGED = _WD + ", " + _FAULTS + """, judged AS (
  SELECT subject, NOT ok OR subject IN (SELECT subject FROM faults) AS rejected,
    CASE WHEN NOT ok THEN reason WHEN subject IN (SELECT subject FROM faults) THEN 'payload rejected' ELSE '' END AS reason
  FROM verdict)
"""

ORACLE = {
    "template_check": _T + "SELECT * FROM res",
    "template_check_chat": _TC + "SELECT * FROM res",
    "template_summary": _TC
    + """SELECT (SELECT count(DISTINCT subject) FROM chat_log) AS total_subjects, count(*) AS in_scope, count(*) FILTER (relevant) AS relevant,
       count(*) FILTER (conforming) AS conforming, count(*) FILTER (conforming) * 100 // count(*) FILTER (relevant) AS fit_pct FROM res""",
    "step_coverage": _T
    + f"""SELECT i AS step, exp[i] AS type, count(*) FILTER (relevant AND matched >= i) AS seen,
       count(*) FILTER (relevant AND matched >= i) * 100 // count(*) FILTER (relevant) AS pct
       FROM chk, range(1, {len(TEMPLATE.expected) + 1}) r(i) GROUP BY i, exp""",
    "unexpected_types": with_logs(ORDER)
    + """SELECT type, count(*) AS count FROM order_log WHERE type IN ('order.closed.O', 'order.closed.P') GROUP BY type""",
    "template_deviations": _T + "SELECT subject, detail FROM res WHERE detail IS NOT NULL ORDER BY subject LIMIT 12",
    "sample_patterns": with_logs(DOCS)
    + """SELECT regexp_replace(subject, '/[0-9]+', '/{id}', 'g') AS pattern, count(DISTINCT subject) AS count FROM order_docs GROUP BY 1""",
    "expected_presence": with_logs(ORDER)
    + f"""SELECT i AS step, exp[i] AS type, exp[i] IN (SELECT type FROM order_log) AS present
       FROM (SELECT [{', '.join(f"'{t}'" for t in TEMPLATE.expected)}] AS exp), range(1, {len(TEMPLATE.expected) + 1}) r(i)""",
    "compile_machine": with_logs(ORDER, _edges(ORDER_MODEL))
    + """, n AS (SELECT type, count(*) AS n FROM order_log GROUP BY type)
       SELECT type, n, 'orders' AS model_id, src AS from_node, dst AS to_node, once FROM edge JOIN n USING (type)""",
    "check_sequence": _W + _V,
    "check_sequence_once": _WC + _V,
    "check_sequence_path": _W + _PATH,
    "check_sequence_path_once": _WC + _PATH,
    "check_templates": _MANY + "SELECT * FROM res",
    "templates_summary": _MANY + """SELECT template_id, count(*) AS in_scope, count(*) FILTER (relevant) AS relevant,
       count(*) FILTER (conforming) AS conforming,
       CASE WHEN count(*) FILTER (relevant) = 0 THEN 0 ELSE count(*) FILTER (conforming) * 100 // count(*) FILTER (relevant) END AS fit_pct
       FROM res GROUP BY template_id""",
    "check_models": _MINED,
    "model_fit": _W
    + "SELECT count(*) AS subjects, count(*) FILTER (ok) AS conforming, count(*) FILTER (ok) * 100 // count(*) AS fit_pct FROM verdict",
    "model_deviations": _W
    + """SELECT subject, fail_ix, reason FROM verdict JOIN (SELECT subject, min(id) AS f FROM s GROUP BY subject) USING (subject)
       WHERE NOT ok ORDER BY f LIMIT 20""",
    "unused_types": with_logs(ORDER, _edges(ORDER_MODEL))
    + """, d AS (SELECT type, row_number() OVER (ORDER BY min(pos)) - 1 AS pos FROM edge GROUP BY type)
       SELECT pos, type FROM d WHERE type NOT IN (SELECT type FROM order_log)""",
    "unknown_types": with_logs(ORDER) + "SELECT DISTINCT type FROM order_log WHERE type = 'order.closed.P'",
    "edge_coverage": _W
    + f"SELECT {_COVER} AS covered, {len(_MOVES)}::BIGINT AS total, {_COVER} * 100 // {len(_MOVES)} AS pct",
    "run_suite": _WC
    + """, c AS (SELECT subject, arg_min(type, id) AS first FROM s GROUP BY subject),
       j AS (SELECT *, length > 3 AS rej, CASE first WHEN 'user' THEN 'answered' ELSE 'begin' END AS es
             FROM c JOIN verdict USING (subject))
       SELECT subject AS case_id, length, CASE WHEN rej THEN 'reject' ELSE 'accept' END AS outcome, es AS end_state,
         CASE WHEN rej THEN NOT ok ELSE ok AND end_node = es END AS passed,
         CASE WHEN rej AND ok THEN 'expected rejection, but the sequence is a valid walk' WHEN rej THEN 'correctly rejected — ' || reason
           WHEN NOT ok THEN reason WHEN end_node <> es THEN 'ended in ' || l1.label || ', expected ' || l2.label ELSE 'valid walk' END AS detail
       FROM j JOIN lab l1 ON l1.node = end_node JOIN lab l2 ON l2.node = es""",
    "validate_payload": with_logs(DOCS, _FAULTS) + "SELECT * FROM faults",
    "stream_verdict": JUDGED + "SELECT subject, rejected, reason FROM judged",
    "quality_report": JUDGED
    + f"""SELECT count(*) FILTER (NOT rejected) AS passed, count(*) FILTER (rejected) AS failed, {_COVER} AS covered_edges,
       6::BIGINT AS total_edges, {_COVER} * 100 // 6 AS coverage_pct FROM judged""",
    "quality_failures": JUDGED + "SELECT reason, count(*) AS subjects FROM judged WHERE rejected GROUP BY reason",
    "round_trip": walk_sql([ORDER], "order_log", ORDER_MODEL, "type <> 'order.closed.P'")
    + """SELECT (SELECT count(*) FROM order_log) AS written_events, (SELECT count(DISTINCT subject) FROM order_log) AS written_subjects,
       (SELECT count(*) FROM s) AS read_events, (SELECT count(DISTINCT subject) FROM s) AS read_subjects,
       (SELECT count(*) FROM verdict WHERE ok) AS conforming""",
    "round_trip_differences": with_logs(ORDER)
    + """, a AS (SELECT subject, type, row_number() OVER (PARTITION BY subject ORDER BY id) AS pos FROM order_log),
       b AS (SELECT subject, type, row_number() OVER (PARTITION BY subject ORDER BY id) AS pos FROM order_log WHERE type <> 'order.closed.P')
       SELECT *, 'missing' AS difference FROM (SELECT subject, pos, type FROM a EXCEPT SELECT subject, pos, type FROM b)
       UNION ALL SELECT *, 'added' FROM (SELECT subject, pos, type FROM b EXCEPT SELECT subject, pos, type FROM a)""",
}
