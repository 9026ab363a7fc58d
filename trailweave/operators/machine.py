"""State machines over subject sequences.

A model (nodes and typed edges) becomes one row of arrays, the transition table.
Sequences are walked in blocks: a block maps every state it may be entered in to the
state it is left in, and such maps compose, so a subject of any length is folded in
parallel and then put together.  The first block is only entered in start states,
which is all there is for ordinary subjects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.ordering import Slices, find_slices, in_order
from trailweave.session import cut_lineage, small_table

BLOCK = 4096
#: Most cells of a dense transition grid; larger models keep one short row of moves per state.
GRID = 4096
STATE = (
    "struct<cur:int,fail:bigint,kind:int,bad:string,"
    "once:array<struct<t:int,at:bigint,cur:int>>,used:array<int>,path:array<int>>"
)
# Kinds of failure.
NO_TRANSITION, ONLY_ONCE = 1, 2


@dataclass(frozen=True)
class Node:
    id: str
    label: str = ""
    start: bool = False
    end: bool = False


@dataclass(frozen=True)
class Edge:
    id: str
    type: str
    source: str
    target: str
    cardinality: str = ""


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    format: str = ""
    enum: tuple[str, ...] = ()


@dataclass(frozen=True)
class Model:
    """A designed process; ``fields`` are the payload fields per event type."""

    id: str
    nodes: tuple[Node, ...] = ()
    edges: tuple[Edge, ...] = ()
    fields: tuple[tuple[str, Field], ...] = ()
    subject_style: str = ""


NODE_SCHEMA = "model_id string, pos int, node_id string, label string, is_start boolean, is_end boolean"
EDGE_SCHEMA = (
    "model_id string, pos int, edge_id string, type string, from_node string, to_node string, cardinality string"
)


def model_tables(spark: SparkSession, model: Model) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of one model, as the model reader would give them."""
    nodes = [(model.id, i, n.id, n.label, n.start, n.end) for i, n in enumerate(model.nodes)]
    edges = [(model.id, i, e.id, e.type, e.source, e.target, e.cardinality) for i, e in enumerate(model.edges)]
    return small_table(spark, nodes, NODE_SCHEMA), small_table(spark, edges, EDGE_SCHEMA)


def compile_machine(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One transition table per model: the first edge in draft order wins.

    ``jump`` is indexed by state * number of types + type.  A model of more than ``GRID``
    cells has no such grid but ``moves``: the moves that leave each state, so a model is as
    large as its edges.  States that only edges mention come after the listed ones, without
    label and never terminal.
    """
    states = nodes.groupBy("model_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "node_id", "label", "is_start", "is_end"))).alias("n")
    )
    moves = edges.groupBy("model_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "type", "from_node", "to_node", "cardinality"))).alias("e")
    )
    empty = F.array().cast("array<struct<pos:int,type:string,from_node:string,to_node:string,cardinality:string>>")
    both = states.join(moves, "model_id", "left").withColumn("e", F.coalesce("e", empty))
    listed = F.transform("n", lambda s: s["node_id"])
    mentioned = F.flatten(F.transform("e", lambda m: F.array(m["from_node"], m["to_node"])))
    both = both.withColumn("node_ids", F.concat(listed, F.array_except(mentioned, listed)))
    both = both.withColumn("types", F.array_distinct(F.transform("e", lambda m: m["type"])))

    def move(k: Column) -> Column:
        state = F.get("node_ids", F.floor(k / F.size("types")).cast("int"))
        event = F.get("types", (k % F.size("types")).cast("int"))
        found = F.get(F.filter("e", lambda m: (m["from_node"] == state) & (m["type"] == event)), F.lit(0))
        return F.when(
            found.isNotNull(),
            F.struct(
                (F.array_position("node_ids", found["to_node"]) - 1).cast("int").alias("to"),
                (found["cardinality"] == "once").alias("once"),
                found["pos"].cast("int").alias("edge"),
            ),
        )

    cells = F.size("node_ids").cast("bigint") * F.size("types")
    numbers = F.when(cells > 0, F.sequence(F.lit(0), (cells - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    # Only models beyond the grid are in this join: their moves by state, the first edge of a type first.
    large = both.where(cells > GRID).select("model_id", "node_ids", "types", F.explode("e").alias("m"))
    number = large.select("model_id", F.posexplode("node_ids").alias("at", "node")).distinct()
    typed = large.select("model_id", F.posexplode("types").alias("t", "type")).distinct()
    leaving = large.select("model_id", "m.*").join(
        number.select("model_id", F.col("at").alias("_from"), F.col("node").alias("from_node")), ["model_id", "from_node"]).join(
        number.select("model_id", F.col("at").alias("to"), F.col("node").alias("to_node")), ["model_id", "to_node"]).join(
        typed, ["model_id", "type"]).groupBy("model_id", "_from", "t").agg(
        F.min_by(F.struct("t", "to", (F.col("cardinality") == "once").alias("once"), F.col("pos").alias("edge")), "pos").alias("move"))
    rows = leaving.groupBy("model_id", "_from").agg(F.array_sort(F.collect_list("move")).alias("row")).groupBy("model_id").agg(
        F.map_from_entries(F.collect_list(F.struct("_from", "row"))).alias("by_state"))
    both = both.join(rows, "model_id", "left")
    moves = F.when(cells > GRID, F.transform("node_ids", lambda s, i: F.coalesce(
        F.element_at("by_state", i), F.array().cast("array<struct<t:int,to:int,once:boolean,edge:int>>"))))
    label = lambda s: F.when(F.trim(F.coalesce(s["label"], F.lit(""))) != "", s["label"]).otherwise(s["node_id"])
    start_at = F.filter(
        F.transform("n", lambda s, i: F.when(s["is_start"], i.cast("int"))), lambda i: i.isNotNull()
    )
    return both.select(
        "model_id", "node_ids", "types",
        F.transform("n", label).alias("labels"),
        start_at.alias("starts"),
        F.transform("n", lambda s: F.coalesce(s["is_end"], F.lit(False))).alias("ends"),
        F.when(cells <= GRID, F.transform(numbers, move)).alias("jump"), moves.alias("moves"),
        F.size("e").alias("edge_count"),
    )


def machine_of(spark: SparkSession, model: Model) -> DataFrame:
    return compile_machine(*model_tables(spark, model))


def transitions(machine: DataFrame) -> DataFrame:
    """A compiled machine as rows (model_id, from_node, type, to_node, once)."""
    dense = machine.select("model_id", "node_ids", "types", F.posexplode("jump").alias("k", "m")).where("m IS NOT NULL").select(
        "model_id", "node_ids", "types", F.floor(F.col("k") / F.size("types")).cast("int").alias("state"),
        (F.col("k") % F.size("types")).alias("t"), "m.to", "m.once")
    sparse = machine.select("model_id", "node_ids", "types", F.posexplode("moves").alias("state", "row")).select(
        "model_id", "node_ids", "types", "state", F.explode("row").alias("m")).select(
        "model_id", "node_ids", "types", "state", "m.t", "m.to", "m.once")
    return dense.unionByName(sparse).select(
        "model_id", F.get("node_ids", "state").alias("from_node"), F.get("types", "t").alias("type"),
        F.get("node_ids", "to").alias("to_node"), "once")


def _fresh(entry: Column, with_path: bool) -> Column:
    return F.struct(
        entry.cast("int").alias("cur"), F.lit(None).cast("bigint").alias("fail"), F.lit(0).alias("kind"),
        F.lit(None).cast("string").alias("bad"),
        F.array().cast("array<struct<t:int,at:bigint,cur:int>>").alias("once"),
        F.array().cast("array<int>").alias("used"),
        (F.array(entry.cast("int")) if with_path else F.array().cast("array<int>")).alias("path"),
    ).cast(STATE)


def _step(with_edges: bool, with_path: bool):
    def step(acc: Column, ev: Column) -> Column:
        row = F.get(F.filter(F.get("moves", acc["cur"]), lambda m: m["t"] == ev["t"]), F.lit(0))
        listed = F.when(row.isNotNull(), F.struct(row["to"].alias("to"), row["once"].alias("once"), row["edge"].alias("edge")))
        move = F.when(ev["t"] >= 0, F.when(
            F.col("jump").isNotNull(), F.get("jump", (acc["cur"] * F.size("types") + ev["t"]).cast("int"))).otherwise(listed))
        again = move["once"] & F.exists(acc["once"], lambda o: o["t"] == ev["t"])
        failed = F.struct(
            acc["cur"].alias("cur"), ev["at"].alias("fail"),
            F.when(move.isNull(), NO_TRANSITION).otherwise(ONLY_ONCE).alias("kind"), ev["type"].alias("bad"),
            acc["once"].alias("once"), acc["used"].alias("used"), acc["path"].alias("path"),
        ).cast(STATE)
        mark = F.array(F.struct(ev["t"].alias("t"), ev["at"].alias("at"), acc["cur"].alias("cur")))
        moved = F.struct(
            move["to"].alias("cur"), acc["fail"].alias("fail"), acc["kind"].alias("kind"), acc["bad"].alias("bad"),
            F.when(move["once"], F.concat(acc["once"], mark)).otherwise(acc["once"]).alias("once"),
            (F.array_union(acc["used"], F.array(move["edge"])) if with_edges else acc["used"]).alias("used"),
            (F.concat(acc["path"], F.array(move["to"])) if with_path else acc["path"]).alias("path"),
        ).cast(STATE)
        return F.when(acc["fail"].isNotNull(), acc).when(move.isNull() | again, failed).otherwise(moved)

    return step


def _walk(events: Column, entries: Column, with_edges: bool, with_path: bool) -> Column:
    """State after the events for each entry state."""
    step = _step(with_edges, with_path)
    return F.transform(entries, lambda s: F.aggregate(events, _fresh(s, with_path), step))


def _compose(acc: Column, block: Column) -> Column:
    """Continue a walk through a block that was folded for every entry state."""
    then = F.get(block["outs"], acc["cur"])
    seen_before = F.filter(then["once"], lambda o: F.exists(acc["once"], lambda a: a["t"] == o["t"]))
    clash = F.array_min(F.transform(seen_before, lambda o: F.struct(
        o["at"].alias("at"), o["t"].alias("t"), o["cur"].alias("cur"))))
    clashes = clash.isNotNull() & (then["fail"].isNull() | (clash["at"] < then["fail"]))
    joined = F.struct(
        F.when(clashes, clash["cur"]).otherwise(then["cur"]).alias("cur"),
        F.when(clashes, clash["at"]).otherwise(then["fail"]).alias("fail"),
        F.when(clashes, ONLY_ONCE).otherwise(then["kind"]).alias("kind"),
        F.when(clashes, F.get("types", clash["t"])).otherwise(then["bad"]).alias("bad"),
        F.concat(acc["once"], then["once"]).alias("once"),
        F.array_union(acc["used"], then["used"]).alias("used"),
        acc["path"].alias("path"),
    ).cast(STATE)
    return F.when(acc["fail"].isNotNull(), acc).otherwise(joined)


MACHINE = ["model_id", "node_ids", "types", "labels", "starts", "ends", "jump", "moves"]


def _entries() -> Column:
    """States a block may be entered in: start states first, any state later."""
    return F.when(F.col("block") == 0, F.col("starts")).otherwise(F.sequence(F.lit(0), F.size("node_ids") - 1))


def _indexed(events: Column) -> Column:
    """Events (at, type) with the number of their type in the machine, -1 if it has none."""
    return F.transform(events, lambda e: F.struct(
        e["at"].alias("at"), (F.array_position("types", e["type"]) - 1).cast("int").alias("t"), e["type"].alias("type")))


def _gather(folded: DataFrame, keys: list[str], width: int | None, counted: list[str]) -> DataFrame:
    """Maps of ``width`` neighbouring blocks (all, if None) as one array per group, in order."""
    group = F.lit(0).cast("bigint") if width is None else F.floor(F.col("block") / width).cast("bigint")
    return folded.withColumn("grp", group).groupBy(*keys, "grp").agg(
        F.array_sort(F.collect_list(F.struct("block", "outs"))).alias("parts"),
        F.any_value("types").alias("types"), F.sum("length").alias("length"),
        F.min("first_id").alias("first_id"), *[F.sum(name).alias(name) for name in counted])


def _composed() -> Column:
    """The map of a group: each walk of its first block continued through the others."""
    rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
    return F.transform(F.get("parts", F.lit(0))["outs"], lambda s: F.aggregate(rest, s, _compose))


def _put_together(folded: DataFrame, keys: list[str], counted: list[str]) -> DataFrame:
    """Compose blocks in two levels, so that no row gathers more than BLOCK block summaries
    until a subject has BLOCK ** 3 events."""
    for width in (BLOCK, None):
        folded = _gather(folded, keys, width, counted).select(
            *keys, F.col("grp").alias("block"), "types", "length", "first_id", *counted, _composed().alias("outs"))
    return folded.drop("block", "types")


def _event_blocks(log: DataFrame, slices: Slices | None) -> DataFrame:
    """(subject, block, events, length, first_id): events (at, type) in order, cut into blocks."""
    flow = in_order(log, slices or find_slices(log)).df
    return flow.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("bigint")).groupBy("subject", "block").agg(
        F.array_sort(F.collect_list(F.struct((F.col("pos") - 1).alias("at"), "type"))).alias("events"),
        F.count(F.lit(1)).alias("length"), F.min("id").alias("first_id"))


def fold_log(
    log: DataFrame,
    machine: DataFrame,
    slices: Slices | None = None,
    counted: dict[str, Column] | None = None,
    only_known: bool = False,
    with_edges: bool = False,
) -> DataFrame:
    """Final walk states per subject, one for each start state.

    ``machine`` is one model.  ``counted`` adds conditional event counts per subject;
    ``only_known`` walks over types the machine does not mention.
    """
    slices = slices or find_slices(log)
    counted = counted or {}
    machine = cut_lineage(machine.select(*MACHINE))  # one row, used three times below
    flow = in_order(log, slices).df.crossJoin(F.broadcast(machine.select("types")))  # one row
    ix = (F.array_position("types", F.col("type")) - 1).cast("int")
    event = F.struct((F.col("pos") - 1).alias("at"), ix.alias("t"), F.col("type").alias("type"))
    kept = F.when(ix >= 0, event) if only_known else event
    blocks = (
        flow.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("bigint"))
        .groupBy("subject", "block")
        .agg(
            F.array_sort(F.collect_list(kept)).alias("events"), F.count(F.lit(1)).alias("length"),
            F.min("id").alias("first_id"), *[F.count_if(test).alias(name) for name, test in counted.items()],
        )
        .crossJoin(F.broadcast(machine))
    )
    folded = blocks.select(
        "subject", "block", "types", "length", "first_id", *counted,
        _walk(F.col("events"), _entries(), with_edges, False).alias("outs"),
    )
    return _put_together(folded, ["subject"], list(counted)).crossJoin(F.broadcast(machine))


def _walked_blocks(blocks: DataFrame, pairs: DataFrame, machines: DataFrame, with_edges: bool) -> DataFrame:
    """Blocks of subjects paired with models, each walked from every state it may be entered in.

    Models travel by key: one shuffled join on the subject, one on the model.
    """
    met = blocks.join(pairs.select("model_id", "subject"), "subject").join(machines.select(*MACHINE), "model_id")
    return met.select(
        "model_id", "subject", "block", "types", "length", "first_id",
        _walk(_indexed(F.col("events")), _entries(), with_edges, False).alias("outs"))


def check_many(log: DataFrame, machines: DataFrame, pairs: DataFrame, slices: Slices | None = None, with_edges: bool = False) -> DataFrame:
    """Verdicts of many models in one job: model_id, subject, length, first_id, ok, fail_ix,
    reason, end_node, used for every row of ``pairs`` (model_id, subject) with events.

    A subject may be paired with any number of models, and a model with any number of subjects.
    """
    keys = ["model_id", "subject"]
    folded = _walked_blocks(_event_blocks(log, slices), pairs.select(*keys).distinct(), machines, with_edges)
    walked = _put_together(folded, keys, []).join(machines.select(*MACHINE), "model_id")
    return verdict(walked, ["model_id", "subject", "length", "first_id"]).drop("path")


def check_log_path(log: DataFrame, machine: DataFrame, slices: Slices | None = None) -> DataFrame:
    """The nodes a subject's walk visits: (model_id, subject, pos, node), position 0 is the start state.

    The walk is the one the verdict is about; it ends before the event that fails.  The maps
    of blocks go up to the verdict as in ``check_log``.  On the way down each group, then each
    block, learns the state it is entered in; a block then lists its own nodes, so no array is
    longer than a block.
    """
    machine = cut_lineage(machine.select(*MACHINE))  # one row
    blocks = cut_lineage(_event_blocks(log, slices))  # walked twice
    keys = ["model_id", "subject"]
    one = machine.select("model_id")
    folded = cut_lineage(blocks.crossJoin(F.broadcast(machine)).select(
        "model_id", "subject", "block", "types", "length", "first_id", _walk(_indexed(F.col("events")), _entries(), False, False).alias("outs")))
    groups = cut_lineage(_gather(folded, keys, BLOCK, []).withColumn("outs", _composed()))
    whole = _gather(groups.drop("parts").withColumnRenamed("grp", "block"), keys, None, [])
    judged = verdict(
        whole.withColumn("outs", _composed()).join(F.broadcast(machine.drop("types")), "model_id"), [*keys, "length"], chosen=True)
    judged = cut_lineage(judged.where("start_ix IS NOT NULL").select(*keys, "start_ix", "walked"))

    def entered(parts: DataFrame, inner: str) -> DataFrame:
        """Entry state of every part of a row; the first part of a subject is entered in its start."""
        first = F.get("parts", F.lit(0))
        after_first = F.get(first["outs"], F.when(F.col("at_start"), F.col("start_ix")).otherwise(F.col("entry")))["cur"]
        rest = F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0)))
        states = F.aggregate(rest, F.array(F.col("entry"), after_first), lambda acc, part: F.concat(
            acc, F.array(F.get(part["outs"], F.element_at(acc, -1))["cur"])))
        listed = F.transform("parts", lambda p, i: F.struct(p["block"].alias(inner), F.get(states, i).alias("entry")))
        return parts.select(*keys, F.inline(listed))

    starts = machine.select("model_id", "starts")
    begun = judged.join(F.broadcast(starts), "model_id").select(*keys, "start_ix", F.get("starts", "start_ix").alias("entry"))
    by_group = entered(whole.join(begun, keys).withColumn("at_start", F.lit(True)), "grp")
    inside = _gather(folded, keys, BLOCK, []).join(by_group, [*keys, "grp"]).join(judged.select(*keys, "start_ix"), keys)
    by_block = entered(inside.withColumn("at_start", F.col("grp") == 0), "block")
    met = blocks.crossJoin(F.broadcast(one)).join(by_block, [*keys, "block"]).join(judged.select(*keys, "walked"), keys).join(
        F.broadcast(machine), "model_id")
    path = F.get(_walk(_indexed(F.col("events")), F.array(F.col("entry")), False, True), F.lit(0))["path"]
    rows = met.select(*keys, "walked", "node_ids", "block", F.posexplode(path).alias("step", "state"))
    pos = F.col("block") * BLOCK + F.col("step")
    return rows.where((F.col("step") > 0) | (F.col("block") == 0)).where(pos <= F.col("walked")).select(
        *keys, pos.alias("pos"), F.get("node_ids", "state").alias("node"))


def _quoted(text: Column) -> Column:
    """Text in double quotes, with quotes, backslashes and control characters escaped."""
    for mark, code in (("\\", "\\\\"), ('"', '\\"'), ("\a", "\\a"), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"),
                       ("\r", "\\r"), ("\t", "\\t"), ("\v", "\\v")):
        text = F.replace(text, F.lit(mark), F.lit(code))
    return F.concat(F.lit('"'), text, F.lit('"'))


def verdict(walked: DataFrame, keep: list[str], chosen: bool = False) -> DataFrame:
    """Judge walks: needs outs, length and the machine columns.

    The first start state that works decides, otherwise the attempt that got
    furthest, the earlier start state on a tie.  ``chosen`` adds which of the start states
    that is (``start_ix``) and how many events its walk passed (``walked``).
    """
    terminal = lambda s: (~F.exists("ends", lambda e: e)) | F.coalesce(F.get("ends", s["cur"]), F.lit(False))
    tried = F.transform(
        "outs",
        lambda s, i: F.struct(
            (s["fail"].isNull() & terminal(s)).cast("int").alias("good"),
            F.coalesce(s["fail"], F.col("length")).alias("fail_ix"),
            (-i).alias("order"),
            s["cur"].alias("cur"), F.when(s["fail"].isNull(), 3).otherwise(s["kind"]).alias("kind"),
            s["bad"].alias("bad"), s["used"].alias("used"), s["path"].alias("path"),
        ),
    )
    judged = walked.withColumn("tried", tried).withColumn(
        "best",
        F.coalesce(
            F.get(F.filter("tried", lambda t: t["good"] == 1), F.lit(0)),
            F.array_max(F.transform("tried", lambda t: F.struct(
                t["good"], t["fail_ix"], t["order"], t["cur"], t["kind"], t["bad"], t["used"], t["path"]))),
        ),
    )
    no_graph, no_start, nothing = F.size("node_ids") == 0, F.size("starts") == 0, F.col("length") == 0
    good = F.col("best.good") == 1
    here = F.coalesce(F.get("labels", F.col("best.cur")), F.lit(""))
    reason = (
        F.when(no_graph, F.lit("model has no graph to check against"))
        .when(nothing, F.lit(""))
        .when(no_start, F.lit("model has no start state"))
        .when(good, F.lit(""))
        .when(
            F.col("best.kind") == NO_TRANSITION,
            F.concat(F.lit("no transition from state "), _quoted(here), F.lit(" via event type "), _quoted(F.col("best.bad"))),
        )
        .when(
            F.col("best.kind") == ONLY_ONCE,
            F.concat(F.lit("event type "), _quoted(F.col("best.bad")), F.lit(" may occur at most once per subject")),
        )
        .otherwise(F.concat(F.lit("sequence ends in non-terminal state "), _quoted(here)))
    )
    fine = ~no_graph & (nothing | (~no_start & good))
    walkable = ~no_graph & ~nothing & ~no_start
    return judged.select(
        *keep,
        fine.alias("ok"),
        F.when(fine | no_graph, F.lit(-1)).when(no_start, F.lit(0)).otherwise(F.col("best.fail_ix")).cast("bigint").alias("fail_ix"),
        reason.alias("reason"),
        F.when(walkable, F.get("node_ids", F.col("best.cur"))).alias("end_node"),
        F.when(walkable, F.col("best.used")).alias("used"),
        F.when(walkable, F.transform("best.path", lambda p: F.get("node_ids", p))).alias("path"),
        *([F.when(walkable, -F.col("best.order")).alias("start_ix"), F.col("best.fail_ix").alias("walked")] if chosen else []),
    )


def check_log(log: DataFrame, machine: DataFrame, slices: Slices | None = None, with_edges: bool = False) -> DataFrame:
    """Verdict per subject: subject, length, first_id, ok, fail_ix, reason, end_node, used."""
    walked = fold_log(log, machine, slices, with_edges=with_edges)
    return verdict(walked, ["model_id", "subject", "length", "first_id"]).drop("path")


def check_sequences(cases: DataFrame, machines: DataFrame, types: str = "steps") -> DataFrame:
    """Verdict for written-down sequences: cases carry model_id and an array of types.

    Unlike ``check_log`` this keeps the visited nodes, since the steps are at hand.
    """
    keep = cases.columns
    joined = cases.withColumnRenamed(types, "_steps").join(machines.select(*MACHINE), "model_id")
    events = F.transform(
        "_steps",
        lambda t, i: F.struct(
            i.cast("bigint").alias("at"), (F.array_position("types", t) - 1).cast("int").alias("t"), t.alias("type")
        ),
    )
    walked = joined.withColumn("length", F.size("_steps").cast("bigint")).withColumn(
        "outs", _walk(events, F.col("starts"), False, True)
    )
    return verdict(walked.withColumnRenamed("_steps", types), keep).drop("used")
