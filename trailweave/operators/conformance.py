"""Conformance: logs against templates and against designed machines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions.paths import ID_SEGMENT, matches_literal, subject_pattern, whole_segments
from trailweave.functions.text import deviation_detail, pct
from trailweave.operators.machine import BLOCK, Model, check_log, check_sequences, fold_log
from trailweave.operators.ordering import Slices, blocks_of, find_slices, in_order, sequences
from trailweave.session import checked_broadcast, cut_lineage, kept_table, small_table

# Lengths of the example lists.
TEMPLATE_DEVIATIONS = 12
SAMPLE_PATTERNS = 12
MODEL_DEVIATIONS = 20
# Subjects that meet the templates of one pattern in one place.
SPREAD = 50_000


@dataclass(frozen=True)
class Template:
    """Expected event types in order, and the subjects they are expected on."""

    process: str
    expected: tuple[str, ...]
    subject: str = ""


def template_machine(spark: SparkSession, template: Template) -> DataFrame:
    """The template's greedy pointer as a machine: state = steps matched so far."""
    steps, types = template.expected, list(dict.fromkeys(template.expected))
    jump = [
        {"to": state + 1 if state < len(steps) and steps[state] == event else state, "once": False, "edge": 0}
        for state in range(len(steps) + 1)
        for event in types
    ]
    schema = (
        "model_id string, node_ids array<string>, types array<string>, labels array<string>, starts array<int>, "
        "ends array<boolean>, jump array<struct<to:int,once:boolean,edge:int>>, "
        "moves array<array<struct<t:int,to:int,once:boolean,edge:int>>>"
    )
    states = [str(i) for i in range(len(steps) + 1)]
    return small_table(spark, [(template.process, states, types, states, [0], [], jump, None)], schema)


def in_scope(log: DataFrame, template: Template) -> DataFrame:
    """Events on subjects the template speaks about."""
    if not template.subject:
        return log
    given = small_table(log.sparkSession, [(template.subject,)], "subject string")
    pattern = given.select(subject_pattern(F.col("subject"))).first()[0]  # folded by the optimizer, no job
    return log.where(matches_literal(F.col("subject"), pattern))


def template_check(log: DataFrame, template: Template, slices: Slices | None = None) -> DataFrame:
    """Per subject in scope: matched steps, projected and unexpected events, verdict."""
    known = F.col("type").isin(*template.expected)
    walked = fold_log(
        in_scope(log, template), template_machine(log.sparkSession, template), slices,
        counted={"projected": known, "unexpected": ~known}, only_known=True,
    )
    expected = F.array(*[F.lit(e) for e in template.expected]).cast("array<string>")
    matched = F.get("outs", F.lit(0))["cur"].cast("bigint")
    size = len(template.expected)
    conforming = (F.col("projected") == size) & (matched == size) & (F.col("unexpected") == 0) & (F.col("projected") > 0)
    return walked.select(
        "subject", "length", "projected", "unexpected", matched.alias("matched"),
        (F.col("projected") > 0).alias("relevant"), conforming.alias("conforming"),
        F.when((F.col("projected") > 0) & ~conforming,
               deviation_detail(expected, matched, F.col("unexpected"), F.col("projected"))).alias("detail"),
    )


def template_summary(log: DataFrame, checked: DataFrame) -> DataFrame:
    """Subjects in the log, in scope, taking part, conforming, and the fit."""
    total = log.select("subject").distinct().agg(F.count(F.lit(1)).alias("total_subjects"))
    sums = checked.agg(
        F.count(F.lit(1)).alias("in_scope"), F.count_if("relevant").alias("relevant"),
        F.count_if("conforming").alias("conforming"),
    )
    return total.crossJoin(sums).withColumn("fit_pct", pct(F.col("conforming"), F.col("relevant")))


def step_coverage(checked: DataFrame, template: Template) -> DataFrame:
    """How many subjects got past each expected step, with their share."""
    reached = [
        F.count_if(F.col("relevant") & (F.col("matched") > i)).alias(f"s{i}") for i in range(len(template.expected))
    ]
    sums = checked.agg(F.count_if("relevant").alias("relevant"), *reached)
    rows = F.array(*[
        F.struct(F.lit(i + 1).cast("bigint").alias("step"), F.lit(name).alias("type"), F.col(f"s{i}").alias("seen"),
                 pct(F.col(f"s{i}"), F.col("relevant")).alias("pct"))
        for i, name in enumerate(template.expected)
    ])
    return sums.select(F.inline(rows))


def unexpected_types(log: DataFrame, template: Template) -> DataFrame:
    """Types outside the template on subjects in scope, taking part or not."""
    extra = in_scope(log, template).where(~F.col("type").isin(*template.expected))
    return extra.groupBy("type").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "type")


def template_deviations(checked: DataFrame, limit: int = TEMPLATE_DEVIATIONS) -> DataFrame:
    """First deviating subjects by name."""
    bad = checked.where("relevant AND NOT conforming")
    return bad.select("subject", "detail").orderBy("subject").limit(limit)


def sample_patterns(log: DataFrame, limit: int = SAMPLE_PATTERNS) -> DataFrame:
    """Most common subject patterns of the log."""
    subjects = log.select("subject").distinct()
    counted = subjects.groupBy(subject_pattern(F.col("subject")).alias("pattern")).agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "pattern").limit(limit)


def expected_presence(log: DataFrame, template: Template) -> DataFrame:
    """Expected types in order, and whether they occur anywhere in the log."""
    wanted = small_table(
        log.sparkSession, [(i + 1, e) for i, e in enumerate(template.expected)], "step bigint, type string"
    )
    seen = log.where(F.col("type").isin(*template.expected)).select("type").distinct().withColumn("present", F.lit(True))
    return wanted.join(seen, "type", "left").select("step", "type", F.coalesce("present", F.lit(False)).alias("present"))


# --- many templates ------------------------------------------------------------


def template_table(rows: DataFrame) -> DataFrame:
    """(template_id, process, subject_pattern, expected) from the rows of the template reader."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "type")))
    return rows.groupBy("template_id", "process", "subject_pattern").agg(steps.alias("_steps")).select(
        "template_id", "process", "subject_pattern", F.col("_steps.type").alias("expected"))


def match_patterns(subjects: DataFrame, patterns: DataFrame) -> DataFrame:
    """(subject, subject_pattern) of all pairs that match, by an index of the patterns.

    A pattern's shape is its number of segments and the places of its ``{id}``.  A subject
    looks up one key per shape of its length: its own segments with those places masked.  So
    matching is an equality join; an empty pattern matches every subject.
    """
    wanted = patterns.select("subject_pattern").distinct().withColumn("_parts", whole_segments(F.col("subject_pattern")))
    places = F.filter(F.transform("_parts", lambda s, i: F.when(s == ID_SEGMENT, i.cast("int"))), lambda i: i.isNotNull())
    empty = F.col("subject_pattern") == ""
    keyed = cut_lineage(wanted.select(
        "subject_pattern", empty.alias("_all"), F.size("_parts").alias("_size"), places.alias("_places"), "_parts"))
    shapes = checked_broadcast(keyed.where("NOT _all").select("_size", "_places").distinct())
    asked = subjects.select("subject").distinct().withColumn("_have", whole_segments(F.col("subject")))
    masked = F.transform("_have", lambda s, i: F.when(F.array_contains("_places", i.cast("int")), F.lit(ID_SEGMENT)).otherwise(s))
    probes = asked.join(shapes, F.size("_have") == F.col("_size")).select("subject", masked.alias("_parts"), "_size", "_places")
    index = keyed.where("NOT _all").select("subject_pattern", "_parts", "_size", "_places")
    found = probes.join(index, ["_parts", "_size", "_places"]).select("subject", "subject_pattern")
    everything = asked.select("subject").crossJoin(F.broadcast(keyed.where("_all").select("subject_pattern")))  # one row at most
    return found.unionByName(everything)


def templates_of(matched: DataFrame, known: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(subject, template_id, expected) of matched subjects and patterns.

    A pattern that matches more than ``spread`` subjects is dealt to several parts by a hash of
    the subject, and its templates are repeated for each, so no part grows with the log.
    """
    matched = kept_table(matched, "matched")
    many = matched.groupBy("subject_pattern").agg(F.ceil(F.count(F.lit(1)) / spread).cast("int").alias("_parts")).where("_parts > 1")
    many = checked_broadcast(cut_lineage(many))
    parts = F.coalesce("_parts", F.lit(1))
    asked = matched.join(many, "subject_pattern", "left").select(
        "subject", "subject_pattern", F.pmod(F.xxhash64("subject"), parts).cast("int").alias("_part"))
    held = known.join(many, "subject_pattern", "left").select(
        *known.columns, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
    return asked.join(held, ["subject_pattern", "_part"]).select("subject", "template_id", "expected")


def check_templates(log: DataFrame, templates: DataFrame, slices: Slices | None = None) -> DataFrame:
    """``template_check`` of all templates in one job, with the template in front of the subject.

    ``templates`` is ``template_table``.  Sequences are gathered once, in blocks; a block is
    walked for each of its templates from every step it may be entered at, and the blocks of
    a subject are put together in two levels, so a subject may be of any length.
    """
    known = templates.select("template_id", "subject_pattern", "expected")
    blocks = cut_lineage(blocks_of(in_order(log, slices).df, ["subject"], BLOCK).select("subject", "block", "types"))
    met = blocks.join(templates_of(match_patterns(blocks, known), known), "subject")
    mine = F.filter("types", lambda t: F.array_contains("expected", t))
    follow = lambda at, t: F.when(F.get("expected", at) == t, at + 1).otherwise(at)
    entries = F.when(F.col("block") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("expected")))
    keys = ["template_id", "subject", "expected"]  # steps travel with their template: no second join under one hot key
    folded = met.withColumn("_mine", mine).select(
        *keys, "block", F.size("types").cast("bigint").alias("length"), F.size("_mine").cast("bigint").alias("projected"),
        F.transform(entries, lambda at: F.aggregate("_mine", at, follow)).alias("outs"))
    for width in (BLOCK, None):
        group = F.lit(0).cast("bigint") if width is None else F.floor(F.col("block") / width).cast("bigint")
        parts = F.array_sort(F.collect_list(F.struct("block", "outs")))
        rest = F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 1, F.lit(0)))
        outs = F.transform(F.get("_parts", F.lit(0))["outs"], lambda at: F.aggregate(
            rest, at, lambda now, part: F.get(part["outs"], now)))
        folded = folded.withColumn("_group", group).groupBy(*keys, "_group").agg(
            parts.alias("_parts"), F.sum("length").alias("length"), F.sum("projected").alias("projected")).select(
            *keys, F.col("_group").alias("block"), "length", "projected", outs.alias("outs"))
    total = F.size("expected").cast("bigint")
    walked = folded.select(
        *keys, "length", "projected", (F.col("length") - F.col("projected")).alias("unexpected"),
        F.get("outs", F.lit(0)).cast("bigint").alias("matched"))
    conforming = (F.col("projected") == total) & (F.col("matched") == total) & (F.col("unexpected") == 0) & (F.col("projected") > 0)
    return walked.select(
        "template_id", "subject", "length", "projected", "unexpected", "matched", (F.col("projected") > 0).alias("relevant"),
        conforming.alias("conforming"),
        F.when((F.col("projected") > 0) & ~conforming,
               deviation_detail(F.col("expected"), F.col("matched"), F.col("unexpected"), F.col("projected"))).alias("detail"))


def templates_summary(checked: DataFrame) -> DataFrame:
    """Subjects in scope, taking part and conforming, and the fit of every template with subjects."""
    sums = checked.groupBy("template_id").agg(
        F.count(F.lit(1)).alias("in_scope"), F.count_if("relevant").alias("relevant"), F.count_if("conforming").alias("conforming"))
    return sums.withColumn("fit_pct", pct(F.col("conforming"), F.col("relevant")))


# --- designed machines -------------------------------------------------------


def model_fit(checked: DataFrame) -> DataFrame:
    """Subjects, conforming subjects and their share."""
    sums = checked.agg(F.count(F.lit(1)).alias("subjects"), F.count_if("ok").alias("conforming"))
    return sums.withColumn("fit_pct", pct(F.col("conforming"), F.col("subjects")))


def model_deviations(checked: DataFrame, limit: int = MODEL_DEVIATIONS) -> DataFrame:
    """First deviating subjects in the order they appear in the log."""
    return checked.where("NOT ok").orderBy("first_id").limit(limit).select("subject", "fail_ix", "reason")


def _designed(log: DataFrame, model: Model) -> DataFrame:
    names = list(dict.fromkeys(e.type for e in model.edges if e.type))
    return small_table(log.sparkSession, [(i, n) for i, n in enumerate(names)], "pos bigint, type string")


def unused_types(log: DataFrame, model: Model) -> DataFrame:
    """Designed types that never occur, in draft order."""
    seen = log.select("type").distinct()
    return _designed(log, model).join(seen, "type", "left_anti").select("pos", "type").orderBy("pos")


def unknown_types(log: DataFrame, model: Model) -> DataFrame:
    """Real types the design does not know, sorted."""
    return log.select("type").distinct().join(_designed(log, model), "type", "left_anti").select("type").orderBy("type")


def edge_coverage(checked: DataFrame, model: Model) -> DataFrame:
    """Distinct designed edges that real walks took (``check_log(with_edges=True)``)."""
    taken = checked.select(F.explode("used").alias("edge")).distinct().agg(F.count(F.lit(1)).alias("covered"))
    total = F.lit(len(model.edges)).cast("bigint")
    return taken.select("covered", total.alias("total"), pct(F.col("covered"), total).alias("pct"))


def run_suite(cases: DataFrame, machines: DataFrame, nodes: DataFrame) -> DataFrame:
    """Judge written test cases (model_id, case_id, steps, outcome, end_state)."""
    judged = judge(check_sequences(cases, machines), nodes)
    name = lambda n: F.coalesce(F.element_at("names", n), n)
    walked = F.coalesce(F.array_join(F.transform("path", name), " → "), F.lit(""))
    return judged.select(*cases.columns, "passed", "detail", walked.alias("walked"))


def judge(checked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Compare verdicts with what was expected: needs model_id, outcome, end_state.

    Adds ``passed``, ``detail`` and the node ``names`` of the model.
    """
    labels = nodes.groupBy("model_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "node_id", F.coalesce(F.nullif("label", F.lit("")), F.col("node_id")).alias("label")))).alias("names")
    )
    judged = checked.join(labels, "model_id", "left")
    name = lambda n: F.coalesce(F.element_at("names", n), n)
    last, want = F.col("end_node"), F.coalesce("end_state", F.lit(""))
    ends_right = (want == "") | F.coalesce(last == want, F.lit(False))
    reject = F.col("outcome") == "reject"
    detail = (
        F.when(reject & F.col("ok"), F.lit("expected rejection, but the sequence is a valid walk"))
        .when(reject, F.concat(F.lit("correctly rejected — "), "reason"))
        .when(~F.col("ok"), F.col("reason"))
        .when(~ends_right, F.concat(F.lit("ended in "), F.coalesce(name(last), F.lit("")), F.lit(", expected "), name(want)))
        .otherwise("valid walk")
    )
    return judged.withColumns({
        "passed": F.when(reject, ~F.col("ok")).otherwise(F.col("ok") & ends_right), "detail": detail,
    })


def stream_verdict(checked: DataFrame, payload_faults: DataFrame) -> DataFrame:
    """Per subject: refused by the machine, else by a payload, else accepted."""
    bad = payload_faults.select("subject").distinct().withColumn("bad_payload", F.lit(True))
    return checked.join(bad, "subject", "left").select(
        "subject",
        (~F.col("ok") | F.coalesce("bad_payload", F.lit(False))).alias("rejected"),
        F.when(~F.col("ok"), F.col("reason"))
        .when(F.coalesce("bad_payload", F.lit(False)), F.lit("payload rejected"))
        .otherwise("")
        .alias("reason"),
    )


def quality_report(verdicts: DataFrame, coverage: DataFrame) -> DataFrame:
    """Accepted and refused subjects with edge coverage, as one row."""
    sums = verdicts.agg(F.count_if(~F.col("rejected")).alias("passed"), F.count_if("rejected").alias("failed"))
    return sums.crossJoin(coverage.select(
        F.col("covered").alias("covered_edges"), F.col("total").alias("total_edges"), F.col("pct").alias("coverage_pct")
    ))


def failures_by_reason(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("rejected").groupBy("reason").agg(F.count(F.lit(1)).alias("subjects"))


def failing_sequences(verdicts: DataFrame, log: DataFrame) -> DataFrame:
    """Refused subjects with reason and steps, in numbered blocks (subject, reason, block, types)."""
    failed = cut_lineage(verdicts.where("rejected").select("subject", "reason"))  # used twice
    return sequences(log.join(failed.select("subject"), "subject", "left_semi")).join(failed, "subject").select(
        "subject", "reason", "block", "types")


def round_trip(written: DataFrame, read_back: DataFrame, machine: DataFrame) -> DataFrame:
    """Events and subjects on both sides, and how many read-back subjects conform."""
    sides = [
        df.groupBy("subject").agg(F.count(F.lit(1)).alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(f"{name}_events"), F.count(F.lit(1)).alias(f"{name}_subjects")
        )
        for name, df in (("written", written), ("read", read_back))
    ]
    fit = check_log(read_back, machine).agg(F.count_if("ok").alias("conforming"))
    return sides[0].crossJoin(sides[1]).crossJoin(fit)


def round_trip_differences(written: DataFrame, read_back: DataFrame) -> DataFrame:
    """Events present on one side only, matched by subject, position and type."""
    keys = ["subject", "pos", "type"]
    slices = find_slices(written)  # cut points serve both sides: they only affect balance
    left = in_order(written, slices).df.select(*keys, F.lit(True).alias("was_written"))
    right = in_order(read_back, slices).df.select(*keys, F.lit(True).alias("was_read"))
    both = left.join(right, keys, "full")
    return both.where("was_written IS NULL OR was_read IS NULL").select(
        *keys, F.when(F.col("was_read").isNull(), "missing").otherwise("added").alias("difference")
    )
