"""Steps that once ran again, or in one place, as logs grew."""

from pyspark.sql import functions as F

from trailweave.operators import conformance, explore, relations, space, variants
from trailweave.operators.discovery import discover
from trailweave.operators.ordering import in_order, kept_order
from trailweave.session import small_table

LOG = {"/a/1": "x y z x y", "/a/2": "x z y", "/b/3": "x y y z", "/b/4": "z"}


def rows(df):
    return sorted(map(repr, df.collect()))


def test_a_hot_pattern_is_dealt_to_parts(spark):
    """Pairs are the same however many parts a pattern is dealt to."""
    matched = small_table(spark, [(f"/s/{n}", p) for n in range(50) for p in ("", "/s/{id}")], "subject string, subject_pattern string")
    known = small_table(spark, [("t1", "", ["a"]), ("t2", "", ["b"]), ("t3", "/s/{id}", ["a", "b"])],
                        "template_id string, subject_pattern string, expected array<string>")
    got = rows(conformance.templates_of(matched, known, spread=3))
    assert len(got) == 150 and got == rows(conformance.templates_of(matched, known, spread=1000))


def test_flow_and_pieces_are_written_once(make_log):
    """Runs need neither ids nor the log again; the second caller reads the same table."""
    log = make_log(LOG)
    flow = kept_order(log)
    assert "id" not in flow.df.columns and rows(flow.df) == rows(in_order(log).df.drop("id"))
    found = discover(log, keep=True)
    pieces = variants.run_pieces(found)
    assert variants.run_pieces(found) is pieces and pieces.inputFiles()
    assert rows(variants.variants(found)) == rows(variants.variants(discover(log)))


def test_bands_do_not_read_the_log_again(make_log):
    bands = space.subject_bands(make_log(LOG), 2)
    assert "Exchange" not in bands._jdf.queryExecution().executedPlan().toString()
    assert {(r["from"], r["to"], r["subjects"]) for r in bands.collect()} == {("/a/1", "/a/2", 2), ("/b/3", "/b/4", 2)}


def test_payload_is_parsed_outside_the_generator(spark):
    data = ['{"customerId":"c1","x":{"partRef":"p\\"2"},"id":"7","n":"a:b"}', '{"a":"b"} x', None, '{"orderId":5,"userIds":""}']
    log = small_table(spark, [(str(i), "/s", d) for i, d in enumerate(data)], "id string, subject string, data string")
    found = relations.payload_references(log)
    assert {tuple(r) for r in found.collect()} == {("0", "/s", "customerId", "/customers/c1"), ("0", "/s", "partRef", '/parts/p"2')}
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not any("Generate" in line and "parse_json" in line for line in lines)


def test_tree_groups_by_path_alone(spark, make_log):
    tree = relations.subject_tree(make_log(LOG))
    assert "depth" not in tree._jdf.queryExecution().analyzed().toString().split("Aggregate", 1)[1]
    assert {(r.path, r.depth, r.seg, r.is_id, r.events, r.instances) for r in tree.where(F.col("depth") == 2).collect()} == {
        ("/a/{id}", 2, "{id}", True, 8, 2), ("/b/{id}", 2, "{id}", True, 5, 2)}


def test_running_counts_read_the_log_once(spark, make_log):
    """What the counts need of a log is written once; a costly log (a join) is not made again for cuts and counts."""
    log = make_log({"/a": "x y x", "/b": "y y x"})
    names = small_table(spark, [("x", "kind.x"), ("y", None)], "type string, name string")
    made = log.join(names.hint("merge"), "type").select("id", "source", "subject", F.col("name").alias("type"))
    found = explore.running_counts(made)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.columns == ["id", "subject", "type", "so_far"]
    assert sorted((row["id"][-1], row["subject"], row["type"], row["so_far"]) for row in found.collect()) == [
        ("0", "/a", "kind.x", 1), ("1", "/a", "", 1), ("2", "/a", "kind.x", 2), ("3", "/b", "", 2), ("4", "/b", "", 3), ("5", "/b", "kind.x", 3)]
