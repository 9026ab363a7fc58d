"""Payload texts that are not quite JSON, for all operators that read payloads."""

import pytest
from pyspark.sql import functions as F

from trailweave.functions.payloads import whole_json
from trailweave.functions.text import rfc3339
from trailweave.operators import machine as m
from trailweave.operators import payload
from trailweave.operators import relations as r
from trailweave.operators.discovery import discover
from trailweave.session import small_table

GOOD = ['{"userId":"1"}', ' {"userId":"1"}\n', '{"userId":"0","userId":"1"}', '{"userId":"1","b":[1,{}]}']
BAD = ['{"userId":"1"}xyz', '{"userId":"1"} {"userId":"2"}', '{"userId":"1"},2', '{"userId":"1"}] [', '{"userId":"1"}}',
       '{"userId":"1"', "", '{"userId":"1"},"x"],[3', "{'userId':'1'}"]


def test_whole_json(spark):
    df = small_table(spark, [(t,) for t in [*GOOD, *BAD, "7", '"a"', "[1,2]", "null", "1,2"]], "t string")
    got = [row[0] for row in df.select(F.to_json(whole_json(F.col("t")))).collect()]
    assert got[2] == '{"userId":"1"}'
    assert [x is not None for x in got] == [True] * len(GOOD) + [False] * len(BAD) + [True, True, True, True, False]


@pytest.fixture(scope="module")
def log(spark):
    return small_table(spark, [(f"{i:02d}", "s", f"/a/{i}", "t", t) for i, t in enumerate(GOOD + BAD)],
                       "id string, source string, subject string, type string, data string")


def test_operators_agree(spark, log):
    bad = {row["id"] for row in payload.invalid_payloads(log).collect()}
    assert bad == {f"{i:02d}" for i in range(len(GOOD), len(GOOD + BAD)) if (GOOD + BAD)[i]}
    fields = payload.field_table(spark, m.Model("x", fields=(("t", m.Field("userId", "string", required=True, enum=("1",))),)))
    assert {row["id"] for row in payload.payload_faults(log, fields, True).where("rule = 'invalid_json'").collect()} == bad
    assert payload.validate_payload(log, fields, True).where(f"id < '{len(GOOD):02d}'").count() == 0
    assert r.payload_references(log).select("id").distinct().count() == len(GOOD)
    assert [(e["via"], e["count"]) for e in r.References(log).edges().collect()] == [("userId", len(GOOD))]


def test_names_are_counted_before_stems(spark, tmp_path):
    texts = ['{"userId":"1","n":1}', '{"userId":"2","n":2.5}', '{"orderIds":["1"],"n":{}}', '{"partRef":[1]}', '{"partRef":1}', "{}", "7", "{", None]
    log = small_table(spark, [(f"{i:02d}", "s", f"/a/{i}" if i % 4 else f"/b/{i}", "t", t) for i, t in enumerate(texts * 3)],
                      "id string, source string, subject string, type string, data string")
    log.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    found = r.payload_shapes(log)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower().replace("parse_json", "parsejson")
    # The payload is parsed in a projection of its own, not inside the function that goes over its names.
    assert not [line for line in plan.splitlines() if "lambda" in line and "parsejson" in line] and "parsejson" in plan and "lambda" in plan
    groups = {(row["owner"], tuple(map(tuple, row["names"])) if row["names"] is not None else None): (row["n"], row["first"]) for row in found.collect()}
    assert sum(n for n, _ in groups.values()) == log.count()
    assert groups["a", (("n", False), ("userId", False))] == (5, "01") and groups["a", (("n", False), ("orderIds", True))][0] == 2
    assert groups["a", None][0] + groups["b", None][0] == 9
    assert {tuple(row) for row in r.References(log).nodes().collect()} == {
        ("a", True, sum(1 for i in range(27) if i % 4)), ("b", True, sum(1 for i in range(27) if not i % 4)),
        ("user", False, 0), ("order", False, 0), ("part", False, 0)}


def test_wide_offsets(spark):
    given = [("2024-01-02T03:04:05+23:59", "2024-01-01 03:05:05"), ("2024-01-02T03:04:05-19:30", "2024-01-02 22:34:05"),
             ("2024-01-02T03:04:05,5Z", "2024-01-02 03:04:05.5"), ("2024-01-02T03:04:05.25+01:00", "2024-01-02 02:04:05.25"),
             ("2024-01-02T03:04:05+24:00", None), ("2024-13-02T03:04:05Z", None), ("2024-01-02 03:04:05Z", None)]
    df = small_table(spark, given, "t string, want string")
    assert all(row[0] == row[1] for row in df.select(rfc3339(F.col("t")).cast("string"), "want").collect())


def test_a_missing_type_is_a_type(spark):
    log = small_table(spark, [("1", "/a", "x"), ("2", "/a", None), ("3", "/a", "y")], "id string, subject string, type string")
    found = discover(log)
    assert tuple(found.totals.first()) == (1, 3, 1)
    assert {(row["type"], row["count"], row["start_count"]) for row in found.node_stats.collect()} == {("x", 1, 1), ("", 1, 0), ("y", 1, 0)}
