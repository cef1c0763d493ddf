"""Evidence, plans and command fragments on worked examples."""

import pytest
from pyspark.sql import functions as F

from quillet.functions import command
from quillet.operators import evidence, policy, runs

FRAGMENTS = "f array<struct<kind:string,text:string>>"


@pytest.mark.parametrize(
    ("parts", "status"),
    [
        ([("literal", "ls "), ("quoted", "a")], "SANITIZED"),
        ([("literal", "ls"), ("literal", " "), ("quoted", "a"), ("literal", " -l")], "SANITIZED"),
        ([("literal", "ls "), ("raw", "a")], "UNSANITIZED"),
        ([("literal", "ls "), ("raw", "a"), ("unknown", "")], "AMBIGUOUS"),
        ([("quoted", "a")], "AMBIGUOUS"),
        ([("literal", "ls x"), ("quoted", "a")], "AMBIGUOUS"),
        ([("literal", "ls "), ("quoted", "a"), ("literal", "b")], "AMBIGUOUS"),
        ([("literal", "ls "), ("quoted", "a"), ("quoted", "b")], "AMBIGUOUS"),
        ([("literal", "exec ls "), ("quoted", "a")], "SANITIZED"),
        ([("literal", "exec env "), ("quoted", "a")], "AMBIGUOUS"),
        ([("literal", "X=1 ls "), ("quoted", "a")], "AMBIGUOUS"),
        ([("literal", "ba"), ("literal", "sh x")], "AMBIGUOUS"),
        ([("literal", "ls; "), ("raw", "a")], "AMBIGUOUS"),
        ([("literal", "ls -l")], "SANITIZED"),
        ([("literal", None)], "AMBIGUOUS"),
        ([("literal", "ls \x01")], "AMBIGUOUS"),
        ([], "SANITIZED"),
        (None, "AMBIGUOUS"),
    ],
)
def test_shell_status(spark, parts, status):
    assert spark.createDataFrame([(parts,)], FRAGMENTS).select(command.shell_status(F.col("f"))).first()[0] == status


def test_value_identifiers_of_long_literals(spark):
    text = 'name + "' + 'x\\"' * 100_000 + '" + Foo(value, null) + $a'
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(command.value_identifiers(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "name", "value"], None, []]


def test_sanitizers_in_a_helper_need_a_flow_of_this_case(spark):
    content = '{"path": "h.py", "findings": [1], "candidate_sanitizer_flows": [{"source_path": "a.py", "helper_path": "h.py", "sink_line": 7, "sanitizer_lines": [3]}]}'
    rows = [("a.py", 7, True, content), ("a.py", None, True, content), ("a.py", 8, True, content), ("b.py", 7, True, content), ("a.py", 7, None, content), ("h.py", 7, None, content), (None, None, None, content), ("a.py", 7, True, None), ("a.py", 7, True, "[1]")]
    df = spark.createDataFrame(rows, "entry string, line long, same boolean, content string")
    says = evidence.affirmative_safe(F.lit("find_sanitizers"), F.lit("UNRESOLVED"), F.lit(False), F.col("same"), F.col("entry"), F.col("line"), F.lit(None).cast("string"), F.col("content"))
    assert [r[0] for r in df.select(says).collect()] == [True, True, False, False, False, True, True, False, False]


def test_records_that_disagree_are_an_error(spark):
    events = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, None, False)], "case_id long, response_id string, has_choices boolean")
    same = spark.createDataFrame([("a", "S"), ("a", "S")], "response_id string, block_reason string")
    got = {r["case_id"]: r["diagnosis"] for r in evidence.response_classes(events, same).collect()}
    assert got == {1: "upstream_blocked", 2: "empty_response_unresolved", 3: "empty_response_unresolved"}
    for other in ("T", None):
        with pytest.raises(Exception, match="conflicting native evidence"):
            evidence.response_classes(events, same.union(spark.createDataFrame([("a", other)], same.schema))).collect()


def test_unreaching_tasks_of_long_and_cyclic_plans(spark):
    chain = [(1, k, evidence.FIXTURE_TOOL if k == 0 else "t", [k - 1] if k else []) for k in range(9)]
    cycle = [(2, 1, "t", [2]), (2, 2, "t", [1]), (2, 3, evidence.FIXTURE_TOOL, None), (3, 1, "t", [])]
    df = spark.createDataFrame([*chain, *cycle], "case_id long, task_id long, tool string, dependencies array<long>")
    assert sorted(map(tuple, evidence.unreaching(df).collect())) == [(2, 1), (2, 2)]
    assert evidence.unreaching(df.limit(0)).count() == 0


def test_compared_versions(spark):
    rows = [("old", "os.system(x)\n"), ("none", "x = 1\n"), ("late", "os.system(x)\nauthorize()\n"), ("early", "authorize()\nos.system(x)\n")]
    facts = evidence.version_facts(spark.createDataFrame([(p, "python", t) for p, t in rows], "path string, language string, text string"))
    pairs = spark.createDataFrame([("old", p) for p in ("none", "late", "early", "absent")], "path string, fixed_path string")
    got = {r["fixed_path"]: (r["new_sinks"], r["guard_precedes_sinks"], r["supports_fix"]) for r in evidence.compared_versions(pairs, facts, facts).collect()}
    assert got == {"none": (0, False, True), "late": (1, False, False), "early": (1, True, True), "absent": (None, None, None)}


def test_direct_answers(spark):
    good = '{"label": "SAFE", "confidence": 1e0, "rationale": "r", "more": []}'
    rows = [good, f"```\n{good}\n```", f"```json\n{good}```", f" {good}\n", None, "", "```", "[1]", good.replace("1e0", "1.01"), good.replace("1e0", "null"), good.replace("1e0", "-1"), good.replace('"r"', "null"), good.replace("SAFE", "safe")]
    got = spark.createDataFrame([(r,) for r in rows], "c string").select(runs.direct_answer(F.col("c")).alias("a")).collect()
    assert [r["a"] is not None for r in got] == [True] * 4 + [False] * 9
    assert got[0]["a"].asDict() == {"label": "SAFE", "confidence": 1.0, "rationale": "r"}


def test_configuration_of_nulls(spark):
    kinds = "c array<string>, s array<string>, m int, n int, e string"
    df = spark.createDataFrame([(None, None, None, None, None), (["a", "b"], list(runs.SYSTEMS), 10, 2, "doPost")], kinds)
    got = [r[0] for r in df.select(runs.ten_trial_issues(*[F.col(c) for c in df.columns])).collect()]
    assert got == [["case_ids", "systems", "max_trials", "concurrency", "entry_method"], []]


def test_prediction_issues_of_cases_without_observations(spark):
    said = spark.createDataFrame([(1, "SAFE", "UNRESOLVED", 1), (2, "SAFE", "REFUTED", 1), (3, "SAFE", "REFUTED", 1), (4, "SAFE", "REFUTED", 1), (5, "VULNERABLE", "REFUTED", 1)], "case_id long, label string, validation_status string, n_evidence long")
    seen = spark.createDataFrame([(3, "o", "REFUTED", None, True), (4, "o", "REFUTED", False, True), (4, "p", "CONFIRMED", True, True)], "case_id long, identity string, validation_status string, truncated boolean, same_subject boolean")
    cited = spark.createDataFrame([(3, "o"), (3, "o")], "case_id long, identity string")
    support = spark.createDataFrame([(3, "o"), (4, "o")], cited.schema)
    got = policy.prediction_issues(said, seen, cited, support, spark.createDataFrame([], "case_id long"))
    assert {r["case_id"]: r["issue"] for r in got.collect()} == {1: None, 2: "unmatched", 3: None, 4: "bibliography", 5: "label"}


def test_cells_with_rows_twice_or_never(spark):
    cells = runs.planned_cells(spark.createDataFrame([(1, True)], "case_id long, ground_truth boolean"), ("E1", "E2", "E3"))
    rows = spark.createDataFrame([(1, "E1", "completed", "SAFE"), (1, "E2", "completed", "SAFE"), (1, "E2", "completed", "SAFE"), (1, "E9", "completed", "SAFE")], "case_id long, system string, status string, label string")
    got = {r["system"]: (r["status"], r["label"]) for r in runs.rows_with_truth(cells, rows).collect()}
    assert got == {"E1": ("completed", "SAFE"), "E2": ("failed", None), "E3": ("not_run", None)}
