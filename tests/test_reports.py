"""Lessons, evaluations and rejections as tables and texts."""

import json

from pyspark.sql import functions as F

from threadloom.plans import reports

COLUMNS = "tree long, seq long, type string, node long, text string, correction long, corrected_text string, summary string, lesson boolean"
ROWS = [
    (1, 1, "scope_drift", 4, "make <it> big", 5, 'keep "it" small', "s1", True), (1, 2, "overbuilt_solution", 5, None, None, None, "s2", True), (1, 3, "scope_drift", 4, "again", 7, "no", "s3", True),
    (1, 4, "model_refused", 9, "do harm", None, None, "s4", True), (1, 5, "format_violation", 2, "as JSON", None, None, "s5", False), (2, 1, "format_violation", 1, "as JSON", None, None, "s6", True), *[(3, i, "scope_drift", i, "x", None, None, "s", True) for i in range(1, 12)],
]


def test_lessons(spark):
    found = {(r["tree"], r["lesson_id"]): r for r in reports.lessons(spark.createDataFrame(ROWS, COLUMNS)).collect()}
    assert {k: (r["type"], r["ids"]) for k, r in found.items() if k[0] < 3} == {
        (1, "lesson_001"): ("scope_drift", ["node_004"]), (1, "lesson_002"): ("overbuilt_solution", ["node_005"]), (1, "lesson_003"): ("model_refused", ["node_009"]), (2, "lesson_001"): ("format_violation", ["node_001"]),
    }
    assert found[1, "lesson_001"]["text"].endswith('Specifically, the user directed: keep "it" small') and "harm" not in found[1, "lesson_003"]["text"]
    text = {r["tree"]: r["markdown"] for r in reports.lessons_markdown(reports.lessons(spark.createDataFrame(ROWS, COLUMNS))).collect()}
    assert text[2] == "# Lessons\n\n- **Preserve requested output formats.** as JSON [node_001]\n"
    assert text[3].endswith("[node_001, node_002, node_003, node_004, node_005, node_006, node_007, node_008, +3 more]\n") and text[1].count("\n- ") == 3


def test_evaluations(spark):
    found = reports.evaluations(spark.createDataFrame(ROWS, COLUMNS)).filter("tree < 3").cache()
    rows = {(r["tree"], r["eval_id"]): r for r in found.collect()}
    assert {k: (r["type"], r["context"], r["ids"]) for k, r in rows.items()} == {
        (1, "eval_001"): ("scope_drift_detection", "s1", ["node_004", "node_005", "node_007"]), (1, "eval_002"): ("refusal_handling", "s4", ["node_009"]), (1, "eval_003"): ("constraint_preservation", "s5", ["node_002"]), (2, "eval_001"): ("constraint_preservation", "s6", ["node_001"]),
    }
    assert rows[1, "eval_001"]["input"] == 'Honor this correction and keep building: "keep \\"it\\" small"' and rows[1, "eval_003"]["input"] == 'Honor this stated requirement and keep building: "as JSON"'
    assert "harm" not in rows[1, "eval_002"]["input"]
    lines = [json.loads(r["json"]) for r in reports.evaluation_lines(found).collect()]
    assert {(x["id"], x["type"]) for x in lines} == {("eval_001", "scope_drift_detection"), ("eval_002", "refusal_handling"), ("eval_003", "constraint_preservation"), ("eval_001", "constraint_preservation")}


def test_rejection_ledger(spark):
    rows = [(1, 2, "a", None, "2024-01-02T00:00:00Z"), (1, 1, "b", "2024-01-03T00:00:00Z", "x"), (1, 3, "c", "2024-01-02T00:00:00Z", None), (1, 9, "d", None, None), (1, 8, "e", "odd", None)]
    out = reports.rejection_ledger(spark.createDataFrame(rows, "tree long, node long, kind string, ts string, node_ts string")).orderBy("place").collect()
    assert [(r["kind"], r["ts"]) for r in out] == [("a", "2024-01-02T00:00:00Z"), ("c", "2024-01-02T00:00:00Z"), ("b", "2024-01-03T00:00:00Z"), ("e", "odd"), ("d", None)]


def test_empty(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert reports.lessons(none).count() == reports.evaluations(none).count() == reports.lessons_markdown(reports.lessons(none)).count() == 0
