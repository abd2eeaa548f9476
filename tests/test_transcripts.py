"""Native transcripts: who wrote a user record's text, what came before it, titles and refusals."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.plans import lineage_plan
from threadloom.sources import transcripts

TEXTS = {
    "build it": "build it", "  \n": None, "": None, None: None, "<system-reminder>x</system-reminder> go on": "go on", "<system-reminder>never closed": None, "<task-notification>a</task-notification>\n<system-reminder>b": None,
    "<command-name>/fix</command-name><command-args> all of it </command-args>": "/fix all of it", "<command-name>/clear</command-name>": None, "<command-message>m</command-message><command-args>x</command-args>": "(command) x",
    "<bash-stdout>out</bash-stdout>": None, "Caveat: The messages below were made": None, "This session is being continued from a previous conversation.": None, "see <system-reminder> tags": "see <system-reminder> tags",
}


def test_user_text(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", transcripts.user_text(F.col("t"), F.lit(False)).alias("x"))
    assert {r["t"]: r["x"] for r in rows.collect()} == TEXTS
    assert spark.range(1).select(transcripts.user_text(F.lit(" "), F.lit(True))).first()[0] == transcripts.IMAGE_ONLY


def user(text, **more):
    return {"type": "user", "message": {"content": text}} | more


def agent(*blocks, **message):
    return {"type": "assistant", "message": {"content": list(blocks)} | message}


def said(text):
    return {"type": "text", "text": text}


def call(name, **arguments):
    return {"type": "tool_use", "id": "t", "name": name, "input": arguments}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("sessions")
    lines = {
        "a": [
            {"type": "summary", "summary": "first"}, {"type": "ai-title", "aiTitle": "given"}, {"type": "summary", "summary": "second"}, user("lower the latency of the gateway"), agent(said("I added a plugin registry"), call("Write", file_path="src/registry.py")), agent(call("Read")),
            user("rip the plugins out of registry.py"), agent(said("I'd rather not do that"), call("Bash", command="ls ./src/a.py")), user("that's not what i asked, the whole point is latency"), agent(said("I'd rather not do that")), agent(said("I cannot do that."), stop_reason="refusal"),
            user("[Request interrupted by user]"), user("from the sdk", promptSource="sdk"), user("from a helper", agentId="x"), user("[image]", toolUseResult={}), user([{"type": "image"}]), user("a summary", isCompactSummary=True),
        ],
        "b": [user("the latency of it", isCompactSummary=True), user("missed the point: latency"), {"type": "custom-title", "customTitle": "mine"}, {"type": "ai-title", "title": "late"}],
        "c": [{"type": "summary", "summary": "only"}, agent(said("unasked")), {"type": "assistant", "message": {"content": "a string"}}],
    }
    for name, rows in lines.items():
        (path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def of(rows, name, *columns):
    own = sorted((r for r in rows.collect() if r["file"].endswith(f"{name}.jsonl")), key=lambda r: r["ord"] if "ord" in r else 0)
    return [tuple(r[c] for c in columns) for r in own]


def test_titles(spark, folder):
    found = transcripts.titles(transcripts.records(spark, folder))
    assert [of(found, n, "title") for n in "abc"] == [[("given",)], [("mine",)], [("only",)]]


def test_prompts_in_context(spark, folder):
    rows = transcripts.with_context(transcripts.records(spark, folder)).cache()
    assert [t for (t,) in of(rows, "a", "text")] == ["lower the latency of the gateway", "rip the plugins out of registry.py", "that's not what i asked, the whole point is latency", transcripts.IMAGE_ONLY]
    before = [p and set(p) for (p,) in of(rows, "a", "prior_tokens")]
    assert before[0] is None and {"registry.py", "registry", "plugin", "added"} <= before[1] and {"a.py", "rather"} <= before[2]
    assert all(set(g) == {"lower", "latency", "gateway"} for (g,) in of(rows, "a", "goal_tokens"))
    # a session that goes on from another has no goal of its own
    assert of(rows, "b", "text", "prior_tokens", "goal_tokens") == [("missed the point: latency", None, None)]


def test_rejections_by_structure(spark, folder):
    rows = transcripts.rejections(transcripts.records(spark, folder)).cache()
    assert of(rows, "a", "ord", "kind", "confidence") == [(7, "user_text_decline", 0.8), (9, "user_text_decline", 0.8), (10, "model_refusal", 0.7), (11, "model_refusal", 0.95), (12, "user_interrupt", 1.0)]
    assert of(rows, "b", "kind") == [] and of(rows, "c", "kind") == []


def test_redirects_are_corrections(spark, folder):
    rows = lineage_plan.nodes(spark, folder).withColumnRenamed("tree", "file")
    assert of(rows, "a", "kind") == [("root",), ("correction",), ("correction",), ("direction",)]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("")
    found = transcripts.records(spark, str(tmp_path))
    assert transcripts.titles(found).count() == transcripts.with_context(found).count() == transcripts.rejections(found).count() == 0
