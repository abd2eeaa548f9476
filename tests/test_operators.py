"""Windows, trees, failures and references on small tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import failures, lineage, references, sequence, stats
from threadloom.sources import transcripts


def test_fold_counts_nudges_and_repeats(spark):
    texts = ["yes", "build it", "yes", "go on now please sir", "build  it", "ok", "build it", "build it"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "tree long, n long, text string")
    out = {r["n"]: (r["nudges"], r["repeats"]) for r in sequence.folded(rows, ["tree"], ["n"], T.is_nudge(F.col("text"))).collect()}
    # a nudge before any text stays; a repeat after a nudge is still a repeat of the text before it
    assert out == {0: (0, 0), 1: (1, 0), 3: (0, 0), 4: (1, 2)}


def test_windows(spark):
    rows = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, True), (1, 3, "b", None), (2, 1, None, None)], "tree long, n long, v string, f boolean")
    out = rows.select("tree", "n", sequence.latest_before(F.col("v"), ["tree"], ["n"]).alias("v"), sequence.seen_before(F.coalesce("f", F.lit(False)), ["tree"], ["n"]).alias("s")).collect()
    assert {(r["tree"], r["n"]): (r["v"], r["s"]) for r in out} == {(1, 1): (None, False), (1, 2): ("a", False), (1, 3): ("a", True), (2, 1): (None, False)}


def test_deep_chain_and_fork(spark):
    edges = [(1, i, i - 1 if i > 1 else None) for i in range(1, 201)] + [(1, 500, 100), (1, 501, 500), (1, 900, None)]
    nodes = spark.createDataFrame(edges, "tree long, node long, parent long")
    leaves = spark.createDataFrame([(1, 200)], "tree long, node long")
    assert {r["node"] for r in lineage.main_path(nodes, leaves).collect()} == set(range(1, 201))
    status = lineage.abandoned(nodes, leaves)
    assert {r["node"] for r in status.filter("status = 'abandoned'").collect()} == {500, 501}
    assert [tuple(r) for r in lineage.abandoned_branches(status).collect()] == [(1, 1)]
    sizes = {r["node"]: r["size"] for r in lineage.subtree_sizes(nodes).collect()}
    assert sizes[1] == 202 and sizes[200] == 1 and sizes[500] == 2


def test_lineage_is_whole_and_not_quadratic(spark, monkeypatch):
    r, n = random.Random(3), 400
    # a chain, a tree of random parents, and two roots in one tree
    parents = {1: {i: i - 1 if i > 1 else None for i in range(1, n + 1)}, 2: {i: r.randrange(max(1, i - 9), i) if i > 1 else None for i in range(1, n + 1)}}
    parents[3] = {i: i - 2 if i > 2 else None for i in range(1, 42)}
    leaf = {1: n - 20, 2: n, 3: 41}
    nodes = spark.createDataFrame([(t, i, p) for t, own in parents.items() for i, p in own.items()], "tree long, node long, parent long")
    leaves = spark.createDataFrame(list(leaf.items()), "tree long, node long")
    held, cut = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df: held.append(cut(df)) or held[-1])
    main = {(x["tree"], x["node"]) for x in lineage.main_path(nodes, leaves).collect()}
    status = {(x["tree"], x["node"]): x["status"] for x in lineage.abandoned(nodes, leaves).collect()}
    sizes = {(x["tree"], x["node"]): x["size"] for x in lineage.subtree_sizes(nodes).collect()}

    def above(t, i):
        while (i := parents[t][i]) is not None:
            yield i

    up = {(t, i): list(above(t, i)) for t, own in parents.items() for i in own}
    path = {(t, i) for t in parents for i in [leaf[t], *up[t, leaf[t]]]}
    under = Counter((t, a) for (t, _), own in up.items() for a in own)
    assert main == path
    assert status == {(t, i): "abandoned" if (t, i) not in path and any((t, a) in path for a in own) else "accepted" for (t, i), own in up.items()}
    assert sizes == {k: under[k] + 1 for k in up}
    assert max(df.count() for df in held) <= len(up)


def test_failures_and_lessons(spark):
    rows = spark.createDataFrame([(1, 5, "user_interrupt", 0.9), (1, 5, "user_declined_tool", 1.0), (1, 2, "model_refusal", 0.7)], "tree long, node_ord long, kind string, confidence double")
    found = failures.deduplicated(failures.from_rejections(rows))
    assert {(r["failure_id"], r["type"], r["confidence"], r["tier"]) for r in found.collect()} == {("failure_001", "model_refused", 0.7, "confirmed"), ("failure_002", "user_rejected_action", 1.0, "verified")}
    assert [(r["lesson_id"], r["type"]) for r in failures.lessons(found).orderBy("lesson_id").collect()] == [("lesson_001", "model_refused"), ("lesson_002", "user_rejected_action")]


def test_references(spark):
    turns = spark.createDataFrame([(1, 1, "see src/a.ts and lib/gone.py"), (1, 2, "import x from 'left-pad/sub'\nimport os"), (1, 3, "from './local' import y")], "tree long, ord long, text string")
    refs = references.file_references(turns)
    existing = spark.createDataFrame([("src/a.ts",)], "path string")
    created = spark.createDataFrame([], "tree long, path string")
    assert [r["ref"] for r in references.missing_files(refs, existing, created).collect()] == ["lib/gone.py"]
    declared = spark.createDataFrame([("os",)], "package string")
    assert {r["package"] for r in references.undeclared(references.imports(turns), declared).collect()} == {"left-pad"}


def test_token_usage_takes_a_messages_last_record(spark):
    rows = spark.createDataFrame([(1, "a", 1, 10, 1), (1, "a", 2, 12, 3), (1, "b", 3, 0, 0), (1, "c", 4, 5, 0)], "tree long, message_id string, ord long, input_tokens long, output_tokens long")
    assert [tuple(r) for r in stats.token_usage(rows, ["tree"], "ord").collect()] == [(1, 17, 3)]


def test_native_transcript(spark, tmp_path):
    lines = [
        '{"type":"user","uuid":"u1","sessionId":"s","timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"build it"}}', "not json", '{"type":',
        '{"type":"assistant","uuid":"a1","parentUuid":"u1","timestamp":"2024-01-01T00:00:01Z","message":{"id":"m","model":"x","usage":{"input_tokens":3,"output_tokens":4},"content":[{"type":"text","text":"ok"},{"type":"tool_use","id":"t","name":"Bash","input":{"command":"rm -rf x"}}]}}',
        '{"type":"user","uuid":"u2","timestamp":"2024-01-01T00:00:02Z","message":{"content":[{"type":"tool_result","tool_use_id":"t","is_error":true,"content":"permission denied"}]}}',
        '{"type":"user","uuid":"u3","timestamp":"2024-01-01T00:00:03Z","message":{"content":[{"type":"text","text":"stop that"}]}}', '{"type":"user","isMeta":true,"message":{"content":"meta"}}',
        '{"type":"assistant","uuid":"a2","message":{"id":"n","content":[{"type":"text","text":"I cannot do that."}]}}',
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    found = transcripts.records(spark, str(tmp_path))
    assert found.count() == 6
    assert [r["text"] for r in transcripts.prompts(found).orderBy("ord").collect()] == ["build it", "stop that"]
    assert [(r["tool"], r["command"]) for r in transcripts.actions(found).collect()] == [("Bash", "rm -rf x")]
    assert {(r["kind"], r["confidence"]) for r in transcripts.rejections(found).collect()} == {("permission_denied", 0.85), ("user_text_decline", 0.8), ("model_refusal", 0.7)}
    assert [(r["input_tokens"], r["output_tokens"]) for r in transcripts.usage(found).filter("input_tokens > 0").collect()] == [(3, 4)]


def test_plain_transcript(spark):
    lines = ["preface", "User: hello", "more", "## Assistant: hi", "there", "**User:** bye"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, n long, line string")
    out = transcripts.marked_turns(rows, ["file"], ["n"]).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in out] == [("user", "hello\nmore"), ("assistant", "hi\nthere"), ("user", "bye")]


def test_chat_exports(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title":"t","mapping":{"n1":{"id":"n1","parent":null,"message":{"author":{"role":"user"},"create_time":1.5,"content":{"parts":["hi"]},"metadata":{}}},"n2":{"id":"n2","parent":"n1","message":{"author":{"role":"assistant"},"content":{"parts":["yo","x"]},"metadata":{"model_slug":"m"}}}}}]')
    (tmp_path / "b.json").write_text('{"messages":[{"role":"user","content":"q"},{"type":"gemini","text":"a","model":"g"}]}')
    tree = transcripts.tree_exports(spark, str(tmp_path / "a.json")).orderBy("node").collect()
    assert [(r["node"], r["parent"], r["role"], r["text"], r["model"]) for r in tree] == [("n1", None, "user", "hi", None), ("n2", "n1", "assistant", "yo\nx", "m")]
    flat = transcripts.message_lists(spark, str(tmp_path / "b.json")).orderBy("ord").collect()
    assert [(r["role"], r["text"], r["model"]) for r in flat] == [("user", "q", None), ("assistant", "a", "g")]


def test_plan_from_transcript_to_document(spark, tmp_path):
    import json

    from threadloom.plans import lineage_plan

    key = "AKIA" + "B2" * 8
    lines = [
        {"type": "user", "uuid": "1", "timestamp": "2024-01-01T00:00:00Z", "message": {"content": f"Build it with {key}. Thanks"}},
        {"type": "assistant", "uuid": "2", "message": {"id": "m", "usage": {"input_tokens": 2, "output_tokens": 1}, "content": [{"type": "tool_use", "id": "t", "name": "Write", "input": {"file_path": "a.py"}}]}},
        {"type": "user", "uuid": "3", "timestamp": "2024-01-02T00:00:01Z", "message": {"content": "yes"}},
        {"type": "user", "uuid": "4", "timestamp": "2024-01-02T00:00:02Z", "message": {"content": "No, undo that"}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, lines)))
    document = json.loads(lineage_plan.documents(spark, str(tmp_path)).first()["json"])
    assert [(n["kind"], n["nudges"]) for n in document["nodes"]] == [("root", 1), ("correction", 0)]
    assert document["nodes"][0]["text"] == "Build it with [REDACTED:aws-access-key]. Thanks"
    assert [(f["failure_id"], f["type"], f["node_ord"]) for f in document["failures"]] == [("failure_001", "user_rejected_action", 2)]
    row = lineage_plan.tree_stats(spark, str(tmp_path)).first()
    assert (row["prompts"], row["corrections"], row["nudges"], row["tool_uses"], row["files"], row["input_tokens"], row["days"]) == (2, 1, 1, 1, 1, 2, 2)


def test_streams(spark, tmp_path):
    from threadloom.streaming import sessions

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"tree":1,"ts":"2024-01-01T00:00:00","event_id":1,"role":"user","text":"No, undo it"}\n{"tree":1,"ts":"2024-01-01T00:10:00","event_id":2,"role":"assistant","text":"ok"}\n{"tree":1,"ts":"2024-01-01T03:00:00","event_id":3,"role":"user","text":"go"}\n')
    for name, frame, rows in (("w", sessions.windowed, {(1, 2), (1, 1)}), ("s", sessions.sessions, {(1, 2), (1, 1)})):
        query = frame(sessions.turns(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName(f"out_{name}").start()
        query.processAllAvailable()
        query.stop()
        assert {(r["tree"], r["turns"]) for r in spark.table(f"out_{name}").collect()} == rows
