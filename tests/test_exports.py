"""Each export format once: it is known by its shape alone, and gives turns, calls and tokens."""

import json

import pytest

from threadloom.operators import lineage
from threadloom.sources import exports

DOCUMENTS = {
    "chatgpt": [{"title": "t", "mapping": {"r": {"parent": None, "children": ["a"]}, "a": {"parent": "r", "children": ["b"], "message": {"author": {"role": "user"}, "create_time": 5, "content": {"parts": ["hi", "there"]}}}, "b": {"parent": "a", "children": [], "message": {"author": {"role": "assistant"}, "create_time": 4.5, "content": {"parts": ["yo"]}, "metadata": {"model_slug": "m"}}}}}],
    "copilot": {"version": 3, "sessionId": "s", "requests": [{"message": {"text": "do it"}, "timestamp": 1700000000000, "result": {"metadata": {"modelId": "g"}}, "response": [{"kind": "toolInvocation", "toolId": "edit", "toolSpecificData": {"uri": {"path": "/a.py"}}}, {"kind": "toolInvocationSerialized", "prepareToolInvocation": {"toolName": "run"}, "toolSpecificData": {"commandLine": "ls"}}, {"kind": "other"}]}, {"message": {"parts": [{"text": "x"}, "y"]}}, None]},
    "gemini": {"sessionId": "s", "messages": [{"type": "user", "content": [{"text": "a"}, {"text": "b"}], "timestamp": "t1"}, {"type": "gemini", "content": "ok", "model": "g2", "tokens": {"input": 5, "output": 2}, "toolCalls": [{"name": "w", "args": {"absolute_path": "/x", "command": "c"}}]}, {"type": "gemini", "content": "", "tokens": {"prompt": 7}}, {"type": "info", "content": "z"}]},
    "cursor": {"id": "c", "workspaceId": "w", "messages": [{"role": "user", "content": "q", "timestamp": 1700000000000}, {"role": "assistant", "content": "r", "model": "m", "toolCalls": [{"name": "e", "filePath": "f.ts"}]}]},
    "grok": {"model": "grok-2", "conversation": [{"role": "user", "content": "why"}, {"role": "assistant", "content": [{"text": "so"}]}, {"role": "user", "content": "<system-reminder>x"}]},
    None: {"messages": "none", "rows": [1]},
}
LINES = {
    "codex": [{"type": "session_meta", "payload": {"id": "s9", "originator": "cli"}}, {"type": "turn_context", "payload": {"model": "m1"}}, {"type": "response_item", "timestamp": "t", "payload": {"type": "message", "role": "user", "content": [{"text": "go"}]}}, {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "<environment_context>"}},
              {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["ls", "-l"], "path": "p"})}}, {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 10, "output_tokens": 4}}}}, {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 30, "output_tokens": 0}}}}, {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": "done"}}],
    "gemini": [{"type": "user", "content": "one"}, {"type": "gemini", "content": "two", "model": "g", "tokens": {"input": 3}}],
}
OTHER_CURSOR = [
    ({"prompts": ["a", {"text": "b"}]}, ["a", "b"]), ({"tabs": [{"bubbles": [{"type": "user", "text": "c"}, {"type": "ai", "text": "d", "toolFormerData": {"name": "t", "params": '{"target_file":"z"}'}}]}, {"messages": [{"type": 1, "text": "e"}]}]}, ["c", "e"]),
    ({"bubbles": [{"bubbleId": "1", "type": 1, "richText": "f"}]}, ["f"]), ([{"type": 1, "text": "g"}, {"type": 2, "text": "h"}], ["g"]), ({"conversation": [{"bubbleId": "x", "role": "user", "text": "i"}]}, ["i"]),
]


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("documents")
    for name, value in DOCUMENTS.items():
        (folder / f"{name}.json").write_text(json.dumps(value, indent=1))
    (folder / "broken.json").write_text('{"a": [')
    return exports.read_documents(spark, str(folder)).cache()


def name(row):
    return row["file"].rpartition("/")[2].partition(".")[0]


def test_each_shape_has_one_format(documents):
    assert {name(r): r["format"] for r in documents.collect()} == {str(k): k for k in DOCUMENTS}


def test_turns_calls_and_tokens(documents):
    found = exports.messages(documents).unionByName(exports.tree_turns(documents), allowMissingColumns=True)
    said = {}
    for r in sorted(exports.turns(found).collect(), key=lambda r: r["ord"]):
        said.setdefault(name(r), []).append((r["role"], r["text"], r["model"]))
    assert said == {
        "chatgpt": [("assistant", "yo", "m"), ("user", "hi\nthere", None)], "copilot": [("user", "do it", "g"), ("user", "x\ny", None)], "gemini": [("user", "a\nb", None), ("assistant", "ok", "g2"), ("assistant", "", None)],
        "cursor": [("user", "q", None), ("assistant", "r", "m")], "grok": [("user", "why", "grok-2"), ("assistant", "so", "grok-2")],
    }
    assert {r["ts"] for r in exports.turns(found).collect() if name(r) in ("copilot", "cursor") and r["ts"]} == {"2023-11-14T22:13:20.000Z"}
    calls = {(name(r), r["tool"], r["path"], r["command"], r["model"]) for r in exports.actions(exports.messages(documents)).collect()}
    assert calls == {("copilot", "edit", "/a.py", None, "g"), ("copilot", "run", None, "ls", "g"), ("gemini", "w", "/x", "c", "g2"), ("cursor", "e", "f.ts", None, "m")}
    assert [(r["input_tokens"], r["output_tokens"]) for r in exports.tokens(exports.messages(documents)).collect() if name(r) == "gemini"] == [(12, 2)]


@pytest.mark.parametrize("value, users", OTHER_CURSOR)
def test_other_shapes_of_one_tool(spark, tmp_path, value, users):
    (tmp_path / "x.json").write_text(json.dumps(value))
    own = exports.read_documents(spark, str(tmp_path))
    assert own.first()["format"] == "cursor"
    nodes = exports.linear(exports.messages(own)).orderBy("turn").collect()
    assert [r["text"] for r in nodes] == users and [r["parent"] for r in nodes] == [None, *(r["node"] for r in nodes[:-1])]


def test_lines(spark, tmp_path):
    for kind, rows in LINES.items():
        (tmp_path / f"{kind}.jsonl").write_text("\n".join(["", "not json", *map(json.dumps, rows)]))
    lines = exports.read_lines(spark, str(tmp_path))
    assert {name(r): r["format"] for r in lines.collect()} == {"codex": "codex", "gemini": "gemini"}
    rollout = exports.codex(lines)
    assert [(r["session"], r["role"], r["text"], r["model"]) for r in exports.turns(exports.codex_messages(rollout)).orderBy("ord").collect()] == [("s9", "user", "go", "m1"), ("s9", "assistant", "done", "m1")]
    assert [(r["tool"], r["path"], r["command"], r["model"]) for r in exports.codex_actions(rollout).collect()] == [("shell", "p", "ls -l", "m1")]
    assert [(r["input_tokens"], r["output_tokens"]) for r in exports.codex_tokens(rollout).collect()] == [(30, 4)]
    assert [(r["role"], r["text"]) for r in exports.turns(exports.gemini_lines(lines)).orderBy("ord").collect()] == [("user", "one"), ("assistant", "two")]


def test_forced_format(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"messages": [{"role": "user", "content": "a"}]}))
    assert exports.read_documents(spark, str(tmp_path)).first()["format"] is None
    assert [r["text"] for r in exports.turns(exports.messages(exports.read_documents(spark, str(tmp_path), "grok"))).collect()] == ["a"]
    with pytest.raises(ValueError, match="no such format"):
        exports.read_documents(spark, str(tmp_path), "other")


def test_untimed_tree_is_walked_by_last_children(spark, tmp_path):
    said = lambda role, text: {"author": {"role": role}, "content": {"parts": [text]}}
    value = {"mapping": {"r": {"parent": None, "children": ["a"]}, "a": {"parent": "r", "children": ["x", "b"], "message": said("user", "1")}, "x": {"parent": "a", "children": [], "message": said("user", "old")}, "b": {"parent": "a", "children": ["a"], "message": said("assistant", "2")}}}
    (tmp_path / "x.json").write_text(json.dumps(value))
    own = exports.tree_turns(exports.read_documents(spark, str(tmp_path))).orderBy("ord").collect()
    assert [(r["role"], r["text"]) for r in own] == [("user", "1"), ("assistant", "2")]


def test_sessions_are_stitched(spark):
    rows = [
        (1, "b", "2024-02", 0, 1, "b1", None, None), (1, "b", "2024-02", 0, 2, "b2", None, None), (1, "a", "2024-01", 1, 1, "a1", None, True), (1, "a", "2024-01", 1, 2, "a2", "a1", True), (1, "a", "2024-01", 1, 3, "a3", "a1", False),
        (2, "c", None, 0, 1, "c1", None, False),
    ]
    nodes = spark.createDataFrame(rows, "tree long, session string, first_ts string, session_ord int, seq int, node string, parent string, main boolean")
    out = lineage.stitched(nodes)
    assert {r["node"]: (r["parent"], r["boundary"]) for r in out.collect()} == {"a1": (None, True), "a2": ("a1", False), "a3": ("a1", False), "b1": ("a2", True), "b2": ("b1", False), "c1": (None, True)}
    assert {r["node"] for r in lineage.roots(out).collect()} == {"a1", "c1"}
    assert [(r["parent"], r["node"], r["rank"]) for r in lineage.children(out).orderBy("parent", "rank").collect()] == [("a1", "a2", 1), ("a1", "a3", 2), ("a2", "b1", 1), ("b1", "b2", 1)]
