"""A project's session files and manifests, and what its turns import or name without its being there."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import references
from threadloom.sources import project, transcripts


@pytest.fixture(scope="module")
def manifests(tmp_path_factory):
    path = tmp_path_factory.mktemp("project")
    (path / "package.json").write_text(json.dumps({"dependencies": {"react": "1", "@scope/kit": "2"}, "devDependencies": {"jest": "3"}, "scripts": {"build": "x"}}, indent=1))
    (path / "package-lock.json").write_text(json.dumps({"packages": {"": {}, "node_modules/a": {}, "node_modules/a/node_modules/@s/b": {}}, "dependencies": {"c": {}}}))
    (path / "requirements.txt").write_text("NumPy==1.0\nplain\n  flask >= 2\n# no = 1\n")
    (path / "other.txt").write_text("hidden==1")
    return str(path)


def test_declared(spark, manifests, tmp_path):
    found = {tuple(r) for r in project.declared(spark, manifests).collect()}
    assert found == {("package", "react"), ("package", "@scope/kit"), ("package", "jest"), ("lock", "a"), ("lock", "@s/b"), ("lock", "c"), ("python", "numpy"), ("python", "flask")}
    (tmp_path / "package.json").write_text("{broken")
    assert project.declared(spark, str(tmp_path)).count() == 0


def test_session_files(spark, tmp_path):
    for i, (folder, name) in enumerate([("-home-me-a-b", "2.jsonl"), ("-home-me-a-b-more", "1.jsonl"), ("-home-me-x", "3.jsonl"), ("-home-me-a-b", "4.txt")]):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x" * (i + 1))
        os.utime(tmp_path / folder / name, (1000 - i, 1000 - i))
    found = project.session_files(spark, str(tmp_path), "/home/me/a.b").collect()
    assert [(r["path"].split("/")[-1], r["bytes"]) for r in found] == [("1.jsonl", 2), ("2.jsonl", 1)]
    assert spark.range(1).select(project.folder_name(F.lit("/home/me/a.b"))).first()[0] == "-home-me-a-b"


def test_of_project(spark, tmp_path):
    for name, folders in {"own": [None, "/p", "/q"], "other": ["/q", "/p"], "silent": [None]}.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(json.dumps({"type": "user", "cwd": c} if c else {"type": "user"}) for c in folders))
    found = project.of_project(transcripts.records(spark, str(tmp_path)), "/p")
    assert {r["file"].split("/")[-1] for r in found.select("file").collect()} == {"own.jsonl", "silent.jsonl"}


TURNS = [
    (1, 1, "import x from 'react'\nimport y from \"left-pad/lib\"\nexport * from './own'\nconst f = require('node:fs'), g = require('fs')"), (1, 2, "from numpy import a\nimport os, pandas\n  import re"), (1, 3, "await import('@scope/kit/deep'); reimport('no')"), (1, 4, None), (2, 5, "import a.b"),
]


def test_imports(spark, manifests):
    turns = spark.createDataFrame(TURNS, "tree long, ord long, text string")
    found = references.imports_by_language(turns)
    assert {tuple(r) for r in found.collect()} == {
        (1, "js", "react", 1), (1, "js", "left-pad", 1), (1, "js", "fs", 1), (1, "js", "@scope/kit", 3), (1, "py", "numpy", 2), (1, "py", "os", 2), (1, "py", "pandas", 2), (1, "py", "re", 2), (2, "py", "a.b", 5), (1, "py", "x", 1), (1, "py", "y", 1),
    }
    declared = project.declared(spark, manifests).cache()
    assert {(r["lang"], r["package"]) for r in references.undeclared_imports(found, declared).collect()} == {("js", "left-pad"), ("py", "pandas"), ("py", "a.b"), ("py", "x"), ("py", "y")}
    # without a Python manifest no Python name is judged, without any manifest none at all
    assert {(r["lang"], r["package"]) for r in references.undeclared_imports(found, declared.filter("kind <> 'python'")).collect()} == {("js", "left-pad")}
    assert references.undeclared_imports(found, declared.limit(0)).count() == 0


def test_libraries(spark, manifests):
    refs = spark.createDataFrame([(1, r, 1) for r in ("react.js", "src/react.js", "lodash.js", "numpy.py", ".env", "a.b.js", "noext")], "tree long, ref string, first_ord long")
    declared = project.declared(spark, manifests).cache()
    assert {r["ref"] for r in references.without_libraries(refs, declared).collect()} == {"src/react.js", "lodash.js", ".env", "a.b.js", "noext"}
    assert {r["ref"] for r in references.without_libraries(refs, declared.limit(0)).collect()} == {"src/react.js", ".env", "a.b.js", "noext"}


def test_rejection_texts(spark):
    row = spark.range(1).select(
        T.rejection_summary(F.lit("model_refusal"), F.lit("build  it")), T.rejection_summary(F.lit("odd"), F.lit("")), T.rejection_summary(F.lit(None).cast("string"), F.lit(None).cast("string")), T.rejection_title(F.array(F.lit("model_refusal"), F.lit("model_refusal"))),
        T.rejection_title(F.array(F.lit("a"), F.lit("b"))), T.rejection_title(F.lit(None).cast("array<string>")), T.remedies(F.lit("Rotate it, then revoke; from env")), T.remedies(F.lit("leave it")), T.remedies(F.lit(None).cast("string")),
    ).first()
    assert tuple(row) == (
        'The model refused to proceed near "build it".', 'A odd was captured near "a previous turn".', 'A rejection was captured near "a previous turn".', "Agent action rejected (model refusal)", "Agent action rejected (2 kinds)", "[agent action rejected]",
        "revoke the exposed credential; rotate the exposed credential; read it from an environment variable outside the tree.", "", "",
    )
