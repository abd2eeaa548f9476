"""One table of cases for each predicate, hits beside near misses."""

import pytest
from pyspark.sql import functions as F

from threadloom.functions import security as S
from threadloom.functions import text as T

CASES = {
    "credential_file": (lambda C: S.is_credential_file(C), {"src/auth/login.ts": True, ".env.local": True, "src/design-tokens.json": False, "lib/tokenizer.py": False, "main.c": False, None: False}),
    "secret_content": (lambda C: S.has_secret_content(C), {"source a/.env": True, "export MY_API_KEY": True, "gh auth login": True, 'password = "abcdefg"': True, "password = abc": False, "resource .environment": False, None: False}),
    "access": (lambda C: S.access_content(C), {"GRANT ALL on t": "strong", "chmod 755 x": "strong", "the rbac module": "weak", "granted": None, None: None}),
    "public": (lambda C: S.public_exposure(C), {"cidr 0.0.0.0/0": "network", "acl: public": "acl", "chmod 644 a": "mode", "chmod 640 a": None, "GRANT SELECT ON t TO PUBLIC": "grant", "publicity": None, None: None}),
    "gate": (lambda C: S.weakens_gate(C), {"verify=False": True, "httpOnly: false": True, "// require_auth": True, "verify=True": False, "insecure falsehood": False, None: False}),
    "correction": (lambda C: S.is_security_correction(C), {"never commit the api key": True, "rotate that token": True, "lock it down": True, "commit the docs": False, "x" * 4001 + " lock it down": False, None: False}),
    "redirect": (lambda C: S.redirects_tool(C), {"use the Edit tool instead": True, "switch to the Read tool": True, "use the flag --x": False, None: False}),
    "bad_path": (lambda C: S.bad_path(C)["tier"], {"you deleted it, restore it": "verified", "it is broken": "high", "undo that": None, "sorry, undo that": "high", "that broke my brain": None, "broken, but pre-existing": None, None: None}),
    "intent": (lambda C: T.security_intent(C), {"rotate the api key": "credential_lifecycle", "change the email a@b": "email_change", "change the email": None, "skip these tests": "disable_tests", "relicense it": "relicensing", "the tests pass": None, None: None}),
    "accented": (lambda C: T.turn_kind(C, F.lit(False)), {"éno, stopé": "direction", "no, stop": "correction"}),
}


@pytest.mark.parametrize("name", CASES)
def test_predicate(spark, name):
    of, cases = CASES[name]
    expression = of(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", expression.alias("x")).collect()
    assert {r["t"]: r["x"] for r in rows} == cases


SIGNALS = {
    "you forgot the flag": [("ignored_constraint", 0.84)], "wrong library, it doesn't exist": [("hallucinated_file_or_api", 0.82), ("wrong_tool_choice", 0.78)], "this is too much": [("scope_drift", 0.82), ("overbuilt_solution", 0.78)],
    "a CSV export": [], "that's not what i asked": [("misunderstood_goal", 0.62)], "x " * 700 + "you forgot": [], "rip the registry out, way too heavy": [("scope_drift", 0.82)],
}


def test_process_signals(spark):
    rows = spark.createDataFrame([(t, "correction" if t.startswith("that's") else "direction") for t in SIGNALS], "t string, kind string")
    found = rows.select("t", T.process_signals(F.col("t"), F.col("kind"), F.array(F.lit("registry"))).alias("s")).collect()
    assert {r["t"]: [(s["type"], s["confidence"]) for s in r["s"]] for r in found} == SIGNALS
    # what a turn names as surplus counts only if the turn before brought it in, and gives no lesson
    one = spark.createDataFrame([("gold-plated: remove the daemon",)], "t string")
    assert [tuple(s) for s in one.select(T.process_signals(F.col("t"), F.lit("x"), F.array(F.lit("daemon"))).alias("s")).first()["s"]] == [("scope_drift", 0.8, False)]
    assert one.select(T.process_signals(F.col("t"), F.lit("x"), F.array(F.lit("panel"))).alias("s")).first()["s"] == []


def test_summaries_and_hints(spark):
    row = spark.createDataFrame([("fix src/a.ts now", None, "title", "cut it")], "t string, files array<string>, a string, b string")
    assert row.select(S.file_hint(F.col("t"), F.col("files")).alias("x")).first()["x"] == "src/a.ts"
    assert row.select(S.bad_path_summary(S.file_hint(F.col("t"), F.col("files")), F.lit(True)).alias("x")).first()["x"] == "`src/a.ts` was deleted or damaged and had to be recovered; guard against destructive file operations."
    assert row.select(T.failure_summary(F.lit("scope_drift"), F.col("a"), F.col("b"), F.lit('say "x"')).alias("x")).first()["x"] == 'The session drifted from the intended scope near "title"; corrected by: "say \\"x\\"".'
    assert row.select(T.lesson_text(F.lit("scope_drift"), F.lit("e  v"), F.lit("")).alias("x")).first()["x"].endswith("product shape. Specifically: e v")
