"""Whole analyses of small trees, from turns to lessons."""

from threadloom.plans import analysis

NODE = "tree string, ord long, text string, kind string, status string, files array<string>, parent long, narration string, type string"
REJECTION = "tree string, ord long, kind string, confidence double"
ACTION = "tree string, ord long, seq int, file string, command string, input string, narration string"


def analysed(spark, nodes, rejections=(), actions=()):
    n = spark.createDataFrame([(*x, "clash") for x in nodes], NODE).drop("type")
    r, a = spark.createDataFrame(list(rejections), REJECTION), spark.createDataFrame(list(actions), ACTION)
    return n, r, analysis.emissions(n, r, a)


def test_one_tree(spark):
    nodes = [
        ("a", 1, "Build the parser for the log files.", "root", "accepted", ["src/parse.py"], None, None),
        ("a", 2, "No, that is wrong, you forgot src/parse.py tests. Still failing, the same error again.", "correction", "accepted", [], 1, None),
        ("a", 3, "looks good", "direction", "accepted", [], 2, None),
        ("a", 4, "Try a side road", "direction", "abandoned", [], 3, None),
        ("a", 5, "Store the settings.", "direction", "accepted", ["src/auth/login.ts"], 3, None),
        ("a", 6, "You deleted src/auth/login.ts, restore it.", "correction", "accepted", [], 5, None),
        ("a", 7, None, "direction", "accepted", None, 6, None),
        ("b", 1, "What is left to do?", "root", "accepted", [], None, None),
    ]
    rejections = [("a", 3, "permission_denied", 0.85), ("a", 3, "permission_denied", 0.85), ("a", 7, "strange", 0.5)]
    actions = [("a", 5, 0, "src/auth/login.ts", None, "token = Ab9-xyzzy-77", None)]
    n, r, found = analysed(spark, nodes, rejections, actions)
    got = {(x["type"], x["node"]): x for x in analysis.failures(found).collect()}
    assert {x["tree"] for x in got.values()} == {"a"}
    fixed = got["repeated_failed_fix", 1]
    assert (fixed["corrector"], fixed["tier"], fixed["resolved"]) == (2, "confirmed", 3)
    assert (got["permission_denied", 3]["tier"], got["permission_denied", 3]["confidence"], got["permission_denied", 3]["resolved"]) == ("high", 0.85, None)
    assert (got["abandoned_path", 4]["tier"], got["abandoned_path", 4]["confidence"]) == ("verified", 0.9)
    assert (got["security_or_privacy_risk", 5]["tier"], got["security_or_privacy_risk", 5]["corrector"]) == ("verified", 6)
    assert got["abandoned_path", 6]["summary"] == "`src/auth/login.ts` was deleted or damaged and had to be recovered; guard against destructive file operations."
    pairs = [(x["failure"], x["correction"]) for x in analysis.chains(found, n, r).collect()]
    assert len(pairs) == len(set(pairs)) and {(1, 2), (5, 6)} <= set(pairs)
    types = {x["type"]: x for x in analysis.lessons(found, n).collect()}
    assert types.keys() == {t for t, _ in got} and types["abandoned_path"]["ids"] == ["node_004", "node_006"]
    assert {x["tree"] for x in analysis.evaluations(found, n).collect()} == {"a"}


def test_backstop_and_refusals(spark):
    nodes = [
        ("a", 1, "Write the notes.", "root", "accepted", [], None, None), ("a", 2, "don't commit that password", "direction", "accepted", [], 1, None), ("a", 3, "never hardcode the password here", "direction", "accepted", [], 2, None),
        ("r", 1, "Write it.", "root", "accepted", [], None, None), ("r", 2, "No, that is wrong, you forgot it again.", "correction", "accepted", [], 1, None),
        ("s", 1, "Write it.", "root", "accepted", [], None, None), ("s", 2, "wtf this sucks", "direction", "accepted", [], 1, None),
    ]
    _, _, found = analysed(spark, nodes, [("r", 1, "model_refusal", 0.9)])
    got = {(x["tree"], x["type"], x["node"]): x for x in analysis.failures(found).collect()}
    held = got["a", "security_or_privacy_risk", 1]
    assert (held["confidence"], held["tier"], held["corrector"]) == (0.62, "inferred", 2)
    assert [k for k in got if k[0] == "a" and k[1] == "security_or_privacy_risk"] == [("a", "security_or_privacy_risk", 1)]
    # a turn after a refusal is no failure but the refusal itself
    assert [k for k in got if k[0] == "r"] == [("r", "model_refused", 1)]
    assert (got["s", "user_frustration", 1]["tier"], got["s", "user_frustration", 1]["confidence"]) == ("inferred", 0.62)


def test_nothing(spark):
    n, r, found = analysed(spark, [])
    assert found.count() == 0 and analysis.failures(found).count() == 0 and analysis.lessons(found, n).count() == 0


def test_refusals_of_small_files_are_dealt(spark, tmp_path):
    spark.createDataFrame([(1, 1, None), (1, 2, 1)], "tree long, ord long, parent long").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([(1, 1, "model_refusal", 0.9)], "tree long, ord long, kind string, confidence double").write.parquet(str(tmp_path / "rejections"))
    own = analysis.refused(spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "rejections")))
    assert "BroadcastExchange" not in own._jdf.queryExecution().executedPlan().toString()
    assert {(r["ord"], r["own_refusal"], r["refusal"]) for r in own.collect()} == {(1, True, True), (2, False, True)}
