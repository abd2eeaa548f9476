"""Nearest turns with shared evidence, against a plain search of all pairs on random trees."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import security as S
from threadloom.operators import evidence

WORDS = "build parser auth token yes retry client cache index query login.ts perfect the and that works session main.py".split()
FILES = ["src/login.ts", "lib/main.py", "a.c", "docs/auth/index.md", None]


def tree(seed, n=40):
    r = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        text = None if r.random() < 0.05 else " ".join(r.choice(WORDS) for _ in range(r.randrange(6)))
        files = r.choice([None, [], [r.choice(FILES)], [r.choice(FILES), r.choice(FILES)]])
        rows.append((seed, i, text, files, r.choice(["correction", "direction"]), r.choice(["accepted"] * 4 + ["abandoned"]), r.randrange(1, i) if i > 1 and r.random() < 0.8 else None, r.random() < 0.5, r.random() < 0.3))
    return rows


def plain(row):
    text, files = (row[2] or "").lower(), {f for f in row[3] or [] if f}
    words = set(re.findall(r"[a-z][a-z0-9_-]{2,}", " ".join([text, *(re.sub(r"[\\/.+_-]+", " ", f) for f in files)]).lower())) - set(evidence.STOP_WORDS)
    bases = {b for f in files if len(b := re.split(r"[\\/]", f)[-1].lower()) >= 4}
    return text, files, bases, words


def concrete(a, b):
    (ta, fa, ba, wa), (tb, fb, bb, wb) = plain(a), plain(b)
    return bool(fa & fb) or any(x in tb for x in ba) or any(x in ta for x in bb) or bool(wa & wb & set(evidence.SURFACE_WORDS))


def shares(a, b):
    return concrete(a, b) or len(plain(a)[3] & plain(b)[3]) >= 3


@pytest.fixture(scope="module")
def trees(spark):
    rows = [row for seed in range(1, 5) for row in tree(seed)]
    columns = "tree long, ord long, text string, files array<string>, kind string, status string, parent long, failing boolean, declined boolean"
    return rows, spark.createDataFrame(rows, columns).cache()


def by_tree(rows):
    return {t: [r for r in rows if r[0] == t] for t in {r[0] for r in rows}}


def test_corrections_after(trees):
    rows, nodes = trees
    expected = {(t, a[1]): next((b[1] for b in own if b[1] > a[1] and b[5] != "abandoned" and b[4] == "correction" and shares(a, b)), None) for t, own in by_tree(rows).items() for a in own}
    assert {(r["tree"], r["ord"]): r["corrector"] for r in evidence.correction_after(nodes).collect()} == expected


def test_failure_targets(trees):
    rows, nodes = trees
    expected = {}
    for t, own in by_tree(rows).items():
        status = {r[1]: r[5] for r in own}
        for a in own:
            before = [b for b in reversed(own) if b[1] < a[1] and b[5] != "abandoned"]
            found = next((b[1] for b in before if shares(a, b)), None)
            parent = a[6] if a[6] and status[a[6]] != "abandoned" else None
            rest = parent if parent is not None else before[0][1] if before else None
            expected[t, a[1]] = (found, "semantic") if found is not None else (rest, "positional" if rest is not None else None)
    assert {(r["tree"], r["ord"]): (r["target"], r["linkage"]) for r in evidence.failure_target(nodes).collect()} == expected


def test_accepted_after(trees):
    rows, nodes = trees
    r = random.Random(5)
    asked = [(t, a[1], a[1], a[1] + r.randrange(1, 5) if r.random() < 0.5 and a[1] < 35 else None) for t, own in by_tree(rows).items() for a in own]
    expected = {}
    for t, _, o, corrector in asked:
        own = by_tree(rows)[t]
        later = [b for b in own if b[1] > (corrector or o) and b[5] != "abandoned"]
        me = own[o - 1]
        semantic = next((b[1] for b in later if shares(me, b)), None)
        said = next((b[1] for b in later if re.search(evidence.ACCEPTANCE, b[2] or "", re.I)), None)
        expected[t, o] = semantic if semantic is not None else said
    failures = nodes.sparkSession.createDataFrame(asked, "tree long, id long, ord long, corrector long")
    assert {(x["tree"], x["id"]): x["accepted"] for x in evidence.accepted_after(nodes, failures).collect()} == expected


def test_forward_chains(trees):
    rows, nodes = trees
    expected = set()
    for t, own in by_tree(rows).items():
        live = [r for r in own if r[5] != "abandoned"]
        for i, a in enumerate(live):
            if a[7]:
                for b in live[i + 1 : i + 7]:
                    accepting = b[4] != "correction" and re.search(evidence.ACCEPTANCE, b[2] or "", re.I)
                    if not accepting and (b[4] == "correction" or b[8]) and concrete(a, b):
                        expected.add((t, a[1], b[1]))
                        break
    assert {tuple(r) for r in evidence.forward_chains(nodes).collect()} == expected


def test_backward_chains(spark):
    parts = "no, undo login.ts|you dropped the tables|restore the seed data|main.py|mask it|perfect|broke my brain|broken, bring it back|added the migration|the table|make it additive|wiped rows|preserve records|go on".split("|")
    r = random.Random(11)
    rows = []
    for t in range(1, 5):
        for i in range(1, 61):
            files = r.choice([None, [], ["src/login.ts"], ["lib/main.py"], ["a.c"]])
            text = r.choice([None, " ".join(r.choice(parts) for _ in range(r.randrange(4))), *(["x" * 1201 + " undo login.ts"] if i % 20 == 0 else [])])
            rows.append((t, i, text, files, r.choice(["correction", "direction", "direction"]), r.choice(["accepted"] * 5 + ["abandoned"]), r.random() < 0.2, r.choice([None, "dropped the tables", "seeds and rows"])))
    nodes = spark.createDataFrame(rows, "tree long, ord long, text string, files array<string>, kind string, status string, declined boolean, narration string")
    has = lambda text, pattern: re.search(pattern, text or "", re.I | re.A) is not None
    bases = lambda row: {b for f in row[3] or [] if len(b := f.split("/")[-1].lower()) >= 4}

    def data(text):
        found = (m.lower() for m in re.findall(evidence.DATA, text or "", re.I | re.A))
        return {"seed" if d.startswith("seed") else "migration" if d.startswith("migration") else re.sub("s$", "", d) for d in found}

    expected = set()
    for t in range(1, 5):
        live = [x for x in rows if x[0] == t and x[5] != "abandoned"]
        for i, b in enumerate(live):
            text = b[2] or ""
            meant = not has(text, S.FIGURATIVE) and not has(text, S.NOT_THE_AGENT)
            wants_data = meant and data(text) and has(text, evidence.DATA_LOST) and has(text, evidence.DATA_BACK)
            redirect = (b[4] == "correction" or b[6]) and not (b[4] != "correction" and has(text, evidence.ACCEPTANCE))
            if len(text) > 1200 or not (redirect or b[6] or (meant and has(text, S.DESTRUCTIVE) and has(text, S.RECOVERY)) or wants_data):
                continue
            for a in reversed(live[max(0, i - 10) : i]):
                acted = bool(a[3])
                tie = bool(set(a[3] or []) & set(b[3] or [])) or any(x in text.lower() for x in bases(a)) or any(x in (a[2] or "").lower() for x in bases(b))
                if (tie and (has(text, evidence.REMEDY) or acted)) or (acted and wants_data and data(text) & data(f"{a[2] or ''} {a[7] or ''}")):
                    expected.add((t, a[1], b[1]))
                    break
    assert len(expected) > 30
    assert {tuple(x) for x in evidence.backward_chains(nodes).collect()} == expected
    assert evidence.backward_chains(nodes.limit(0)).count() == 0


def test_chains_are_unique(spark):
    rows = [(1, 1, 2, 0, 5, "a"), (1, 1, 2, 1, 1, "b"), (1, 1, 3, 1, 2, "c"), (2, 1, 2, 1, 1, "d")]
    out = evidence.unique_chains(spark.createDataFrame(rows, "tree long, failure long, correction long, pass int, seq int, what string"))
    assert {(r["tree"], r["chain_id"], r["what"]) for r in out.collect()} == {(1, "chain_001", "a"), (1, "chain_002", "c"), (2, "chain_001", "d")}


def test_common_words_of_a_long_tree_are_found_next_door(spark):
    """One vocabulary in 4,000 turns: each finds the next; one whose words come back only at the end finds that."""
    rows = [(1, i, "alpha beta gamma delta" if i not in (5, 3990) else "omega sigma kappa", [], "correction", "accepted") for i in range(4000)]
    nodes = spark.createDataFrame(rows, "tree int, ord long, text string, files array<string>, kind string, status string")
    found = {r["ord"]: r["corrector"] for r in evidence.correction_after(nodes).collect()}
    assert found[5] == 3990 and found[4] == 6 and found[10] == 11 and found[3990] is None and found[3999] is None
    assert all(found[i] == i + 1 for i in range(6, 3989))


def test_names_anywhere_in_a_text(spark):
    rows = [(1, 1, "see src/Login.ts!", ["a/b.ts"]), (1, 2, "nothing", ["src/login.ts", "x/makefile"]), (1, 3, "themakefileisbroken", []), (2, 1, "login.ts", []), (1, 4, None, None)]
    own = evidence.with_words(spark.createDataFrame(rows, "tree int, ord int, text string, files array<string>"))
    assert {tuple(r) for r in evidence.naming(own).collect()} == {(1, 1, "login.ts"), (1, 3, "makefile")}


def sent_whole(df):
    """Whether a plan sends a table to all tasks by way of the driver."""
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_small_files_with_many_words_are_dealt(trees, spark, tmp_path):
    # the planner takes a small file's words and names for small too
    trees[1].write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    assert not sent_whole(evidence.naming(evidence.with_words(nodes)))
    assert not sent_whole(evidence.correction_after(nodes))


def test_what_is_next_door_costs_no_rounds(trees, monkeypatch):
    """Trees no longer than the turns that are looked through one by one need no search by words and keys."""
    def never(*args, **kwargs):
        raise AssertionError("searched whole trees")

    monkeypatch.setattr(evidence, "nearest", never)
    own = evidence.looked_up(trees[1], tuple(evidence.LOOKED_FOR), listed=True)
    assert own.count() == len(trees[0]) and own.filter("on or back").count() == 0
    asked = trees[1].select("tree", F.col("ord").alias("id"), "ord", F.lit(None).cast("long").alias("corrector"))
    assert evidence.accepted_after(trees[1], asked, own).count() == len(trees[0])


def test_what_is_further_away_is_found_too(trees, monkeypatch):
    monkeypatch.setattr(evidence, "NEXT_DOOR", 3)
    monkeypatch.setattr(evidence, "AT_A_TIME", (1, 2))
    rows, nodes = trees
    wanted = {"correction": lambda b: b[4] == "correction", "secured": lambda b: False, "later": lambda b: True, "earlier": lambda b: True}
    expected = {}
    for t, own in by_tree(rows).items():
        for a in own:
            for name, fit in wanted.items():
                side = [b for b in reversed(own) if b[1] < a[1]] if name == "earlier" else [b for b in own if b[1] > a[1]]
                expected[t, a[1], name] = next((b[1] for b in side if b[5] != "abandoned" and fit(b) and shares(a, b)), None)
    found = evidence.looked_up(nodes, tuple(wanted))
    assert {(x["tree"], x["ord"], name): x[name] for x in found.collect() for name in wanted} == expected
    test_accepted_after(trees)
