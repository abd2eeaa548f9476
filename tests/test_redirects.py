"""Structural declines and redirects: cases, and a plain version on random turns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import patterns as P
from threadloom.functions import redirects as R

PRIOR = ["registry", "login.ts", "login", "plugin", "with", "parser"]
GOAL = ["latency", "over-the-air", "firmware"]


def has(text, pattern):
    return re.search(pattern, text, re.I | re.A) is not None


def core(text):
    return re.sub(P.INTERJECTION, "", (text or "").strip(), flags=re.I | re.A).strip()


def back(text):
    return has(text, R.DEMONSTRATIVE) or any(t in text.lower() for t in PRIOR)


def named(text, tokens, but=()):
    return any(re.search(rf"\b{re.escape(t)}\b", text.lower(), re.A) for t in tokens if len(t) >= 4 and t not in but)


def declines(text):
    c = core(text)
    if not (text or "").strip() or len(text.strip()) > 240 or has(c, P.BENIGN_DECLINE):
        return False
    for clause in (x.strip() for x in re.split(r"[.!?;\n]", c)):
        m = re.search(R.REVERSAL_VERB, clause, re.I | re.A)
        if m:
            at = clause.lower().index(m[0].lower())
            lead = re.sub(r"[,\s]+$", "", clause[:at])
            if (not lead or has(lead, R.LEAD_IN)) and (has(clause, R.BARE_STOP) or back(clause[at:])):
                return True
    return has(c, R.DAMAGE_BY_AGENT) and has(c, R.OTHER_WAY) and back(c)


def redirects(text):
    c = core(text)
    if not (text or "").strip() or len(text.strip()) > 600 or any(has(c, p) for p in (P.BENIGN_DECLINE, R.PERMISSIVE, R.SCOPE_AFFIRMED)):
        return False
    return has(c, R.YOU_WRONG) or (any(has(c, p) for p in (R.NEGATED, R.WRONG_THING, R.TAKE_OUT)) and named(c, PRIOR, R.COMMON))


def takes_out(text):
    c = core(text)
    fits = (text or "").strip() and len(text.strip()) <= 600
    return bool(fits) and not has(c, P.BENIGN_DECLINE) and not has(c, R.PERMISSIVE) and has(c, R.TAKE_OUT) and named(c, PRIOR, R.COMMON)


def returns(text):
    return bool((text or "").strip()) and len(text.strip()) <= 600 and has(text, R.GOAL_FRAME) and named(text, GOAL)


PARTS = [
    "stop", "rip the registry out", "revert it", "kill the process", "you usually stop the server", "ok, scrap that", "you solved the wrong problem", "i wanted a parser, not a plugin", "feel free to", "i just want it small",
    "the whole point is latency", "that's not what i asked", "over-the-air", "you wiped the login table", "make it additive", "never drop", "No problem", "whoa,", "nix the plugins", "wrong direction", "the parser", "Éregistry", "registryé",
    "unstoppable, stop", "back that out", "roll back login.ts", "with", "not this but the other", "what i really wanted", "firmware",
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    made = [r.choice([" ", ". ", "; ", "\n", ", "]).join(r.choice(PARTS) for _ in range(r.randrange(1, 5))) for _ in range(700)]
    return sorted(set(made) | {"", " \n", "stop" + " " * 300, "rip it out " * 30, "x" * 700 + " revert login"})


def test_against_plain_version(spark, texts):
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").withColumns({"prior": F.array(*map(F.lit, PRIOR)), "goal": F.array(*map(F.lit, GOAL))})
    t, prior = F.col("t"), F.col("prior")
    found = rows.select("t", R.declines_action(t, prior), R.redirects_action(t, prior), R.takes_out(t, prior), R.returns_to_goal(t, F.col("goal")), R.routed(t, prior, F.col("goal"))).collect()
    assert {r[0]: tuple(r[1:5]) for r in found} == {x: (declines(x), redirects(x), takes_out(x), returns(x)) for x in [*texts, None]}
    assert all(r[5]["redirects"] == (r[1] or r[2] or r[4]) for r in found)
    assert sum(r[1] for r in found) > 50 and sum(r[2] for r in found) > 50 and sum(r[3] for r in found) > 20 and sum(r[4] for r in found) > 5


def test_without_context(spark):
    none = F.lit(None).cast("array<string>")
    row = spark.createDataFrame([("rip out registry",)], "t string")
    assert tuple(row.select(R.declines_action(F.col("t"), none), R.redirects_action(F.col("t"), none), R.takes_out(F.col("t"), none), R.returns_to_goal(F.col("t"), none)).first()) == (False, False, False, False)


def test_tokens(spark):
    row = spark.createDataFrame([(["src/Auth/login.ts", None, "a.c"], "I added the Parser_v2 now", "Please build over-the-air updates for the fleet")], "f array<string>, n string, g string")
    out = row.select(R.action_tokens(F.col("f"), F.col("n")), R.goal_tokens(F.col("g")), R.action_tokens(F.lit(None).cast("array<string>"), F.lit(None)), R.goal_tokens(F.lit(None))).first()
    assert set(out[0]) == {"login.ts", "auth", "login", "added", "parser_v2"}
    assert set(out[1]) == {"over-the-air", "fleet"}
    assert out[2] == [] and out[3] == []


def test_refusals_in_free_words(spark):
    cases = {"I'd rather not do that": True, "I’m going to decline": True, "I can't help with that": True, "I won't touch the schema": False, "I would do it": False, "x" * 4001 + " I'll decline": False, "": False}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", R.is_structural_refusal(F.col("t")))
    assert {r[0]: r[1] for r in rows.collect()} == cases
