"""Security concerns of a tree: what each turn's actions touch, how sure that is, and one concern for all turns about one thing.

actions has tree, ord (the turn), seq (unique in the turn), file, command, input and narration; nodes has tree, ord (unique in
the tree), text, kind, status, files (an array) and, where known, narration. A turn's actions are gathered in one row, so a turn
should have thousands of them at most.

Defined results: nulls are empty; a turn without actions, or whose actions touch nothing, is no concern; equal actions count once
for what they show; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import security as S
from ..functions import text as T
from ..shared import cut, dealt, spread
from .evidence import looked_up
from .failures import tier_rank

# Kinds of what is touched with what they are called as signals, kinds that show content, the scale of confidence.
SIGNALS = (
    ("credential", True, "strong credential content"), ("credential-mishandling", True, "credential mishandling"), ("file", True, "credential filename"),
    ("access-control", True, "access-control command"), ("risky-command", False, "risky command"), ("safety-gate-weakening", False, "safety-gate weakening"), ("access-control", False, "access-control keyword"),
)
CONTENT = ("credential", "credential-mishandling", "access-control", "safety-gate-weakening")
NAME_ONLY = ("file", "risky-command")
SCALE = (("verified", 0.95, 0.95), ("high", 0.84, 0.9), ("inferred", 0.62, 0.7))
EACH_MORE = 0.02
#: What an action is told by, and the fields of what it touches, after its place.
VALUES = ("file", "command", "input", "narration")
TOUCH = ("rank", "kind", "strong", "weak", "evidence", "file", "said", "key")
#: Later turns that may name a remedy.
REACH = 12

C = F.col


def _touched() -> Column:
    """What an action of some values touches, in order: structs of late (0 before all others) and of TOUCH; of the columns that touching() makes."""
    body, clause, opened = C("_body"), C("_clause"), C("_opened")
    found = (
        ("credential-mishandling", clause.isNotNull(), True, False),
        ("credential", S.has_secret_content(body) | S.is_secret_value(body) | S.is_config_secret(body, C("file")), True, False),
        ("file", S.is_credential_file(C("file")), True, False),
        ("access-control", opened, True, False),
        ("risky-command", T.risky_command(C("command")).isNotNull(), False, False),
        ("access-control", ~opened & T.matches(body, S.ACCESS_WEAK), False, True),
        ("safety-gate-weakening", S.weakens_gate(body), False, True),
    )
    shown = F.coalesce(*(F.nullif(C(c), F.lit("")) for c in ("file", "command", "input")), F.lit(""))
    key = F.when(S.is_credential_file(C("file")) | C("_s").isNotNull(), file_key(C("file")))
    rows = []
    for i, (kind, met, strong, weak) in enumerate(found):
        evidence = F.coalesce(F.nullif(clause, F.lit("")), shown) if i == 0 else shown
        said = F.concat_ws(" ", clause, body) if i == 0 else body
        row = F.struct(F.lit(min(i, 1)).alias("late"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), F.lit(strong).alias("strong"), F.lit(weak).alias("weak"), evidence.alias("evidence"), F.nullif(C("file"), F.lit("")).alias("file"), said.alias("said"), key.alias("key"))
        rows.append(F.when(met, row))
    return F.array_compact(F.array(*rows))


def file_key(file: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(file), F.lit("\\"), F.lit("/")), "/+", "/")


def touching(actions: DataFrame) -> DataFrame:
    """tree, ord, acts (what the turn's actions touch, in order), surface (of its first file that has one), key and stem, for turns that touch something.

    The key is the first file that is a credential's or lies on a surface, of strong acts if there is one; the stem is the
    credential that a turn without such a file speaks of. Only a turn's first mishandled credential counts.
    """
    # an action is told by its values, and many have the same ones: these are looked into once, dealt to all tasks
    values = [F.coalesce(C(c), F.lit("")).alias(c) for c in VALUES]
    each = actions.select("tree", "ord", "seq", *values)
    own = spread(each.select(*VALUES).distinct())
    # each value that is used again is a column
    own = own.withColumn("_body", F.concat_ws(" ", "command", "input"))
    clause = S.mishandled_credential(F.concat_ws(" ", "narration", "_body"))
    own = own.withColumns({"_s": T.security_surface(C("file")), "_clause": clause, "_opened": S.public_exposure(C("_body")).isNotNull() | T.matches(C("_body"), S.ACCESS_CONTENT)})
    own = own.select(*VALUES, _touched().alias("_v"), "_s")
    own = dealt(each, own, list(VALUES)).select("tree", "ord", "seq", F.transform("_v", lambda v: F.struct(v["late"].alias("late"), C("seq").alias("seq"), *(v[c].alias(c) for c in TOUCH))).alias("_a"), "_s")
    turn = own.groupBy("tree", "ord").agg(F.sort_array(F.flatten(F.collect_list("_a"))).alias("_a"), F.min_by("_s", F.when(C("_s").isNotNull(), C("seq"))).alias("surface"))
    turn = turn.filter(F.size("_a") > 0).withColumn("acts", F.filter("_a", lambda a, i: (i == 0) | (a["kind"] != "credential-mishandling")))
    files = F.filter("acts", lambda a: a["key"].isNotNull())
    first = F.coalesce(F.try_element_at(F.filter(files, lambda a: a["strong"]), F.lit(1)), F.try_element_at(files, F.lit(1)))
    turn = turn.withColumn("key", first["key"])
    stem = T.first_match(F.array_join(F.transform("acts", lambda a: a["said"]), " "), S.STEMS)
    return turn.select("tree", "ord", "acts", "surface", "key", F.when(C("key").isNull(), stem).alias("stem"))


def scored(touched: DataFrame) -> DataFrame:
    """touched, which has human (whether a later turn of a person corrects it), with signals (an array), tier and confidence."""
    has = lambda kind, strong: F.exists("acts", lambda a: (a["kind"] == kind) & (a["strong"] == strong))
    named = [F.when(has(k, strong), name) for k, strong, name in SIGNALS]
    named += [F.when(C("surface").isNotNull(), F.concat(F.lit("security surface ("), C("surface"), F.lit(")"))), F.when(C("human"), "human security correction")]
    out = touched.withColumn("signals", F.array_compact(F.array(*named)))
    strong, weak = F.exists("acts", lambda a: a["strong"]), F.exists("acts", lambda a: a["weak"])
    alone = C("surface").isNull() & ~C("human") & ~has("risky-command", False)
    out = out.withColumn("tier", F.when(strong, "verified").when(weak & alone, "inferred").otherwise("high"))
    more = F.greatest(F.lit(0), F.size("signals") - 1) * EACH_MORE
    by_tier = F.lit(None).cast("double")
    for tier, base, most in SCALE:
        by_tier = F.when(C("tier") == tier, F.least(F.lit(most), F.round(F.lit(base) + more, 2))).otherwise(by_tier)
    return out.withColumn("confidence", by_tier)


def let_through(turns: DataFrame) -> DataFrame:
    """The turns of a tree that count, of turns with tree, ord, acts (null where nothing is touched) and secures (whether a person corrects something about security).

    One that shows but a name or a risky command counts only if it is the first such, or if no content and no correction by a
    person came before it.
    """
    before = Window.partitionBy("tree").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda flag: F.coalesce(F.max(flag).over(before), F.lit(False))
    acts = F.coalesce("acts", F.filter("acts", lambda a: F.lit(False)))
    named = C("acts").isNotNull() & F.forall(acts, lambda a: a["kind"].isin(*NAME_ONLY))
    content = F.coalesce(F.exists("acts", lambda a: a["kind"].isin(*CONTENT)), F.lit(False))
    marked = turns.withColumns({"_named": named, "_sure": content | C("secures")})
    marked = marked.withColumns({"_first": ~seen(C("_named")), "_calm": ~seen(C("_sure"))})
    return marked.filter(C("acts").isNotNull() & (~C("_named") | C("_first") | C("_calm"))).drop("_named", "_sure", "_first", "_calm")


def remedies_ahead(nodes: DataFrame, reach: int = REACH) -> DataFrame:
    """nodes with told: structs of ord and text of the next live turns, up to reach, that name a remedy, in order."""
    live = C("status") != "abandoned"
    upto = Window.partitionBy("tree").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    named = T.matches(C("text"), "|".join(p for p, _ in P.REMEDIES))
    own = nodes.withColumns({"_rank": F.count(F.when(live, 1)).over(upto), "_told": F.when(live & named, F.struct("ord", "text"))})
    ahead = Window.partitionBy("tree").orderBy("_rank").rangeBetween(1, reach)
    return own.withColumn("told", F.sort_array(F.collect_list("_told").over(ahead))).drop("_rank", "_told")


def _remedies(told: Column, corrector: Column) -> Column:
    return F.array_join(F.transform(F.filter(told, lambda t: corrector.isNull() | (t["ord"] != corrector)), lambda t: t["text"]), " ")


def remedy_texts(nodes: DataFrame, failures: DataFrame, reach: int = REACH) -> DataFrame:
    """(tree, ord, remedies): the texts of the next live turns, up to reach, that name a remedy, joined in order; the failure's corrector is left out.

    failures has tree, ord and corrector (an ord or null).
    """
    met = dealt(failures.select("tree", "ord", "corrector"), remedies_ahead(nodes, reach).select("tree", "ord", "told"), ["tree", "ord"])
    return met.select("tree", "ord", _remedies(C("told"), C("corrector")).alias("remedies")).filter("remedies <> ''")


#: What concerns look for around a turn, of evidence.LOOKED_FOR, and what they need of the turn itself.
WANTED, KEPT = ("correction", "secured", "later"), ("kind", "told")


def counted_turns(known: DataFrame, actions: DataFrame) -> DataFrame:
    """The turns whose actions count, with what they touch and what was looked up for them; known is what looked_up() has for remedies_ahead() of nodes, with WANTED and KEPT."""
    turns = known.select("tree", "ord", "secures", "accepting", *WANTED, *KEPT)
    return let_through(dealt(turns, touching(actions), ["tree", "ord"], "left"))


def merged(counted: DataFrame) -> DataFrame:
    """concerns() without summary, of counted turns."""
    human = F.coalesce((C("kind") != "correction") & C("secured").isNotNull(), F.lit(False))
    own = scored(counted.withColumn("human", human))
    kinds = F.array_distinct(F.transform("acts", lambda a: a["kind"]))
    shown = F.slice(F.array_distinct(F.transform("acts", lambda a: a["evidence"])), 1, 3)
    quoted = F.array_join(F.transform(shown, lambda t: F.concat(F.lit('"'), T.truncate(t, 80), F.lit('"'))), ", ")
    evidence = F.concat(F.lit("Agent action touched "), F.array_join(kinds, ", "), F.lit(" [signals: "), F.array_join("signals", "; "), F.lit("]: "), quoted)
    about = F.coalesce(F.concat(F.lit("f:"), C("key")), F.concat(F.lit("s:"), C("stem")), F.concat(F.lit("t:"), C("ord").cast("string")))
    corrector = F.when(C("kind") != "correction", C("correction"))
    own = own.withColumns({"kinds": kinds, "_about": about, "corrector": corrector, "resolved": F.coalesce("later", "accepting")})
    first = F.struct("ord", "key", "stem", "kinds", "corrector", "resolved", "told", "acts", "signals")
    best = own.groupBy("tree", "_about").agg(F.min_by(first, "ord").alias("_f"), F.max("confidence").alias("confidence"), F.max_by("tier", tier_rank(C("tier"))).alias("tier"), F.count("*").alias("turns"))
    best = best.select("tree", "tier", "confidence", "turns", "_f.*").withColumns({"remedies": _remedies(C("told"), C("corrector")), "evidence": evidence})
    return best.select("tree", "ord", "tier", "confidence", "turns", "key", "stem", F.array_join("kinds", ",").alias("kinds"), "evidence", "corrector", "resolved", "remedies")


def concerns(nodes: DataFrame, actions: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """One row for each concern of a tree: ord (its first turn), tier and confidence (the highest of its turns), turns, key, stem, kinds, evidence, corrector, resolved, summary and remedies.

    Turns about the same file, or else the same credential, are one concern; a turn about neither is its own. What a concern
    says, and what corrects it, is its first turn's. counted are the turns that count, if they are there already.
    """
    if counted is None:
        nodes = cut(nodes)
        counted = counted_turns(looked_up(remedies_ahead(nodes), WANTED, KEPT), actions)
    titles = nodes.select("tree", "ord", T.title(C("text")).alias("_title"))
    texts = nodes.select("tree", C("ord").alias("corrector"), C("text").alias("_by"))
    own = merged(counted)
    found = dealt(dealt(own, titles, ["tree", "ord"], "left"), texts, ["tree", "corrector"], "left")
    near = F.concat(F.lit('An agent action touched auth, secrets, or access control near "'), T.truncate(C("_title"), 90), F.lit('"'))
    summary = F.concat(near, F.when(C("corrector").isNotNull(), F.concat(F.lit('; corrected by: "'), T.quote(C("_by")), F.lit('".'))).otherwise("."))
    return found.select(*own.columns, summary.alias("summary"))
