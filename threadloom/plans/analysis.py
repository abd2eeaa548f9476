"""From a tree's turns, rejections and actions to its failures, chains, lessons and evaluations.

nodes has tree, ord (unique in the tree), text, kind, status, files, parent (an ord or null) and, where known, narration;
rejections has tree, ord, kind and confidence; actions is as in operators/concerns.py. Each rule that finds failures is one set of
emissions; all of them together are deduplicated, linked and worded.

Defined results: nulls in text are empty; a tree in which nothing went wrong has no rows; equal rejections of a turn are one
failure. What a rule finds at one turn comes before what is found at later ones, and rules have a fixed order at a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import security as S
from ..functions import text as T
from ..operators import concerns as K
from ..operators import evidence
from ..operators.failures import tier_rank
from ..operators.sequence import numbered, padded_id
from ..shared import cut, dealt
from . import reports

# Wordings strong enough without anything that they could be about, and the figures of each rule.
STRONG = (
    ("user_frustration", r"\b(god awful|wtf|what the (?:heck|hell)|(?:so |really |this )?sucks|i(?:'m| am) (?:angry|frustrated|furious)|angry and frustrated|makes me (?:angry|mad|furious)|absolutely terrible|piece of (?:junk|garbage|trash|crap))\b"),
    ("scope_drift", r"\b(?:scope drift|you (?:went|are going) way out of scope|completely off (?:track|scope)|total scope creep)\b"),
    ("overbuilt_solution", r"\b(?:scrap the (?:whole|entire) web app|you (?:overbought|massively overbuilt)|way too (?:heavy|complex|big))\b"),
)
INTENT, BACKSTOP, LEFT = 0.7, 0.62, 0.9
CONFIRMED_LEAST, INFERRED_MOST, PLACED_MOST = 0.82, 0.7, 0.68
DECLINES = ("user_declined_tool", "user_interrupt", "user_text_decline")
FORWARD_TYPE, FORWARD = "user_rejected_action", 0.6

C = F.col
COLUMNS = ("tree", "at", "part", "pos", "type", "node", "corrector", "confidence", "tier", "lesson", "settle", "summary", "extra")


def _rows(df: DataFrame, **given: Column) -> DataFrame:
    """Emissions: at (the turn that was looked at), part (the rule's place), pos, type, node (the failing turn), corrector, confidence, tier, lesson, settle (whether a later acceptance is looked for), summary and extra."""
    empty = {"pos": F.lit(0), "corrector": F.lit(None), "lesson": F.lit(True), "settle": F.lit(True), "summary": F.lit(None), "extra": F.lit("")}
    types = {"at": "long", "part": "int", "pos": "int", "node": "long", "corrector": "long", "confidence": "double", "lesson": "boolean", "settle": "boolean", "summary": "string", "extra": "string", "type": "string", "tier": "string"}
    cols = {**empty, **given}
    return df.select("tree", *(cols[c].cast(types[c]).alias(c) for c in COLUMNS[1:]))


def refused(nodes: DataFrame, rejections: DataFrame) -> DataFrame:
    """nodes with own_refusal and refusal: whether the model refused at the turn, and there or at its parent."""
    bad = rejections.filter("kind = 'model_refusal'").select("tree", "ord").distinct()
    own = dealt(nodes, bad.withColumn("own_refusal", F.lit(True)), ["tree", "ord"], "left")
    own = dealt(own, bad.select("tree", C("ord").alias("parent"), F.lit(True).alias("_above")), ["tree", "parent"], "left")
    no = F.lit(False)
    return own.withColumns({"own_refusal": F.coalesce("own_refusal", no), "refusal": F.coalesce("own_refusal", no) | F.coalesce("_above", no)}).drop("_above")


def emissions(nodes: DataFrame, rejections: DataFrame, actions: DataFrame) -> DataFrame:
    """All that the rules find, before it is deduplicated, with seq, its place in the tree, and resolved, the turn that settles it."""
    nodes = cut(K.remedies_ahead(nodes.withColumn("text", F.coalesce("text", F.lit("")))))
    titles = nodes.select("tree", C("ord").alias("node"), T.title(C("text")).alias("title"))
    known = evidence.looked_up(nodes, (*K.WANTED, "earlier"), K.KEPT, listed=True)
    told = cut(refused(nodes, rejections).withColumn("title", T.title(C("text"))))

    w = Window.partitionBy("tree", "ord").orderBy("kind", "confidence")
    own = rejections.withColumn("type", T.failure_type(C("kind"))).filter("type is not null").withColumn("_n", F.row_number().over(w)).withColumnRenamed("kind", "_kind")
    own = dealt(own, told.select("tree", "ord", "text", "title"), ["tree", "ord"])
    damped = (C("type") == "user_rejected_action") & (C("_kind") == "user_text_decline") & ~S.redirects_tool(C("text"))
    sure = F.coalesce("confidence", F.lit(0.7))
    out = _rows(own, at=C("ord"), part=F.lit(0), pos=C("_n"), type=C("type"), node=C("ord"), confidence=sure, tier=T.tier(F.coalesce("confidence", F.lit(0.0))), lesson=~damped, settle=F.lit(False), summary=T.rejection_summary(C("_kind"), C("title")))

    counted = cut(K.counted_turns(known, actions))
    found = K.concerns(nodes, actions, counted)
    risk = F.lit("security_or_privacy_risk")
    safe = _rows(found, at=C("ord"), part=F.lit(1), type=risk, node=C("ord"), corrector=C("corrector"), confidence=C("confidence"), tier=C("tier"), summary=C("summary"), extra=C("remedies"))
    quiet = dealt(told, counted.select("tree", "ord"), ["tree", "ord"], "left_anti")
    clause = actions.select("tree", "ord", "seq", S.narrated_intent(C("narration")).alias("_c")).filter("_c is not null").groupBy("tree", "ord").agg(F.min_by("_c", "seq").alias("_c"))
    complains = rejections.filter(C("kind").isin(*DECLINES)).select("tree", "ord", F.lit(True).alias("_complains")).distinct()
    quiet = dealt(dealt(quiet, clause, ["tree", "ord"], "left"), complains, ["tree", "ord"], "left")
    meant = T.security_intent(C("text")).isNotNull() & ~C("refusal")
    by_text = F.when(C("_complains").isNull() & ~S.is_security_correction(C("text")) & (F.length("text") <= 1200), S.narrated_intent(C("text")))
    narrated = ~C("own_refusal") & F.coalesce("_c", by_text).isNotNull()
    near = lambda lead: F.concat(F.lit(lead + ' near "'), T.truncate(C("title"), 90), F.lit('".'))
    intents = quiet.filter(meant | narrated)
    stated = F.when(meant, near("A security-sensitive intent was stated")).otherwise(near("A security-sensitive intent was narrated"))
    safe = cut(safe.unionByName(_rows(intents, at=C("ord"), part=F.lit(1), type=risk, node=C("ord"), confidence=F.lit(INTENT), tier=F.lit("inferred"), summary=stated)))

    target = cut(evidence.failure_target(nodes, known).select("tree", "ord", "target", "linkage"))
    # a person's first correction about security counts by itself only where nothing was found up to it
    asks = dealt(nodes.filter(S.is_security_correction(C("text"))).select("tree", "ord"), target, ["tree", "ord"]).filter("target is not null")
    first = asks.groupBy("tree").agg(F.min("ord").alias("ord"), F.min_by("target", "ord").alias("target"))
    first = dealt(first, safe.groupBy("tree").agg(F.min("at").alias("_at")), ["tree"], "left").filter("_at is null or _at > ord")
    first = dealt(first, titles.withColumnRenamed("node", "target"), ["tree", "target"])
    flagged = F.concat(F.lit('A human security correction was raised near "'), T.truncate(C("title"), 90), F.lit('" with no matching action-level signal.'))
    out = out.unionByName(safe).unionByName(_rows(first, at=C("ord"), part=F.lit(2), type=risk, node=C("target"), corrector=C("ord"), confidence=F.lit(BACKSTOP), tier=F.lit("inferred"), summary=flagged))

    path = F.lit("abandoned_path")
    off = told.filter("status = 'abandoned'")
    out = out.unionByName(_rows(off, at=C("ord"), part=F.lit(3), type=path, node=C("ord"), confidence=F.lit(LEFT), tier=F.lit("verified"), summary=F.concat(F.lit("A side path was abandoned: "), T.truncate(C("title"), 120))))
    live = told.filter("status <> 'abandoned'")
    lost = live.withColumn("_b", S.bad_path(C("text"))).filter("_b is not null")
    out = out.unionByName(_rows(lost, at=C("ord"), part=F.lit(4), type=path, node=C("ord"), confidence=C("_b.confidence"), tier=C("_b.tier"), summary=S.bad_path_summary(S.file_hint(C("text"), C("files")), C("_b.recovered"))))

    asked = dealt(live.filter(T.is_analyzed(C("text"), C("kind")) & ~C("refusal")), target, ["tree", "ord"], "left")
    each = asked.select("tree", "ord", "kind", "text", "title", "target", "linkage", F.posexplode(T.process_signals(C("text"), C("kind"))).alias("pos", "s"))
    each = dealt(each, titles.withColumnsRenamed({"node": "target", "title": "_title"}), ["tree", "target"], "left")
    corrects = C("kind") == "correction"
    tied = C("target").isNotNull() & (corrects | (C("linkage") == "semantic"))
    placed = ~tied | (C("linkage") == "positional")
    least = F.when(tied, F.greatest("s.confidence", F.lit(CONFIRMED_LEAST))).otherwise(F.least("s.confidence", F.lit(INFERRED_MOST)))
    about, title = F.when(tied, C("target")).otherwise(C("ord")), F.when(tied, C("_title")).otherwise(C("title"))
    said = T.failure_summary(C("s.type"), title, F.when(tied, C("title")), C("text"))
    signals = _rows(
        each.filter(tied | corrects), at=C("ord"), part=F.lit(5), pos=C("pos"), type=C("s.type"), node=about, corrector=F.when(tied, C("ord")), confidence=F.when(placed, F.least(least, F.lit(PLACED_MOST))).otherwise(least),
        tier=F.when(placed, "inferred").otherwise("confirmed"), lesson=C("s.lesson"), summary=said,
    )
    strong = F.lit(False)
    for name, pattern in STRONG:
        strong = strong | ((C("s.type") == name) & T.matches(C("text"), pattern))
    alone = F.coalesce("target", "ord")
    recalled = _rows(each.filter(~(tied | corrects) & strong), at=C("ord"), part=F.lit(5), pos=C("pos"), type=C("s.type"), node=alone, confidence=F.least("s.confidence", F.lit(BACKSTOP)), tier=F.lit("inferred"), summary=T.failure_summary(C("s.type"), F.coalesce("_title", "title"), F.lit(None).cast("string"), C("text")))
    out = cut(numbered(out.unionByName(signals).unionByName(recalled), ["tree"], ["at", "part", "pos", "node", "type"], "seq"))

    # a number for each pair of a failing turn and what corrects it, which later acceptances are looked for
    out = out.withColumn("id", F.when(C("settle"), C("node") * (1 << 31) + F.coalesce("corrector", F.lit(0))))
    pairs = out.filter("settle").select("tree", "id", C("node").alias("ord"), "corrector").distinct()
    settled = evidence.accepted_after(nodes, pairs, known).withColumnRenamed("accepted", "resolved")
    return cut(dealt(out, settled, ["tree", "id"], "left").select(*COLUMNS, "seq", "resolved"))



def failures(found: DataFrame) -> DataFrame:
    """One failure for each tree, type and turn of emissions: of the highest confidence and tier, with the first corrector and summary, numbered in the order in which they were found."""
    first = F.min_by("corrector", F.when(C("corrector").isNotNull(), C("seq")))
    best = found.groupBy("tree", "type", "node").agg(F.min("seq").alias("seq"), F.max("confidence").alias("confidence"), F.max_by("tier", tier_rank(C("tier"))).alias("tier"), first.alias("corrector"), F.min_by("resolved", "seq").alias("resolved"), F.min_by("summary", "seq").alias("summary"))
    return numbered(best, ["tree"], ["seq"], "_n").withColumn("failure_id", padded_id("failure", C("_n"))).drop("_n", "seq")


def chains(found: DataFrame, nodes: DataFrame, rejections: DataFrame) -> DataFrame:
    """Failures linked to what corrected them: those of emissions, then those met by looking on from failing turns, then back from redirecting ones; each pair once."""
    linked = found.filter("corrector is not null and corrector > node").select("tree", C("node").alias("failure"), C("corrector").alias("correction"), "type", "confidence", F.lit(0).alias("pass"), C("seq").cast("long").alias("seq"))
    failing = found.select("tree", C("node").alias("ord")).union(rejections.select("tree", "ord")).distinct().withColumn("failing", F.lit(True))
    declined = rejections.filter(C("kind").isin(*DECLINES)).select("tree", "ord").distinct().withColumn("declined", F.lit(True))
    marked = dealt(dealt(nodes, failing, ["tree", "ord"], "left"), declined, ["tree", "ord"], "left").na.fill(False, ["failing", "declined"])
    more = lambda df, n, by: df.select("tree", "failure", "correction", F.lit(FORWARD_TYPE).alias("type"), F.lit(FORWARD).alias("confidence"), F.lit(n).alias("pass"), C(by).cast("long").alias("seq"))
    every = linked.unionByName(more(evidence.forward_chains(marked), 1, "failure")).unionByName(more(evidence.backward_chains(marked), 2, "correction"))
    return evidence.unique_chains(every).select("tree", "chain_id", "failure", "correction", "type", "confidence")


def _worded(found: DataFrame, nodes: DataFrame) -> DataFrame:
    said = nodes.select("tree", C("ord").alias("node"), "text")
    by = nodes.select("tree", C("ord").alias("corrector"), C("text").alias("corrected_text"))
    own = dealt(dealt(found, said, ["tree", "node"]), by, ["tree", "corrector"], "left")
    return own.select("tree", "seq", "type", "node", "text", C("corrector").alias("correction"), "corrected_text", "summary", "lesson", "extra")


def lessons(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lessons of emissions; those on security name the remedies of later turns too."""
    both = F.trim(F.concat_ws(" ", F.coalesce("corrected_text", F.lit("")), F.coalesce("extra", F.lit(""))))
    return reports.lessons(_worded(found, nodes).withColumn("corrected_text", F.nullif(both, F.lit(""))))


def evaluations(found: DataFrame, nodes: DataFrame) -> DataFrame:
    return reports.evaluations(_worded(found, nodes))
