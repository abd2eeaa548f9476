"""The library's queries over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import constraints, secrets, text as T
from ..operators import concerns, failures, lineage, redaction, references, sequence, stats
from ..operators.evidence import looked_up
from ..shared import cut, spread
from . import analysis, concern_sql, secret_sql
from .synthetic import FIELDS_SQL, FILES, PLANTED_SQL, REPEATED_SQL, RULED_SQL, SQL, fields, planted, repeated_turns, ruled_turns, turns

Query = Callable[[SparkSession, str], DataFrame]
KEY, ORDER = ["tree"], ["ts", "event_id"]
C = F.col


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {_quoted(pattern)}, 'i'), false)"


def _case(column: str, named) -> str:
    return "case " + " ".join(f"when {_has(column, p)} then '{n}'" for n, p in named) + " end"


T_SQL = f"with t as ({SQL})"
U_SQL = f"{T_SQL}, u as (select *, row_number() over (partition by tree order by ts, event_id) as n from t where role = 'user')"
KIND_SQL = f"""case when n = 1 then 'root' when {_has('text', P.CORRECTION_OPENER)} or {_has('text', P.CORRECTION_ANYWHERE)} then 'correction'
  when {_has('text', P.SCOPE)} then 'scope-change' when {_has('text', P.CHECKPOINT)} then 'checkpoint' when {_has('text', P.CORRECTION_SOFT_OPENER)} then 'correction'
  when {_has('text', P.QUESTION)} and length(text) < 250 then 'question' else 'direction' end"""
K_SQL = f"{U_SQL}, k as (select *, {KIND_SQL} as kind from u)"
NUDGE_SQL = f"(len(string_split_regex(trim(text), '\\s+')) <= 4 and {_has('text', P.CONTINUATION)})"
REFUSAL_SQL = f"(length(text) <= 4000 and {_has('text', P.REFUSAL)} and (not {_has('text', P.COMPLIANT)} or {_has('text', P.HARD_REFUSAL)}))"
CORE_SQL = f"regexp_replace(text, {_quoted(P.INTERJECTION)}, '', 'i')"
DECLINE_SQL = f"(length(text) <= 240 and not {_has(CORE_SQL, P.BENIGN_DECLINE)} and {_has(CORE_SQL, P.DECLINE)})"
RESULT_SQL = f"case when result = '' then 'tool_execution_error' when {_has('result', P.USER_DECLINED_TOOL)} then 'user_declined_tool' when {_has('result', P.PERMISSION_DENIED)} then 'permission_denied' else 'tool_execution_error' end"
R_SQL = f"""{T_SQL}, r as (select tree, ts, event_id, {RESULT_SQL} as kind, case when result = '' then 0.85::double when {RESULT_SQL} = 'user_declined_tool' then 1.0::double
  when {RESULT_SQL} = 'permission_denied' then 0.85::double else 0.9::double end as confidence from t where role = 'assistant'),
  f as (select *, case kind when 'user_declined_tool' then 'user_rejected_action' when 'permission_denied' then 'permission_denied' else 'tool_execution_failed' end as type,
  case when confidence >= 0.95 then 'verified' when confidence >= 0.8 then 'high' when confidence >= 0.65 then 'confirmed' else 'inferred' end as tier, event_id // 10 as node_ord from r)"""


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sequence.numbered(turns(spark, sf_dir).filter("role = 'user'"), KEY, ORDER, "n")
    return own.withColumn("kind", T.turn_kind(C("text"), C("n") == 1))


def _rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).filter("role = 'assistant'").select("tree", "ts", "event_id", T.tool_rejection(C("result")).alias("r")).select("tree", "ts", "event_id", "r.*")


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures.from_rejections(_rejections(spark, sf_dir).withColumn("node_ord", F.expr("event_id div 10")))


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's turns as a tree: a turn's parent is half its number, or every seventh the turn before. Written out, as the queries read it many times."""
    own = sequence.numbered(turns(spark, sf_dir), KEY, ORDER, "node")
    return cut(own.select("tree", C("node").cast("long").alias("node"), F.when(C("node") == 1, None).when(C("node") % 7 == 0, C("node") - 1).otherwise(F.expr("node div 2")).cast("long").alias("parent")))


FOREST_SQL = f"""with recursive t as ({SQL}), n0 as (select tree, row_number() over (partition by tree order by ts, event_id) as node from t),
  n as (select tree, node, case when node = 1 then null when node % 7 = 0 then node - 1 else node // 2 end as parent from n0),
  up as (select tree, node, parent as ancestor, 1 as distance from n where parent is not null union all
         select up.tree, up.node, n.parent, distance + 1 from up join n on n.tree = up.tree and n.node = up.ancestor where n.parent is not null),
  leaf as (select tree, max(node) as node from n group by tree),
  main as (select * from leaf union select up.tree, up.ancestor from up join leaf using (tree, node)),
  s as (select n.*, case when not exists (select 1 from main m where m.tree = n.tree and m.node = n.node) and
        exists (select 1 from up join main m on m.tree = up.tree and m.node = up.ancestor where up.tree = n.tree and up.node = n.node) then 'abandoned' else 'accepted' end as status from n)"""


def turn_kinds(spark, sf_dir):
    return stats.kind_counts(_users(spark, sf_dir), KEY)


def turn_relationships(spark, sf_dir):
    """How each turn relates to the one before, counted by the pair of kinds."""
    own = _users(spark, sf_dir).withColumn("before", sequence.latest_before(C("kind"), KEY, ORDER))
    return own.filter("before is not null").groupBy("before", "kind").agg(F.count("*").alias("n"), F.min(T.relationship(C("kind"))).alias("relationship"))


def nudges_folded(spark, sf_dir):
    own = turns(spark, sf_dir).filter("role = 'user'")
    return sequence.folded(own, KEY, ORDER, T.is_nudge(C("text"))).select("tree", "event_id", "nudges", "repeats")


def refusals(spark, sf_dir):
    return turns(spark, sf_dir).filter(T.is_refusal(C("text"))).groupBy("tree").agg(F.count("*").alias("n"))


def declines(spark, sf_dir):
    return turns(spark, sf_dir).filter(T.is_decline(C("text"))).groupBy("tree", "text").agg(F.count("*").alias("n"))


def rejection_ledger(spark, sf_dir):
    return _rejections(spark, sf_dir).withColumns({"type": T.failure_type(C("kind")), "tier": T.tier(C("confidence"))}).select("tree", "event_id", "kind", "type", "tier", "confidence")


def rejections_by_kind(spark, sf_dir):
    return stats.kind_counts(_rejections(spark, sf_dir), KEY)


def failures_by_node(spark, sf_dir):
    return failures.deduplicated(_failures(spark, sf_dir)).select("tree", "type", "node_ord", "confidence", "tier", "failure_id")


def tiers_by_tree(spark, sf_dir):
    return failures.tier_counts(_failures(spark, sf_dir))


def lessons_by_type(spark, sf_dir):
    return failures.lessons(_failures(spark, sf_dir)).select("tree", "type", "first_node", "n_nodes", "lesson_id")


def session_stats(spark, sf_dir):
    return stats.session_stats(turns(spark, sf_dir), KEY).select("tree", "user_turns", "assistant_turns", "files", "models", "days")


def sessions_since(spark, sf_dir):
    """Sessions whose last turn isn't before a time."""
    return stats.session_stats(turns(spark, sf_dir), KEY).filter("last_ts >= timestamp_ntz '2024-01-20 00:00:00'").select("tree", "last_ts")


def token_totals(spark, sf_dir):
    return stats.token_usage(turns(spark, sf_dir), KEY, "event_id")


def prior_file(spark, sf_dir):
    """For each user turn the file of the assistant's last turn before it."""
    own = turns(spark, sf_dir).withColumn("prior", sequence.latest_before(F.when(C("role") == "assistant", C("file")), KEY, ORDER))
    return own.filter("role = 'user'").select("tree", "event_id", "prior")


def correction_chains(spark, sf_dir):
    """For each correction the next direction within ten turns that resolves it."""
    own = sequence.within_next(_users(spark, sf_dir), KEY, ORDER, C("kind") == "direction", C("event_id"), 10)
    return own.filter("kind = 'correction'").select("tree", "event_id", C("next_value").alias("resolved_by"))


def correction_causes(spark, sf_dir):
    """For each correction the last failing result within six turns before."""
    own = turns(spark, sf_dir)
    failing = (C("role") == "assistant") & (C("result") != "")
    own = sequence.within_last(own, KEY, ORDER, failing, C("event_id"), 6)
    return own.filter((C("role") == "user") & T.matches(C("text"), P.CORRECTION_OPENER)).select("tree", "event_id", C("last_value").alias("caused_by"))


def security_gate(spark, sf_dir):
    """Turns on a security surface after a first risky command of their session, by surface."""
    own = turns(spark, sf_dir).withColumns({"risk": T.risky_command(C("command")), "surface": T.security_surface(C("file"))})
    own = own.withColumn("after", sequence.seen_before(C("risk").isNotNull(), KEY, ORDER))
    return own.filter("surface is not null").groupBy("tree", "surface").agg(F.count("*").alias("touches"), F.count_if("after").alias("after_risk"))


def risky_commands(spark, sf_dir):
    return turns(spark, sf_dir).select("tree", T.risky_command(C("command")).alias("risk")).filter("risk is not null").groupBy("tree", "risk").agg(F.count("*").alias("n"))


def test_skips(spark, sf_dir):
    return turns(spark, sf_dir).filter(T.skips_tests(C("text"))).groupBy("tree").agg(F.count("*").alias("n"))


def secret_findings(spark, sf_dir):
    """What each document and its sample have by each rule."""
    return secrets.findings(planted(spark, sf_dir), "doc_id", "text").groupBy("doc_id", "rule", "severity", "match_sha256").agg(F.count("*").alias("n"))


def secret_spans(spark, sf_dir):
    """Where each finding lies."""
    return secrets.findings(planted(spark, sf_dir), "doc_id", "text").select("doc_id", "rule", C("start").cast("long").alias("start_at"), C("end").cast("long").alias("end_at"), "commit", "match_sha256")


def secret_decisions(spark, sf_dir):
    """What becomes of each distinct match in an unattended run that keeps commits' hashes."""
    return secrets.decisions(secrets.findings(planted(spark, sf_dir), "doc_id", "text"), soft=True, keep_commits=True)


def redacted_texts(spark, sf_dir):
    return secrets.redacted(planted(spark, sf_dir), "text", soft=True).select("doc_id", F.sha2("text", 256).alias("sha256"))


def masked_fields(spark, sf_dir):
    """Prompts, commands and results of each tree, with what any of them shows to be secret masked in all."""
    return redaction.everywhere(fields(spark, sf_dir), "tree", ["event_id", "seq"]).select("event_id", C("seq").cast("long").alias("seq"), F.sha2("text", 256).alias("sha256"))


def turns_refolded(spark, sf_dir):
    """Surviving turns where each is held against the last one's text as it is by then."""
    own = sequence.streamed_fold(repeated_turns(spark, sf_dir).select("tree", "ts", "event_id", "text"), KEY, ORDER, T.is_nudge(C("text")), T.is_ignored(C("text")))
    return own.select("tree", "event_id", F.sha2("text", 256).alias("sha256"), "nudges", "repeats", "reruns")


def token_entropy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9a-z]{24,64}"), F.lit(0)))).alias("token"))
    return tokens.select("doc_id", "token", F.round(T.entropy(C("token")), 6).alias("entropy"))


def titles(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", T.truncate(C("text"), 96).alias("title"))


def main_paths(spark, sf_dir):
    nodes = _forest(spark, sf_dir)
    return lineage.main_path(nodes, nodes.groupBy("tree").agg(F.max("node").alias("node")))


def branch_status(spark, sf_dir):
    nodes = _forest(spark, sf_dir)
    return lineage.abandoned(nodes, nodes.groupBy("tree").agg(F.max("node").alias("node"))).select("tree", "node", "status")


def abandoned_branches(spark, sf_dir):
    nodes = _forest(spark, sf_dir)
    return lineage.abandoned_branches(lineage.abandoned(nodes, nodes.groupBy("tree").agg(F.max("node").alias("node"))))


def subtree_sizes(spark, sf_dir):
    return lineage.subtree_sizes(_forest(spark, sf_dir))


def tree_outlines(spark, sf_dir):
    """Every node's place and indent in its tree's outline."""
    return lineage.outline(_forest(spark, sf_dir))


def tree_summaries(spark, sf_dir):
    """Each tree's graph with runs of routine turns and abandoned branches folded into counts; every fifth turn is kept."""
    nodes = _forest(spark, sf_dir)
    marked = lineage.abandoned(nodes, nodes.groupBy("tree").agg(F.max("node").alias("node"))).withColumn("kept", (C("node") % 5 == 0) | (C("node") % 17 == 1))
    # some branches are put back, so that turns have several children that live
    return lineage.summary(marked.withColumn("status", F.when(C("node") % 3 > 0, "accepted").otherwise(C("status"))))


def missing_files(spark, sf_dir):
    own = turns(spark, sf_dir)
    refs = references.file_references(own.select("tree", C("event_id").alias("ord"), "text"))
    existing = spark.createDataFrame([(f,) for f in FILES], "path string")
    created = own.filter("event_id % 40 = 7").select("tree", C("file").alias("path"))
    return references.missing_files(refs, existing, created)


def constraint_ranking(spark, sf_dir):
    """The ten first rules that each session's prompts set."""
    rules = spread(ruled_turns(spark, sf_dir).select("tree", "event_id", "text"), "tree").select("tree", C("event_id").alias("node_ord"), F.posexplode(constraints.constraints(C("text"))).alias("place", "c"))
    return failures.ranked_constraints(rules.select("tree", "node_ord", "place", "c.*")).select("tree", "key", "label", "weight", "n", "last_node", "rank")


def shared_words(spark, sf_dir):
    """Turns of a conversation that share three words with one of the two before."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(C("conv_id").alias("tree"), C("turn").alias("ord"), T.words(F.coalesce("text", F.lit(""))).alias("words"))
    return failures.shared_words(rows, rows.withColumns({"from_ord": C("ord") - 2, "to_ord": C("ord") - 1}))


def model_totals(spark, sf_dir):
    own = turns(spark, sf_dir).groupBy("tree", "model").agg(F.count("*").alias("turns"), F.sum("input_tokens").alias("input_tokens"))
    return stats.totals(own, "model", ["turns", "input_tokens"])


def props_fields(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"), F.sha2("props", 256).alias("sha256"))


def latest_turn(spark, sf_dir):
    return turns(spark, sf_dir).groupBy("tree").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def _signals(spark, sf_dir):
    own = _users(spark, sf_dir).withColumn("s", F.explode(T.process_signals(C("text"), C("kind"))))
    return own.select("tree", "event_id", "n", "kind", "text", "s.type", "s.confidence")


def process_signals(spark, sf_dir):
    """What went wrong by each user turn's words, two kinds at most."""
    return _signals(spark, sf_dir).select("tree", "event_id", "type", "confidence")


def failure_type_counts(spark, sf_dir):
    """Kinds of failures of each tree, the most frequent first, then by name."""
    counts = _signals(spark, sf_dir).groupBy("tree", "type").agg(F.count("*").alias("n"))
    return sequence.numbered(counts, KEY, [F.desc("n"), "type"], "rank")


def signal_lessons(spark, sf_dir):
    """One lesson and evaluation for each kind of failure of a tree, in the words of its first signal."""
    first = _signals(spark, sf_dir).groupBy("tree", "type").agg(F.min(F.struct("n", "text")).alias("f"), F.count_distinct("n").alias("n_nodes"))
    return first.select(
        "tree", "type", "n_nodes", T.lesson_title(C("type")).alias("title"), T.lesson_text(C("type"), F.lit(""), C("f.text")).alias("lesson"), T.eval_type(C("type")).alias("eval_type"), T.eval_task(C("type")).alias("task"),
        F.array_join(T.expected_behavior(C("type")), "; ").alias("expected"), T.failure_mode(C("type")).alias("failure_mode"),
    )


def failure_summaries(spark, sf_dir):
    """A sentence on each signal at the turn before, corrected by the turn that says so; signals of a first turn have none before."""
    own = _users(spark, sf_dir).withColumn("before", F.lag("text").over(sequence.ordered(KEY, ORDER)))
    each = own.withColumn("s", F.explode(T.process_signals(C("text"), C("kind")))).select("tree", "event_id", "text", "before", "s.type")
    return each.select("tree", "event_id", "type", T.failure_summary(C("type"), C("before"), F.when(C("before").isNotNull(), C("text")), C("text")).alias("summary"))


def security_intents(spark, sf_dir):
    return turns(spark, sf_dir).filter("role = 'user'").select("tree", T.security_intent(C("text")).alias("intent")).filter("intent is not null").groupBy("tree", "intent").agg(F.count("*").alias("n"))


def security_concerns(spark, sf_dir):
    """Security concerns of each tree, with their scores, correctors and later remedies."""
    nodes = concern_sql.secured_nodes(spark, sf_dir)
    known = looked_up(concerns.remedies_ahead(nodes), concerns.WANTED, concerns.KEPT)
    return concerns.merged(concerns.counted_turns(known, concern_sql.secured_actions(nodes)))


def tree_failures(spark, sf_dir):
    """The failures that all rules find in each tree, with their correctors and what settles them."""
    nodes = concern_sql.secured_nodes(spark, sf_dir)
    own = nodes.withColumn("parent", F.nullif(C("ord") - 1, F.lit(0))).drop("event_id")
    found = analysis.emissions(own, concern_sql.secured_rejections(nodes), concern_sql.secured_actions(nodes))
    return analysis.failures(found).select("tree", "type", "node", "confidence", "tier", "corrector", "resolved")


def touched_surfaces(spark, sf_dir):
    """What each turn's actions touch, with the key or stem by which it is told from others."""
    own = concerns.touching(concern_sql.secured_actions(concern_sql.secured_nodes(spark, sf_dir)))
    return own.select("tree", "ord", F.array_join(F.transform("acts", lambda a: a["kind"]), ",").alias("kinds"), F.array_join(F.transform("acts", lambda a: a["evidence"]), "|").alias("evidence"), "surface", "key", "stem")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    turn_kinds, turn_relationships, nudges_folded, refusals, declines, rejection_ledger, rejections_by_kind, failures_by_node, tiers_by_tree, lessons_by_type, session_stats, sessions_since, token_totals, prior_file,
    correction_chains, correction_causes, security_gate, risky_commands, test_skips, secret_findings, secret_spans, secret_decisions, redacted_texts, masked_fields, turns_refolded, token_entropy, titles, main_paths, branch_status, abandoned_branches, subtree_sizes, tree_outlines, tree_summaries,
    missing_files, constraint_ranking, shared_words, model_totals, props_fields, latest_turn, process_signals, failure_type_counts, signal_lessons, failure_summaries, security_intents, security_concerns, touched_surfaces, tree_failures,
)}

_PLANTED = f"with p as ({PLANTED_SQL}), {secret_sql.scan('p', 'x')}"
_RANK = "case severity when 'high' then 0 when 'medium' then 1 else 2 end"


def _process_sql() -> str:
    rows = ", ".join(f"case when {_has('text', p)} then {{'rank': {i}, 'type': '{n}', 'confidence': {c}::double}} end" for i, (n, p, c) in enumerate(P.PROCESS))
    goal = f"case when kind = 'correction' and {_has('text', P.MISUNDERSTOOD)} and not {_has('text', P.REVERSAL)} then {{'rank': 99, 'type': 'misunderstood_goal', 'confidence': 0.62::double}} end"
    return f"""{K_SQL}, a as (select *, list_filter([{rows}], lambda x: x is not null) as l, {goal} as g from k),
      b as (select *, case when len(l) > 0 then l[1:2] when g is not null then [g] else [] end as s, lag(text) over (partition by tree order by n) as before from a),
      x as (select tree, event_id, n, text, before, unnest(s) as e from b), sig as (select tree, event_id, n, text, before, e.type as type, e.confidence as confidence from x)"""


def _named_sql(values: dict[str, str], otherwise: str) -> str:
    return "case type " + " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in values.items()) + f" else {_quoted(otherwise)} end"


def _cut_sql(text: str, n: int) -> str:
    one = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"case when length({one}) <= {n} then {one} else rtrim(substr({one}, 1, {n - 1})) || '...' end"


_AT_SQL = f"""'"' || {_cut_sql("before", 90)} || '"'"""
_BY_SQL = f"""'; corrected by "' || {_cut_sql("text", 90)} || '".'"""
_WHOLE_SQL = f"""'; corrected by: "' || replace({_cut_sql("text", 240)}, '"', '\\"') || '".'"""
_BEHAVIOR_SQL = {k: "; ".join((*P.BEHAVIOR_OF.get(k, ()), *P.COMMON_BEHAVIOR)) for k in P.LESSONS}
_SUMMARY_SQL = f"""case when before is null then case type when 'scope_drift' then 'A scope boundary was stated at "a previous direction".' when 'format_violation' then 'A required output format was stated at "a previous direction".'
    else 'A ' || replace(type, '_', ' ') || ' concern was raised at "a previous direction".' end
  else case type when 'ignored_constraint' then 'A prior direction appears to have ignored a user constraint near ' || {_AT_SQL} || {_BY_SQL} when 'scope_drift' then 'The session drifted from the intended scope near ' || {_AT_SQL} || {_WHOLE_SQL}
    when 'misunderstood_goal' then 'The agent appears to have misunderstood the goal near ' || {_AT_SQL} || {_WHOLE_SQL} when 'overbuilt_solution' then 'The work appears to have overbuilt the requested shape near ' || {_AT_SQL} || {_BY_SQL}
    when 'underbuilt_solution' then 'The work appears to have underbuilt or skipped expected scope near ' || {_AT_SQL} || {_BY_SQL} when 'user_frustration' then 'User frustration signaled that the prior path near ' || {_AT_SQL} || ' was not meeting expectations.'
    when 'repeated_failed_fix' then 'A fix loop appears to have repeated near ' || {_AT_SQL} || {_BY_SQL} else 'A possible ' || replace(type, '_', ' ') || ' occurred near ' || {_AT_SQL} || {_BY_SQL} end end"""
#: Without the one wording that looks ahead, and that no synthetic turn has.
_INTENT_SQL = [(n, p) for n, p in P.SECURITY_INTENT if n != "email_change"]

_SECURED = f"""{T_SQL}, u as (select tree, ts, event_id, {concern_sql._at(concern_sql.SAID, 'event_id')} as text, row_number() over (partition by tree order by ts, event_id) as n from t where role = 'user'),
  k as (select *, {KIND_SQL} as kind from u), {concern_sql.ROWS}"""



def _constraint_sql() -> str:
    K = constraints
    any_named = " or ".join(_has("c", p) for p, _ in K.NAMED)
    named = ", ".join(f"case when {_has('text', p)} then {{'label': {_quoted(label)}, 'weight': {K.NAMED_WEIGHT}}} end" for p, label in K.NAMED)
    parts = f"string_split_regex(regexp_replace(text, {_quoted(f', +({K.COMMA_BEFORE})')}, chr(10) || '\\1', 'gi'), {_quoted(K.ENDS)})"
    cue = f"regexp_extract(c, {_quoted(f'(?s){K.CUE}.*')}, 0, 'i')"
    cut = f"trim(regexp_replace(trim(regexp_replace(case when {cue} <> '' then {cue} else c end, {_quoted(K.LEAD)}, '', 'i')), {_quoted(K.TAIL)}, ''))"
    stop = "[" + ", ".join(map(_quoted, K.STOP_WORDS)) + "]"
    key = f"array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(lower(x.label), '[^a-z0-9 ]+', '', 'g'), ' +'), lambda w: length(w) > 2 and not list_contains({stop}, w))), ' ')"
    return f"""with r as ({RULED_SQL}), c0 as (select *, list_filter(list_transform({parts}, lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g'))), lambda c: length(c) between 6 and 220 and {_has('c', K.DIRECTIVE)} and not {_has('c', K.DESCRIPTIVE)}
        and not regexp_matches(c, '\\?\\s*$') and not ({any_named})) as cs from r),
      c1 as (select *, list_filter(list_transform(cs, lambda c: {cut}), lambda p: length(p) >= 6) as ps from c0),
      c2 as (select tree, event_id, list_concat(list_filter([{named}], lambda x: x is not null), list_transform(ps, lambda p: {{'label': upper(p[1]) || p[2:], 'weight': 1}})) as l from c1),
      c3 as (select tree, event_id, list_filter(list_transform(l, lambda x: {{'label': x.label, 'weight': x.weight, 'key': {key}}}), lambda x: x.key <> '') as l from c2),
      c4 as (select tree, event_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda o: o.key), x.key) = i)[1:3] as l from c3),
      c5 as (select tree, event_id, generate_subscripts(l, 1) as place, unnest(l) as x from c4),
      c6 as (select tree, x.key as key, arg_max(x.label, (x.weight, event_id)) as label, max(x.weight) as weight, count(*) as n, max(event_id) as last_node, min((event_id, place)) as first from c5 group by all),
      c7 as (select *, row_number() over (partition by tree order by weight desc, n desc, last_node desc, first) as rank from c6) select tree, key, label, weight, n, last_node, rank from c7 where rank <= 10"""


ORACLE: dict[str, str] = {
    "tree_summaries": f"""{FOREST_SQL}, m as (select tree, node, parent, node = 1 as root, case when node % 3 > 0 then 'accepted' else status end = 'abandoned' and node > 1 as off, node % 5 = 0 or node % 17 = 1 or node = 1 as kept from s),
      b as (select tree, parent as node, count(*) as n, min(node) filter (kept) as nxt from m where not off and parent is not null group by all),
      g as (select m.tree, m.node, m.kept, m.parent, p.kept as pk from m join m p on p.tree = m.tree and p.node = m.parent left join b on b.tree = m.tree and b.node = m.parent
        where not m.off and not p.off and case when p.kept then true when m.kept then m.node = b.nxt else b.nxt is null and b.n = 1 end),
      d as (select tree, node, true as kept, null::bigint as up, node as run from m where root union all
        select g.tree, g.node, g.kept, g.parent, case when g.kept or g.pk then g.node else d.run end from g join d on d.tree = g.tree and d.node = g.parent),
      sz as (select n.tree, n.node, (select count(*) from up where up.tree = n.tree and up.ancestor = n.node) + 1 as size from n),
      c as (select tree, run, count(*) as steps from d group by all)
      select d.tree, case when d.kept then 'node' else 'steps' end as what, d.node, h.run as above, case when h.kept then 'node' when h.run is not null then 'steps' end as above_what, c.steps
        from d join c on c.tree = d.tree and c.run = d.node left join d h on h.tree = d.tree and h.node = d.up where d.node = d.run
      union all select m.tree, 'abandoned', m.parent, any_value(d.run), any_value(case when d.kept then 'node' else 'steps' end), sum(size)::bigint from m join sz using (tree, node) join d on d.tree = m.tree and d.node = m.parent where m.off group by m.tree, m.parent""",
    "tree_failures": f"{_SECURED}, {concern_sql.failures_sql(_process_sql()[len(K_SQL):])}",
    "security_concerns": f"{_SECURED}, {concern_sql.QUERY}",
    "touched_surfaces": f"{_SECURED}, {concern_sql.TOUCHING} select tree, ord, array_to_string(list_transform(acts, lambda a: a.kind), ',') as kinds, array_to_string(list_transform(acts, lambda a: a.evidence), '|') as evidence, surface, key, stem from tu",
    "process_signals": f"{_process_sql()} select tree, event_id, type, confidence from sig",
    "failure_type_counts": f"{_process_sql()}, c as (select tree, type, count(*) as n from sig group by all) select tree, type, n, row_number() over (partition by tree order by n desc, type)::int as rank from c",
    "signal_lessons": f"""{_process_sql()}, f as (select tree, type, min_by(text, n) as text, count(distinct n) as n_nodes from sig group by all)
      select tree, type, n_nodes, {_named_sql({k: v[0] for k, v in P.LESSONS.items()}, '')} as title, {_named_sql({k: v[1] for k, v in P.LESSONS.items()}, '')} || ' Specifically, the user directed: ' || {_cut_sql('text', 220)} as lesson,
      {_named_sql(P.EVAL_OF, 'instruction_following_regression')} as eval_type, {_named_sql(P.TASK_OF, P.COMMON_TASK)} as task, {_named_sql(_BEHAVIOR_SQL, '')} as expected,
      'Agent repeats ' || replace(type, '_', ' ') || ' despite prior correction.' as failure_mode from f""",
    "failure_summaries": f"{_process_sql()} select tree, event_id, type, {_SUMMARY_SQL} as summary from sig",
    "security_intents": f"{T_SQL}, x as (select tree, {_case('text', _INTENT_SQL)} as intent from t where role = 'user' and length(text) <= 1200) select tree, intent, count(*) as n from x where intent is not null group by all",
    "turn_kinds": f"{K_SQL} select tree, kind, count(*) as n from k group by all",
    "turn_relationships": f"""{K_SQL}, b as (select *, lag(kind) over (partition by tree order by ts, event_id) as before from k) select before, kind, count(*) as n,
      min(case kind when 'correction' then 'corrects' when 'scope-change' then 'expands' when 'checkpoint' then 'checkpoints' when 'question' then 'asks' when 'rejection' then 'rejects' else 'refines' end) as relationship
      from b where before is not null group by all""",
    "nudges_folded": f"""{U_SQL}, m as (select *, {NUDGE_SQL} as nudge, trim(regexp_replace(text, '\\s+', ' ', 'g')) as plain from u),
      l as (select *, last_value(case when not nudge then plain end ignore nulls) over (partition by tree order by n rows between unbounded preceding and 1 preceding) as prev from m),
      s as (select *, coalesce(not nudge and plain = prev, false) as rep from l), s2 as (select *, not rep and (not nudge or prev is null) as st from s),
      i as (select *, sum(st::int) over (partition by tree order by n) as node from s2)
      select tree, min(case when st then event_id end) as event_id, sum((nudge and not st)::int)::bigint as nudges, sum(rep::int)::bigint as repeats from i group by tree, node""",
    "refusals": f"{T_SQL} select tree, count(*) as n from t where {REFUSAL_SQL} group by tree",
    "declines": f"{T_SQL} select tree, text, count(*) as n from t where {DECLINE_SQL} group by all",
    "rejection_ledger": f"{R_SQL} select tree, event_id, kind, type, tier, confidence from f",
    "rejections_by_kind": f"{R_SQL} select tree, kind, count(*) as n from r group by all",
    "failures_by_node": f"""{R_SQL}, d as (select tree, type, node_ord, max(confidence) as confidence, arg_max(tier, case tier when 'verified' then 4 when 'high' then 3 when 'confirmed' then 2 else 1 end) as tier from f group by all),
      e as (select *, row_number() over (partition by tree order by node_ord, type) as k from d) select tree, type, node_ord, confidence, tier, 'failure_' || case when k < 1000 then lpad(k::varchar, 3, '0') else k::varchar end as failure_id from e""",
    "tiers_by_tree": f"{R_SQL} select tree, count(*) filter (tier = 'inferred') as inferred, count(*) filter (tier = 'confirmed') as confirmed, count(*) filter (tier = 'high') as high, count(*) filter (tier = 'verified') as verified from f group by tree",
    "lessons_by_type": f"""{R_SQL}, d as (select tree, type, min(node_ord) as first_node, count(distinct node_ord) as n_nodes from f group by all),
      e as (select *, row_number() over (partition by tree order by first_node, type) as k from d) select tree, type, first_node, n_nodes, 'lesson_' || lpad(k::varchar, 3, '0') as lesson_id from e""",
    "session_stats": f"""{T_SQL} select tree, count(*) filter (role = 'user') as user_turns, count(*) filter (role = 'assistant') as assistant_turns, count(distinct file) as files, count(distinct model) as models,
      greatest(1, ceil(date_diff('microsecond', min(ts), max(ts)) / 86400000000.0))::bigint as days from t group by tree""",
    "sessions_since": f"{T_SQL} select tree, max(ts) as last_ts from t group by tree having max(ts) >= timestamp '2024-01-20 00:00:00'",
    "token_totals": f"""{T_SQL}, l as (select tree, message_id, arg_max(input_tokens, event_id) as i, arg_max(output_tokens, event_id) as o from t where input_tokens > 0 or output_tokens > 0 group by all)
      select tree, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens from l group by tree""",
    "prior_file": f"{T_SQL}, p as (select *, last_value(case when role = 'assistant' then file end ignore nulls) over (partition by tree order by ts, event_id rows between unbounded preceding and 1 preceding) as prior from t) select tree, event_id, prior from p where role = 'user'",
    "correction_chains": f"""{K_SQL} select c.tree, c.event_id, (select min_by(d.event_id, d.n) from k d where d.tree = c.tree and d.kind = 'direction' and d.n between c.n + 1 and c.n + 10) as resolved_by from k c where c.kind = 'correction'""",
    "correction_causes": f"""{T_SQL}, o as (select *, row_number() over (partition by tree order by ts, event_id) as n from t)
      select c.tree, c.event_id, (select max_by(d.event_id, d.n) from o d where d.tree = c.tree and d.role = 'assistant' and d.result <> '' and d.n between c.n - 6 and c.n - 1) as caused_by from o c
      where c.role = 'user' and {_has('c.text', P.CORRECTION_OPENER)}""",
    "security_gate": f"""{T_SQL}, x as (select *, {_case('command', P.RISKY_COMMAND)} as risk, {_case('file', P.SURFACE)} as surface from t),
      g as (select *, coalesce(max((risk is not null)::int) over (partition by tree order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 1 as after from x)
      select tree, surface, count(*) as touches, count(*) filter (after) as after_risk from g where surface is not null group by all""",
    "risky_commands": f"{T_SQL}, x as (select tree, {_case('command', P.RISKY_COMMAND)} as risk from t) select tree, risk, count(*) as n from x where risk is not null group by all",
    "test_skips": f"{T_SQL} select tree, count(*) as n from t where length(text) <= 4000 and {_has('text', P.TEST_SKIP)} group by tree",
    "secret_findings": f"{_PLANTED} select doc_id, rule, severity, sha256(match) as match_sha256, count(*) as n from x_found group by all",
    "secret_spans": f"{_PLANTED} select doc_id, rule, s::bigint as start_at, e::bigint as end_at, git as commit, sha256(match) as match_sha256 from x_found",
    "secret_decisions": f"""{_PLANTED}, d as (select match, count(*) as n, min({_RANK}) as worst, arg_min(rule, ({_RANK}, rule)) as rule, bool_or(git) as git from x_found group by match)
      select sha256(match) as match_sha256, n, case when git and worst > 0 then 'git-commit-sha' else rule end as rule, case when git and worst > 0 then 'keep' else 'redact' end as action from d""",
    "redacted_texts": f"with p as ({PLANTED_SQL}), {secret_sql.masked('p', 'a', True)}, {secret_sql.masked('a', 'b', False)} select doc_id, sha256(text) as sha256 from b",
    "masked_fields": f"with f as ({FIELDS_SQL}), {secret_sql.masked_everywhere('f', 'a')}, {secret_sql.masked('a', 'b', False)} select doc_id // 3 as event_id, doc_id % 3 as seq, sha256(text) as sha256 from b",
    "turns_refolded": f"""with recursive u as (select tree, event_id, row_number() over (partition by tree order by ts, event_id) as n, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as plain, {NUDGE_SQL} as nudge,
        (len(string_split_regex(trim(text), '\\s+')) <= 6 and {_has('text', P.IGNORE)}) as ign from ({REPEATED_SQL})),
      w as (select tree, 0::bigint as n, null::bigint as node, '' as node_text, '' as before, '' as what from (select distinct tree from u) union all
        select tree, n, case when what = 'node' then event_id else node end, case when what in ('node', 'rerun', 'longer') then text else node_text end, case when what in ('node', 'rerun', 'longer') then plain else before end, what from (
          select u.tree, u.n, u.event_id, u.text, u.plain, w.node, w.node_text, w.before, case when node is not null and (before = plain or (least(length(before), length(plain)) >= 24 and
            starts_with(case when length(before) <= length(plain) then plain else before end, case when length(before) <= length(plain) then left(before, length(before) - 4) else left(plain, length(plain) - 4) end)))
              then case when length(u.text) > length(node_text) then 'longer' else 'repeat' end
            when node is not null and least(length(before), length(plain)) >= 40 and before[:24] = plain[:24] and ((starts_with(before, '/') and before[:32] = plain[:32]) or
              len(list_filter(range(1, least(length(before), length(plain)) + 1), lambda k: before[:k] = plain[:k])) / least(length(before), length(plain)) >= 0.5) then 'rerun'
            when node is not null and nudge then 'nudge' when ign then 'ignored' else 'node' end as what from w join u on u.tree = w.tree and u.n = w.n + 1))
      select tree, node as event_id, sha256(arg_max(node_text, n)) as sha256, count(*) filter (what = 'nudge') as nudges, count(*) filter (what in ('repeat', 'longer')) as repeats, count(*) filter (what = 'rerun') as reruns from w where node is not null group by tree, node""",
    "token_entropy": """with k as (select distinct doc_id, unnest(regexp_extract_all(text, '[0-9a-z]{24,64}')) as token from documents), c as (select doc_id, token, unnest(string_split(token, '')) as ch from k),
      n as (select doc_id, token, ch, count(*) as m from c group by all) select doc_id, token, round(-sum(m / length(token) * log2(m / length(token))), 6) as entropy from n group by all""",
    "titles": """with o as (select conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as s from conversations) select conv_id, turn, case when length(s) <= 96 then s else rtrim(substr(s, 1, 95)) || '...' end as title from o""",
    "main_paths": f"{FOREST_SQL} select tree, node from main",
    "branch_status": f"{FOREST_SQL} select tree, node, status from s",
    "abandoned_branches": f"{FOREST_SQL} select a.tree, count(*) as n from s a left join s b on b.tree = a.tree and b.node = a.parent where a.status = 'abandoned' and (b.status is null or b.status <> 'abandoned') group by a.tree",
    "subtree_sizes": f"{FOREST_SQL} select n.tree, n.node, (select count(*) from up where up.tree = n.tree and up.ancestor = n.node) + 1 as size from n",
    "tree_outlines": f"""{FOREST_SQL}, z as (select n.*, (select count(*) from up where up.tree = n.tree and up.ancestor = n.node) + 1 as size from n),
      o as (select tree, node, coalesce(sum(size) over (partition by tree, parent order by node rows between unbounded preceding and 1 preceding), 0) + (parent is not null)::int as step,
        (parent is not null and count(*) over (partition by tree, parent) > 1)::int as deeper from z),
      a as (select tree, node, ancestor from up union all select tree, node, node from n)
      select a.tree, a.node, sum(o.step)::bigint as place, sum(o.deeper)::bigint as depth from a join o on o.tree = a.tree and o.node = a.ancestor group by all""",
    "missing_files": f"""{T_SQL}, r as (select tree, event_id, unnest(regexp_extract_all(substr(text, 1, 20000), '(?:^|[^A-Za-z0-9_./-])((?:\\.{{0,2}}/)?[A-Za-z0-9_-][A-Za-z0-9_./-]*\\.(?:{'|'.join(references.EXTENSIONS)}))\\b', 1)) as ref from t),
      f as (select tree, regexp_replace(lower(ref), '^\\./', '') as ref, min(event_id) as first_ord from r group by all), e as (select unnest([{', '.join(_quoted(f.lower()) for f in FILES)}]) as p),
      c as (select tree, lower(file) as p from t where event_id % 40 = 7)
      select tree, ref, first_ord from f where ref not in (select p from e union select split_part(p, '/', -1) from e) and not exists (select 1 from c where c.tree = f.tree and (c.p = f.ref or split_part(c.p, '/', -1) = f.ref))""",
    "constraint_ranking": _constraint_sql(),
    "shared_words": """with w as (select distinct conv_id as tree, turn as ord, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{4,}')) as w from conversations)
      select a.tree, a.ord as a, b.ord as b, count(*) as shared from w a join w b on a.tree = b.tree and a.w = b.w and a.ord between b.ord - 2 and b.ord - 1 group by all having count(*) >= 3""",
    "model_totals": f"{T_SQL} select model, count(*)::bigint as turns, sum(input_tokens)::bigint as input_tokens from t group by rollup (model)",
    "props_fields": "select event_id, len(json_keys(props))::bigint as n_keys, sha256(props) as sha256 from events",
    "latest_turn": f"{T_SQL} select tree, arg_max(event_id, (ts, event_id)) as event_id from t group by tree",
}
