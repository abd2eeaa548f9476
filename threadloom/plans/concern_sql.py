"""Actions that touch what matters for security, made from the events table by a fixed rule, and SQL for the concerns they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import security as S
from ..functions import text as T
from ..operators import concerns, evidence, sequence
from ..shared import spread
from . import analysis
from .synthetic import _list, turns

SAID = (
    "Set up the export job for the nightly report.", "Never commit the api key, rotate that key now.", "No, that is wrong. Read the key from an env var instead.", "Now write the summary of the weekly report.", "Looks good, thanks.",
    "Don't leak the token in the log output of the export job.", "Move that password into the secret manager.", "What does the login guard do?", "Also add a retry to the client of the export job.", "Revoke the exposed token and use workload identity.",
    "Make the migration additive, keep the old rows.", "That helper in src/auth/login.ts is broken.", "Keep the nightly report small and quick.",
    "Still failing, the same error again in the export job.", "wtf this sucks", "No, that's not what I meant, you built the wrong thing.", "way too heavy, you massively overbuilt the client",
)
ACTS = (
    "ls -la", "export STRIPE_API_KEY=abc", "curl -H 'x: y' https://example.com", "chmod 777 run.sh", "git push --force", "echo done", "deploy --acl public-read", "terraform apply", "node build.js", "psql -c 'GRANT ALL ON t TO PUBLIC'", "npm test",
)
INPUTS = (
    "", "token = Ab9-xyzzy-77", "password: changeme", "default = \"Prod-Master-Pw-2024!x\"", "sk_live_abcdef0123456789", "verify=False", "rbac rules", "key: [REDACTED:jwt]", "hash = 0123456789abcdef0123456789abcdef", "plain words only", "api_key='aaaaaaaaaaaa'", "image: registry.local/App:1.2", "DB_PASSWORD=\"hunter2-prod-Sup3r\" # x",
)
NARRATIONS = (
    "I will run the build.", "I'll log the full Authorization header with the bearer token. Then run it.", "I removed the secret from the log; it is masked now.", "", "Printing the signing key to check it!", "The jwt is echoed on start\nas a check.", "Reading the notes.",
)
PATHS = ("src/auth/login.ts", "SRC\\Auth\\\\Login.ts", ".env.production", "infra/variables.tf", "charts/values-prod.yaml", "src/tokens.json", "docs/notes.md", "", "src//auth/login.ts", "src/report.py", "Dockerfile", "src/job.py", "lib/rbac_guard.py", "web/page.html", "src/retry.py")

#: Rejections of every sixth turn.
KINDS = ("user_declined_tool", "permission_denied", "model_refusal", "user_text_decline", "strange", "tool_execution_error")
SURE = (1.0, 0.85, 0.9, 0.8, 0.5, 0.7)


def secured_rejections(nodes: DataFrame) -> DataFrame:
    return nodes.filter("event_id % 6 = 0").select("tree", "ord", _pick(KINDS, "event_id div 6").alias("kind"), _pick(SURE, "event_id div 6").alias("confidence"))


def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.expr(key), F.lit(len(values))) + 1).cast("int"))


def secured_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = spread(turns(spark, sf_dir).filter("role = 'user'").select("tree", "ts", "event_id"), "tree")
    own = sequence.numbered(each, ["tree"], ["ts", "event_id"], "ord").withColumn("text", _pick(SAID, "event_id"))
    paths = F.array(_pick(PATHS, "event_id div 2"), _pick(PATHS, "event_id div 5"))
    return own.select(
        "tree", F.col("ord").cast("long").alias("ord"), "event_id", "text", T.turn_kind(F.col("text"), F.col("ord") == 1).alias("kind"), F.when(F.expr("event_id % 13 = 0"), "abandoned").otherwise("accepted").alias("status"),
        F.filter(paths, lambda p: p != "").alias("files"), _pick(NARRATIONS, "event_id div 3").alias("narration"),
    )


def secured_actions(nodes: DataFrame) -> DataFrame:
    """Two actions of each turn, and none of every fourth."""
    pick = lambda values, a, b: F.when(F.col("seq") == 0, _pick(values, f"event_id div {a}")).otherwise(_pick(values, f"event_id div {b}"))
    each = nodes.filter("event_id % 4 <> 3").withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1))))
    return each.select("tree", "ord", "seq", pick(PATHS, 2, 5).alias("file"), pick(ACTS, 1, 4).alias("command"), pick(INPUTS, 3, 2).alias("input"), F.when(F.col("seq") == 0, F.col("narration")).otherwise("").alias("narration"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _at(values, key) -> str:
    return f"list_extract({_list(values)}, ({key} % {len(values)} + 1)::int)"


def _has(column: str, pattern: str, flag: str = "i") -> str:
    return f"coalesce(regexp_matches({column}, {_q(pattern)}, '{flag}'), false)"


def _case(column: str, named) -> str:
    return "case " + " ".join(f"when {_has(column, p)} then '{n}'" for n, p in named) + " end"


def _value(body: str, lead: str, least: int) -> str:
    return "trim(" + " || ".join(f"regexp_extract({body}, {_q(S.value_pattern(lead, least))}, {i}, 'i')" for i in (1, 2, 3)) + ")"


def _entropy(value: str) -> str:
    return f"list_sum(list_transform(list_distinct(string_split({value}, '')), lambda c: -(len({value}) - len(replace({value}, c, ''))) / len({value}) * log2((len({value}) - len(replace({value}, c, ''))) / len({value}))))"


def _cut(text: str, n: int) -> str:
    one = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"case when length({one}) <= {n} then {one} else rtrim(substr({one}, 1, {n - 1})) || '...' end"


_TOUCH = ", ".join(
    f"case when {met} then {{'late': {min(i, 1)}, 'seq': seq, 'rank': {i}, 'kind': '{kind}', 'strong': {strong}, 'weak': {weak}, 'evidence': {'clause' if i == 0 else 'shown'}, 'file': file, 'said': {chr(39).join(['clause || ', ' ', ' || body']) if i == 0 else 'body'}}} end"
    for i, (kind, met, strong, weak) in enumerate((
        ("credential-mishandling", "clause is not null", "true", "false"),
        ("credential", f"({_has('body', S.SECRET_CONTENT)} or masked or given or config)", "true", "false"),
        ("file", "cfile", "true", "false"), ("access-control", "opened", "true", "false"), ("risky-command", f"({_case('command', P.RISKY_COMMAND)}) is not null", "false", "false"),
        ("access-control", f"(not opened and {_has('body', S.ACCESS_WEAK)})", "false", "true"), ("safety-gate-weakening", f"({_has('body', S.GATE_OFF)} or {_has('body', S.GUARD_OUT)})", "false", "true"),
    ))
)
_MIXED = "(regexp_matches(cv, '[-_.:/+!@#$%^&*]') or (regexp_matches(cv, '[a-z]') and regexp_matches(cv, '[A-Z]')))"
_OPENED = " or ".join(_has("body", p) for p in (S.ACCESS_CONTENT, *(p for _, p in S.PUBLIC)))
_MASKED_RE = r"\[REDACTED:(?:" + "|".join(S.MASKED) + r")\]"
_SIGNALS = ", ".join(f"case when len(list_filter(acts, lambda a: a.kind = '{k}' and a.strong = {str(strong).lower()})) > 0 then '{name}' end" for k, strong, name in concerns.SIGNALS)
_KEYED = f"{_has('a.file', S.CREDENTIAL_FILE)} and not {_has('a.file', S.NOT_CREDENTIAL_FILE)} or ({_case('a.file', P.SURFACE)}) is not null"
_CLAUSES = f"list_filter(string_split_regex(coalesce(narration, '') || ' ' || body, {_q(S.CLAUSE_ENDS)}), lambda c: {_has('c', S.CREDENTIAL_NOUN)} and {_has('c', S.SINK_VERB)} and not {_has('c', S.REMEDIATION)})"

#: nd (turns) and ac (actions) from u, the users' turns with n.
ROWS = f"""nd as (select *, list_filter([{_at(PATHS, '(event_id // 2)')}, {_at(PATHS, '(event_id // 5)')}], lambda p: p <> '') as files from
    (select tree, n as ord, event_id, text, kind, case when event_id % 13 = 0 then 'abandoned' else 'accepted' end as status, {_at(NARRATIONS, '(event_id // 3)')} as narration from k)),
  ac as (select tree, ord, seq, case seq when 0 then {_at(PATHS, '(event_id // 2)')} else {_at(PATHS, '(event_id // 5)')} end as file, case seq when 0 then {_at(ACTS, 'event_id')} else {_at(ACTS, '(event_id // 4)')} end as command,
    case seq when 0 then {_at(INPUTS, '(event_id // 3)')} else {_at(INPUTS, '(event_id // 2)')} end as input, case seq when 0 then narration else '' end as narration from nd, (select unnest([0, 1]) as seq) where event_id % 4 <> 3)"""

#: tu: what each turn touches.
TOUCHING = f"""b0 as (select *, command || ' ' || input as body, coalesce(nullif(file, ''), nullif(command, ''), nullif(input, ''), '') as shown, {_case('file', P.SURFACE)} as sf, {_has('file', S.CREDENTIAL_FILE)} and not {_has('file', S.NOT_CREDENTIAL_FILE)} as cfile from ac),
  b1 as (select *, trim(regexp_replace({_CLAUSES}[1], '\\s+', ' ', 'g')) as clause, {_value('body', S.KEYED, 8)} as kv, {_value('body', S.NAMED, 12)} as cv, ({_OPENED}) as opened, regexp_matches(body, {_q(_MASKED_RE)}) or regexp_matches(body, {_q(S.VENDOR_TOKEN)}) as masked from b0),
  b2 as (select *, coalesce(length(kv) >= 8 and not {_has('kv', S.PLACEHOLDER)} and {_entropy('kv')} >= 2.5 and regexp_matches(kv, '[A-Za-z]') and regexp_matches(kv, '[0-9!@#$%^&*_-]'), false) as given,
    coalesce(sf in ('secrets', 'deployment', 'ci') and {_has('file', S.CONFIG_PATH)} and length(cv) >= 12 and not {_has('cv', S.PLACEHOLDER)} and not regexp_matches(cv, {_q(S.HEX_DIGEST)}) and not regexp_matches(cv, {_q(S.BASE64_BLOB)}) and {_entropy('cv')} >= 3.0 and {_MIXED}, false) as config from b1),
  b3 as (select tree, ord, seq, sf, list_filter([{_TOUCH}], lambda x: x is not null) as a from b2),
  b4 as (select tree, ord, list_sort(flatten(list(a))) as l, arg_min(sf, seq) filter (sf is not null) as surface from b3 group by all),
  b5 as (select tree, ord, surface, list_filter(l, lambda a, i: i = 1 or a.kind <> 'credential-mishandling') as acts from b4 where len(l) > 0),
  b6 as (select *, list_filter(list_transform(acts, lambda a: {{'file': a.file, 'strong': a.strong, 'keyed': {_KEYED}}}), lambda x: x.keyed) as fs, array_to_string(list_transform(acts, lambda a: a.said), ' ') as said from b5),
  tu as (select *, regexp_replace(replace(lower(coalesce(list_filter(fs, lambda x: x.strong)[1].file, fs[1].file)), chr(92), '/'), '/+', '/', 'g') as key, case when len(fs) = 0 then {_case('said', S.STEMS)} end as stem from b6)"""

#: sh: what each turn has to share.
SHARED = f"""sh as (select tree, ord, status, kind, text, list_distinct(files) as files, list_distinct(list_filter(list_transform(files, lambda f: lower(regexp_extract(f, '([^\\\\/]*)$', 1))), lambda f: length(f) >= 4)) as bases, lower(text) as low,
    list_filter(list_distinct(regexp_extract_all(lower(text || ' ' || array_to_string(list_transform(files, lambda f: regexp_replace(f, '[\\\\/.+_-]+', ' ', 'g')), ' ') || ' ' || narration), '[a-z][a-z0-9_-]{{2,}}')), lambda w: not list_contains({_list(evidence.STOP_WORDS)}, w)) as words from nd)"""
MEET = f"""(list_has_any(a.files, b.files) or len(list_filter(a.bases, lambda x: contains(b.low, x))) > 0 or len(list_filter(b.bases, lambda x: contains(a.low, x))) > 0
    or list_has_any(list_intersect(a.words, {_list(evidence.SURFACE_WORDS)}), b.words) or len(list_intersect(a.words, b.words)) >= 3)"""
CONTENT = ", ".join(_q(k) for k in concerns.CONTENT)
IS_CORRECTION = f"(length({{0}}) <= 4000 and {_has('{0}', S.CORRECTION.replace('{', '{{').replace('}', '}}'))})"
HUMAN = IS_CORRECTION.format("text")
_ANY_REMEDY = "(" + " or ".join(_has("text", p) for p, _ in P.REMEDIES) + ")"

CONCERNS = f"""{TOUCHING}, {SHARED},
  w0 as (select nd.tree, nd.ord, nd.kind, tu.acts, surface, key, stem, acts is not null and len(list_filter(acts, lambda a: a.kind not in ('file', 'risky-command'))) = 0 as named,
    coalesce(len(list_filter(acts, lambda a: a.kind in ({CONTENT}))) > 0, false) or {HUMAN} as sure from nd left join tu using (tree, ord)),
  w1 as (select *, coalesce(bool_or(named) over p, false) as had, coalesce(bool_or(sure) over p, false) as knew from w0 window p as (partition by tree order by ord rows between unbounded preceding and 1 preceding)),
  w2 as (select * from w1 where acts is not null and not (named and had and knew)),
  hc as (select * from sh where status <> 'abandoned' and {HUMAN}),
  w3 as (select w2.*, kind <> 'correction' and exists (select 1 from hc b, sh a where a.tree = w2.tree and a.ord = w2.ord and b.tree = w2.tree and b.ord > w2.ord and {MEET}) as human from w2),
  w4 as (select *, list_filter([{_SIGNALS}, case when surface is not null then 'security surface (' || surface || ')' end, case when human then 'human security correction' end], lambda x: x is not null) as signals,
    len(list_filter(acts, lambda a: a.strong)) > 0 as strong, len(list_filter(acts, lambda a: a.weak)) > 0 as weak, len(list_filter(acts, lambda a: a.kind = 'risky-command')) > 0 as risky from w3),
  w5 as (select *, case when strong then 'verified' when weak and surface is null and not human and not risky then 'inferred' else 'high' end as tier from w4),
  w6 as (select *, least(case tier when 'verified' then 0.95 when 'high' then 0.9 else 0.7 end, round(case tier when 'verified' then 0.95 when 'high' then 0.84 else 0.62 end + greatest(0, len(signals) - 1) * 0.02, 2))::double as confidence,
    list_transform(acts, lambda a: a.kind) as ks, list_transform(acts, lambda a: a.evidence) as es, coalesce('f:' || key, 's:' || stem, 't:' || ord) as about from w5),
  w7 as (select *, list_filter(ks, lambda x, i: list_position(ks, x) = i) as kinds, list_filter(es, lambda x, i: list_position(es, x) = i)[1:3] as shown from w6),
  w8 as (select *, 'Agent action touched ' || array_to_string(kinds, ', ') || ' [signals: ' || array_to_string(signals, '; ') || ']: ' || array_to_string(list_transform(shown, lambda t: '"' || {_cut('t', 80)} || '"'), ', ') as evidence from w7),
  c0 as (select tree, about, min(ord) as ord, max(confidence) as confidence, arg_max(tier, case tier when 'verified' then 4 when 'high' then 3 else 1 end) as tier, count(*) as turns, arg_min(kind, ord) as kind, min(key) as key, min(stem) as stem,
    array_to_string(arg_min(kinds, ord), ',') as kinds, arg_min(evidence, ord) as evidence from w8 group by tree, about)"""
QUERY = f"""{CONCERNS}, lv as (select *, row_number() over (partition by tree order by ord) as r from sh where status <> 'abandoned'),
  c1 as (select c0.*, case when c0.kind <> 'correction' then (select min(b.ord) from lv b, sh a where a.tree = c0.tree and a.ord = c0.ord and b.tree = c0.tree and b.ord > c0.ord and b.kind = 'correction' and {MEET}) end as corrector from c0),
  c2 as (select c1.*, coalesce((select min(b.ord) from lv b, sh a where a.tree = c1.tree and a.ord = c1.ord and b.tree = c1.tree and b.ord > c1.ord and {MEET}),
    (select min(b.ord) from lv b where b.tree = c1.tree and b.ord > c1.ord and {_has('b.text', evidence.ACCEPTANCE)})) as resolved, (select count(*) from lv b where b.tree = c1.tree and b.ord <= c1.ord) as own from c1)
  select tree, ord, tier, confidence, turns, key, stem, kinds, evidence, corrector, resolved, coalesce((select string_agg(text, ' ' order by ord) from lv b where b.tree = c2.tree and b.r between own + 1 and own + 12 and (c2.corrector is null or b.ord <> c2.corrector) and {_ANY_REMEDY}), '') as remedies from c2"""

_STRONG = " or ".join(f"sig.type = '{n}' and {_has('sig.text', p)}" for n, p in analysis.STRONG)
_ANALYZED = " or ".join(("nd.kind = 'correction'", *(_has("nd.text", p) for p in (P.CORRECTING, next(p for n, p, _ in P.PROCESS if n == "user_frustration"), P.PRIVACY))))
_FAILURE_OF = "case rk " + " ".join(f"when '{k}' then '{t}'" for k, t in P.FAILURE_OF.items()) + " end"
_TIER = "case " + " ".join(f"when conf >= {least} then '{name}'" for least, name in P.TIERS) + " else 'inferred' end"
_LOST, _BACK = _has("text", S.DESTRUCTIVE), _has("text", S.RECOVERY)
_NARRATES = "len(list_filter(string_split_regex({0}, %s), lambda c: %s and %s and not %s)) > 0" % (_q(S.CLAUSE_ENDS), *(_has("c", p) for p in (S.NARRATED_INTENT, S.NARRATED_TARGET, S.REMEDIATION)))
_TOLD = _NARRATES.replace("{0}", "nd.narration")
_WRITTEN = _NARRATES.replace("{0}", "nd.text")
_MEANT = " or ".join(_has("nd.text", p) for n, p in P.SECURITY_INTENT if n != "email_change")
_RISK = "'security_or_privacy_risk'"


def failures_sql(signals: str) -> str:
    """SQL for the failures of all rules; signals makes sig, what went wrong by each turn's words."""
    return f"""{CONCERNS}{signals},
      rj as (select tree, ord, rk, conf, {_FAILURE_OF} as type, {_TIER} as tier from (select tree, ord, {_at(KINDS, '(event_id // 6)')} as rk, list_extract({list(SURE)}, (event_id // 6 % {len(SURE)} + 1)::int)::double as conf from nd where event_id % 6 = 0)),
      rf as (select tree, ord from rj where rk = 'model_refusal'), dc as (select tree, ord from rj where rk in ('user_declined_tool', 'user_text_decline')),
      q as (select nd.*, exists (select 1 from rf where rf.tree = nd.tree and rf.ord = nd.ord) as own, exists (select 1 from rf where rf.tree = nd.tree and rf.ord in (nd.ord, nd.ord - 1)) as near, exists (select 1 from dc where dc.tree = nd.tree and dc.ord = nd.ord) as complains from nd),
      lv as (select * from sh where status <> 'abandoned'),
      tg as (select nd.tree, nd.ord, (select max(b.ord) from lv b, sh a where a.tree = nd.tree and a.ord = nd.ord and b.tree = nd.tree and b.ord < nd.ord and {MEET}) as sem, (select max(b.ord) from lv b where b.tree = nd.tree and b.ord < nd.ord) as last from nd),
      e1 as (select tree, ord as seen, ord as node, case when kind <> 'correction' then (select min(b.ord) from lv b, sh a where a.tree = c0.tree and a.ord = c0.ord and b.tree = c0.tree and b.ord > c0.ord and b.kind = 'correction' and {MEET}) end as corrector, confidence, tier from c0
        union all select tree, ord, ord, null, {analysis.INTENT}, 'inferred' from q nd where not exists (select 1 from w2 where w2.tree = nd.tree and w2.ord = nd.ord) and (({_MEANT}) and not near or not own and ({_TOLD} and event_id % 4 <> 3 or not complains and not {HUMAN} and {_WRITTEN}))),
      hb as (select nd.tree, min(nd.ord) as ord, arg_min(coalesce(sem, last), nd.ord) as target from nd join tg using (tree, ord) where {HUMAN} and coalesce(sem, last) is not null group by nd.tree),
      sg as (select sig.*, nd.ord, nd.kind, coalesce(sem, last) as target, sem is not null as semantic, coalesce(sem, last) is not null and (nd.kind = 'correction' or sem is not null) as tied from sig join q nd on nd.tree = sig.tree and nd.ord = sig.n join tg on tg.tree = nd.tree and tg.ord = nd.ord
        where nd.status <> 'abandoned' and not near and ({_ANALYZED})),
      em as (select tree, ord as seen, 0 as part, type, ord as node, null as corrector, conf as confidence, tier, false as settle from rj where type is not null
        union all select tree, seen, 1, {_RISK}, node, corrector, confidence, tier, true from e1
        union all select tree, ord, 2, {_RISK}, target, ord, {analysis.BACKSTOP}, 'inferred', true from hb where not exists (select 1 from e1 where e1.tree = hb.tree and e1.seen <= hb.ord)
        union all select tree, ord, 3, 'abandoned_path', ord, null, {analysis.LEFT}, 'verified', true from nd where status = 'abandoned'
        union all select tree, ord, 4, 'abandoned_path', ord, null, case when {_LOST} and {_BACK} then 0.9 else 0.75 end, case when {_LOST} and {_BACK} then 'verified' else 'high' end, true from nd where status <> 'abandoned'
          and ({_LOST} or {_BACK} and {_has('text', S.APOLOGY)}) and not {_has('text', S.FIGURATIVE)} and not {_has('text', S.NOT_THE_AGENT)}
        union all select tree, ord, 5, type, case when tied then target else ord end, case when tied then ord end,
          least(case when tied then greatest(confidence, {analysis.CONFIRMED_LEAST}) else least(confidence, {analysis.INFERRED_MOST}) end, case when tied and semantic then 1.0 else {analysis.PLACED_MOST} end), case when tied and semantic then 'confirmed' else 'inferred' end, true from sg where tied or kind = 'correction'
        union all select tree, ord, 5, type, coalesce(target, ord), null, least(confidence, {analysis.BACKSTOP}), 'inferred', true from sg sig where not tied and kind <> 'correction' and ({_STRONG})),
      f0 as (select tree, type, node, max(confidence)::double as confidence, arg_max(tier, case tier when 'verified' then 4 when 'high' then 3 when 'confirmed' then 2 else 1 end) as tier, arg_min(corrector, (seen, part)) filter (corrector is not null) as corrector,
        arg_min(coalesce(corrector, -1), (seen, part)) as first, arg_min(settle, (seen, part)) as settle from em group by tree, type, node)
      select tree, type, node, confidence, tier, corrector, case when settle then coalesce((select min(b.ord) from lv b, sh a where a.tree = f0.tree and a.ord = f0.node and b.tree = f0.tree and b.ord <> f0.node and b.ord > case when first < 0 then f0.node else first end and {MEET}),
        (select min(b.ord) from lv b where b.tree = f0.tree and b.ord > case when first < 0 then f0.node else first end and {_has('b.text', evidence.ACCEPTANCE)})) end as resolved from f0"""
