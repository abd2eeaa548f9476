"""What a turn's text says, as expressions over columns: no Python runs for a row, and Catalyst sees every predicate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .spans import BLANKS, EDGE

#: A word's edge where a word begins: one look back, where EDGE takes up to four looks at each place of a text.
OPENING = r"(?<![A-Za-z0-9_])"
WORD_CLASS = r"\[(?:a-z|A-Z|0-9|[A-Za-z0-9_](?!-))+\]"


def _alternatives(pattern: str) -> list[str]:
    """A pattern's alternatives outside of its groups, up to the end of the group that it stands in."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(pattern) and depth >= 0:
        c = pattern[i]
        if c == "[":
            i += 2 if pattern[i + 1] == "^" else 1
            i += pattern[i] == "]"
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        depth += (c == "(") - (c == ")")
        if depth < 0 or (c == "|" and depth == 0):
            out.append(pattern[start:i])
            start = i + 1
        i += 2 if c == "\\" else 1
    return out if depth < 0 else [*out, pattern[start:]]


def _opens_word(pattern: str) -> bool:
    """Whether all that the pattern matches begins with an ASCII letter, a digit or _; false where that isn't plain to see."""
    head = re.match(r"\(\?:|\((?!\?)", pattern)
    if head:
        inner = _alternatives(pattern[head.end():])
        then = pattern[head.end() + sum(map(len, inner)) + len(inner):]
        return then[:1] not in ("?", "*", "{") and all(map(_opens_word, inner))
    first = re.match(rf"[A-Za-z0-9_]|{WORD_CLASS}", pattern)
    return first is not None and pattern[first.end():first.end() + 1] not in ("?", "*", "{")


def ascii_edges(pattern: str) -> str:
    r"""The pattern with \b over ASCII alone."""
    return re.sub(r"\\b", lambda m: OPENING if _opens_word(_alternatives(pattern[m.end():])[0]) else EDGE, pattern)


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found, in either case; false for null."""
    plain = ascii_edges(pattern)
    parts = _alternatives(plain)
    if len(parts) > 1 and all(p.startswith(OPENING) for p in parts):
        plain = OPENING + "(?:" + "|".join(p[len(OPENING):] for p in parts) + ")"
    return F.coalesce(text.rlike(f"(?i){plain}"), F.lit(False))


def first_match(text: Column, named: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first pattern that is found, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(named):
        out = F.when(matches(text, pattern), name).otherwise(out)
    return out


def turn_kind(text: Column, is_root: Column, redirects: Column | None = None) -> Column:
    """The kind of a user turn; the first rule that holds decides."""
    redirects = F.lit(False) if redirects is None else redirects
    return (
        F.when(is_root, "root")
        .when(redirects | matches(text, P.CORRECTION_OPENER) | matches(text, P.CORRECTION_ANYWHERE), "correction")
        .when(matches(text, P.SCOPE), "scope-change")
        .when(matches(text, P.CHECKPOINT), "checkpoint")
        .when(matches(text, P.CORRECTION_SOFT_OPENER), "correction")
        .when(matches(text, P.QUESTION) & (F.length(text) < 250), "question")
        .otherwise("direction")
    )


def is_nudge(text: Column) -> Column:
    """At most four words that say no more than to go on."""
    return (F.size(F.split(F.trim(text), r"\s+")) <= 4) & matches(text, P.CONTINUATION)


def is_ignored(text: Column) -> Column:
    """At most six words that ask to ignore them."""
    return (F.size(F.split(F.trim(text), r"\s+")) <= 6) & matches(text, P.IGNORE)


def chosen_option(text: Column) -> Column:
    """The option, in capitals, that a turn of nothing else chooses from a menu, else null."""
    return F.when(matches(text, P.SELECTION), F.upper(F.regexp_extract(text, f"(?i){P.SELECTION}", 1)))


def is_refusal(text: Column) -> Column:
    """A model's refusal; a promise not to touch something is none, unless it also says that it can't."""
    return (F.length(text) <= 4000) & matches(text, P.REFUSAL) & (~matches(text, P.COMPLIANT) | matches(text, P.HARD_REFUSAL))


def is_decline(text: Column) -> Column:
    """A user's short text that starts by turning down what was done, interjections aside."""
    core = F.regexp_replace(text, f"(?i){ascii_edges(P.INTERJECTION)}", "")
    return (F.length(text) <= 240) & ~matches(core, P.BENIGN_DECLINE) & matches(core, P.DECLINE)


def tool_rejection(result: Column) -> Column:
    """A struct of kind and confidence for the text of a failed tool's result."""
    kind = F.when(F.coalesce(result, F.lit("")) == "", "tool_execution_error").when(matches(result, P.USER_DECLINED_TOOL), "user_declined_tool").when(matches(result, P.PERMISSION_DENIED), "permission_denied").otherwise("tool_execution_error")
    confidence = F.when(F.coalesce(result, F.lit("")) == "", 0.85).when(kind == "user_declined_tool", 1.0).when(kind == "permission_denied", 0.85).otherwise(0.9)
    return F.struct(kind.alias("kind"), confidence.alias("confidence"))


def tier(confidence: Column) -> Column:
    out = F.lit("inferred")
    for least, name in reversed(P.TIERS):
        out = F.when(confidence >= least, name).otherwise(out)
    return out


def failure_type(kind: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in P.FAILURE_OF.items() for x in pair))[kind]


def relationship(kind: Column) -> Column:
    """How a node relates to its parent."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in P.RELATIONSHIP.items() for x in pair))[kind], F.lit("refines"))


def truncate(text: Column, n: int = 80) -> Column:
    """White space collapsed; a longer text is cut to n - 1 characters, right-trimmed, and gets three dots."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " "))
    return F.when(F.length(one) <= n, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, n - 1)), F.lit("...")))


def title(text: Column) -> Column:
    """The first sentence of the first line that isn't blank, truncated."""
    line = F.regexp_extract(text, r"(?m)^(.*\S.*)$", 1)
    return truncate(F.element_at(F.split(F.when(line == "", text).otherwise(line), r"(?<=[.!?])\s+"), 1), 96)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character: letters sorted, each run's length counted in one pass."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    weight = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)
    step = lambda a, c: F.when(a["c"] == c, F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))).otherwise(F.struct(c.alias("c"), F.lit(1).cast("long").alias("n"), (a["s"] + weight(a["n"])).alias("s")))
    letters = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(letters, start, step, lambda a: F.log2(F.length(text)) - (a["s"] + weight(a["n"])) / F.length(text))


def risky_command(command: Column) -> Column:
    """The first risky pattern that a command has, else null."""
    return first_match(command, P.RISKY_COMMAND)


def security_surface(path: Column) -> Column:
    """The first surface that a file belongs to, else null."""
    return first_match(path, P.SURFACE)


def skips_tests(text: Column) -> Column:
    return (F.length(text) <= 4000) & matches(text, P.TEST_SKIP)


def words(text: Column, least: int = 4) -> Column:
    """The distinct lower-case words of at least so many letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0)))


def shell_paths(command: Column) -> Column:
    """Distinct path arguments that start with /, ./ or ../."""
    return F.array_distinct(F.regexp_extract_all(command, F.lit(r"(?:^|\s)((?:\.{0,2}/)[A-Za-z0-9_./-]*[A-Za-z0-9_.-])(?=\s|$)"), F.lit(1)))


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def process_signals(text: Column, kind: Column, prior_tokens: Column | None = None, most: int = 2) -> Column:
    """What went wrong by a turn's text: an array of (type, confidence, lesson), the first of them by priority.

    Long texts count only in corrections. Parts that are to be removed as surplus, and that are among the words of the turn
    before (prior_tokens), are a drift of scope without a lesson; a misunderstood goal counts where nothing else is found.
    """
    prior = F.array().cast("array<string>") if prior_tokens is None else F.coalesce(prior_tokens, F.array().cast("array<string>"))
    removed = F.lower(F.regexp_extract(text, f"(?i){ascii_edges(P.REMOVED)}", 1))
    surplus = matches(text, P.SURPLUS) & (removed != "") & F.array_contains(prior, removed)

    def found(name: str, pattern: str, confidence: float) -> Column:
        yes, sure, lesson = matches(text, pattern), F.lit(confidence), F.lit(True)
        if name == "scope_drift":
            yes, sure, lesson = yes | surplus, F.when(matches(text, pattern), 0.82).otherwise(0.8), ~surplus
        if name == "overbuilt_solution":
            yes = yes & ~surplus
        return F.when(yes, F.struct(F.lit(name).alias("type"), sure.alias("confidence"), lesson.alias("lesson")))

    listed = F.array_compact(F.array(*(found(*rule) for rule in P.PROCESS)))
    goal = (kind == "correction") & matches(text, P.MISUNDERSTOOD) & ~matches(text, P.REVERSAL)
    one = F.array(F.struct(F.lit("misunderstood_goal").alias("type"), F.lit(0.62).alias("confidence"), F.lit(True).alias("lesson")))
    none = F.filter(one, lambda x: F.lit(False))
    every = F.when(F.size(listed) > 0, F.slice(listed, 1, most)).when(goal, one).otherwise(none)
    return F.when((kind != "correction") & (F.length(text) > 1200), none).otherwise(F.coalesce(every, none))


def security_intent(text: Column) -> Column:
    """The first wording of a security task in a text of at most 1,200 letters, else null."""
    return F.when(F.length(text) <= 1200, first_match(text, P.SECURITY_INTENT))


def is_analyzed(text: Column, kind: Column) -> Column:
    """Whether a turn is looked at for failures: a correction, or a text that corrects, complains or speaks of privacy."""
    frustration = next(p for n, p, _ in P.PROCESS if n == "user_frustration")
    return (kind == "correction") | matches(text, P.CORRECTING) | matches(text, frustration) | matches(text, P.PRIVACY)


def quote(text: Column) -> Column:
    """Truncated to 240, with quotation marks escaped."""
    return F.replace(truncate(text, 240), F.lit('"'), F.lit('\\"'))


def _by_type(kind: Column, values: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[kind], otherwise)


def failure_summary(kind: Column, title: Column, corrected_title: Column, corrected_text: Column) -> Column:
    """One sentence on a failure at the turn of that title, and on the turn that corrected it, if any (a null title for none)."""
    at = F.concat(F.lit('"'), truncate(F.coalesce(title, F.lit("a previous direction")), 90), F.lit('"'))
    by = F.concat(F.lit('; corrected by "'), truncate(corrected_title, 90), F.lit('".'))
    whole = F.concat(F.lit('; corrected by: "'), quote(corrected_text), F.lit('".'))
    name = F.replace(kind, F.lit("_"), F.lit(" "))
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    open_ended = F.when(kind == "security_or_privacy_risk", say("A privacy or security boundary was stated as a requirement at ", at, ".")).when(kind == "scope_drift", say("A scope boundary was stated at ", at, ".")).when(kind == "format_violation", say("A required output format was stated at ", at, ".")).otherwise(say("A ", name, " concern was raised at ", at, "."))
    corrected = (
        F.when(kind == "ignored_constraint", say("A prior direction appears to have ignored a user constraint near ", at, by))
        .when(kind == "scope_drift", say("The session drifted from the intended scope near ", at, whole))
        .when(kind == "misunderstood_goal", say("The agent appears to have misunderstood the goal near ", at, whole))
        .when(kind == "overbuilt_solution", say("The work appears to have overbuilt the requested shape near ", at, by))
        .when(kind == "underbuilt_solution", say("The work appears to have underbuilt or skipped expected scope near ", at, by))
        .when(kind == "security_or_privacy_risk", say("A privacy or security boundary became important near ", at, F.replace(by, F.lit("corrected"), F.lit("reinforced"))))
        .when(kind == "user_frustration", say("User frustration signaled that the prior path near ", at, " was not meeting expectations."))
        .when(kind == "repeated_failed_fix", say("A fix loop appears to have repeated near ", at, by))
        .otherwise(say("A possible ", name, " occurred near ", at, by))
    )
    return F.when(corrected_title.isNull(), open_ended).otherwise(corrected)


def lesson_title(kind: Column) -> Column:
    return _by_type(kind, {k: v[0] for k, v in P.LESSONS.items()}, F.lit("Preserve the correction"))


def lesson_text(kind: Column, evidence: Column, correction: Column) -> Column:
    """The guidance of a failure's type, with the correction's words, or else the evidence, up to 220 letters."""
    base = _by_type(kind, {k: v[1] for k, v in P.LESSONS.items()}, F.lit("Future agents should preserve this correction."))
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    fix, shown = plain(correction), F.when(plain(correction) != "", plain(correction)).otherwise(plain(evidence))
    lead = F.when(fix != "", "Specifically, the user directed").otherwise("Specifically")
    return F.when(shown != "", F.concat(base, F.lit(" "), lead, F.lit(": "), truncate(shown, 220))).otherwise(base)


def eval_type(kind: Column) -> Column:
    return _by_type(kind, P.EVAL_OF, F.lit("instruction_following_regression"))


def eval_task(kind: Column) -> Column:
    return _by_type(kind, P.TASK_OF, F.lit(P.COMMON_TASK))


def expected_behavior(kind: Column) -> Column:
    """An array of sentences."""
    common = F.array(*map(F.lit, P.COMMON_BEHAVIOR))
    out = common
    for name, own in P.BEHAVIOR_OF.items():
        out = F.when(kind == name, F.concat(F.array(*map(F.lit, own)), common)).otherwise(out)
    return out


def failure_mode(kind: Column) -> Column:
    return F.concat(F.lit("Agent repeats "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" despite prior correction."))


def rejection_summary(kind: Column, title: Column) -> Column:
    """One sentence on a rejection at the turn of that title."""
    lead = _by_type(kind, P.REJECTION_SUMMARY, F.concat(F.lit("A "), F.coalesce(F.when(kind != "", kind), F.lit("rejection")), F.lit(" was captured near")))
    return F.concat(lead, F.lit(' "'), truncate(F.coalesce(F.when(title != "", title), F.lit("a previous turn")), 90), F.lit('".'))


def rejection_title(kinds: Column) -> Column:
    """The title of a turn that has rejections but no text, from the kinds of them."""
    distinct = F.array_distinct(F.coalesce(kinds, F.array().cast("array<string>")))
    one = F.concat(F.lit("Agent action rejected ("), F.replace(F.try_element_at(distinct, F.lit(1)), F.lit("_"), F.lit(" ")), F.lit(")"))
    many = F.concat(F.lit("Agent action rejected ("), F.size(distinct).cast("string"), F.lit(" kinds)"))
    return F.when(F.size(distinct) == 0, "[agent action rejected]").when(F.size(distinct) == 1, one).otherwise(many)


def remedies(text: Column) -> Column:
    """The remedies that a text names, joined to one sentence; empty if it names none."""
    named = F.array_compact(F.array(*(F.when(matches(text, p), phrase) for p, phrase in P.REMEDIES)))
    return F.when(F.size(named) > 0, F.concat(F.array_join(named, "; "), F.lit("."))).otherwise("")
