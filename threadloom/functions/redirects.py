"""Whether a turn turns down or redirects what the agent did just before, told by what that was.

prior is an array of tokens: names of the files that the agent's last message touched and words of its narration
(action_tokens); goal is one of the session's first prompt (goal_tokens). All are column expressions.

Defined results: a null or blank text, or one beyond the stated length, is false; null arrays are empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import EDGE, ascii_edges, matches

# The patterns and words that decide.
REVERSAL_VERB = r"\b(?:stop|undo|revert|yank|rip|kill|scrap|nix|roll\s?back|back(?:\s+(?:it|that|this))?\s+out|take(?:\s+(?:it|that|this))?\s+out)\b"
BARE_STOP = r"^(?:stop|undo|revert|yank|nix|scrap|rip|kill|roll\s?back)\s*(?:it|that|this|the\b[^.]*)?[.!,;:\s]*$"
LEAD_IN = r"^(?:no|nope|ok|okay|please|hey|and|so|then|wait|hold on|also)\b[\s,]*$"
DEMONSTRATIVE = r"\b(?:that|this|those|these|it)\b"
DAMAGE_BY_AGENT = r"\byou\b[^.!?;]{0,40}\b(?:blew\s+away|blow\s+away|nuked?|wiped?|truncated?|dropped?|deleted?|destroyed?|clobbered?|ripped?\s+(?:out|away))\b|\b(?:that|this|the)\b[^.!?;]{0,30}\b(?:drop[\s-]?and[\s-]?recreate[d]?|blew\s+away|truncated?|wiped?)\b"
OTHER_WAY = r"\bnon[\s-]?destructive\b|\badditive\b|\binstead\b|\bstop\b|\bdon'?t\b[^.!?;]{0,30}\b(?:drop|truncate|wipe|recreate|delete|blow)\b|\bnever\b[^.!?;]{0,30}\b(?:drop|truncate|wipe|recreate|delete)\b|\bmake\b[^.!?;]{0,30}\b(?:migration|change|it)\b[^.!?;]{0,20}\b(?:additive|non[\s-]?destructive|safe)\b"
NEGATED = r",\s*not\b|\b(?:wanted|want|cared|care|asked|meant|need|needed|expected|after)\b[^.]{0,40}\bnot\b|\bnot\b[^.]{0,30}\b(?:but|instead)\b"
YOU_WRONG = r"\byou\s+(?:solved|built|did|made|gave|chose|used|wrote|created|went|took|picked|implemented|optimi[sz]ed|focused|targeted)\b[^.]{0,40}\bwrong\b"
WRONG_THING = r"\bwrong\s+(?:problem|thing|goal|approach|direction|track|path|idea|feature|task|tool|one|axis|shape)\b"
TAKE_OUT = r"\b(?:nix|scrap|revert|undo|yank)\b|\b(?:rip|tear|take|strip|pull|gut)\b[^.]{0,30}\bout\b"
PERMISSIVE = r"\b(?:feel free to|go ahead and|go ahead|you (?:can|could|may|might)|if you (?:want|like|prefer)|whenever you|happy for you to|fine to)\b"
SCOPE_AFFIRMED = r"\bi (?:just|only) (?:want|need|wanted|needed)\b|\bthat'?s all\b|\bjust (?:want|keep) (?:it|that)\b"
GOAL_FRAME = r"\bthat'?s not what i (?:asked|wanted|meant|said|requested)\b|\bthe whole point (?:is|was|of)\b|\bwhat i (?:actually|really) (?:wanted|asked|meant|need(?:ed)?)\b|\bmissed the (?:point|goal)\b|\bnot what i'?m after\b"
UNWILLING = r"\bi(?:'|’)?m\s+going\s+to\s+decline\b|\bi(?:'|’)?ll\s+decline\b|\bi\s+decline\s+(?:this|that|to)\b|\bi(?:'|’)?d\s+rather\s+not\b|\bi(?:'|’)?m\s+not\s+(?:comfortable|willing|going)\s+to?\b|\bthat(?:'|’)?s\s+not\s+something\s+i(?:'|’)?(?:ll|m)?\s*(?:can|will|would|want|going)\b|\bnot\s+something\s+i\s+can\s+help\s+with\b|\bcrosses\s+a\s+line\s+i\s+won(?:'|’)?t\s+cross\b|\bi(?:'|’)?m\s+not\s+going\s+to\s+(?:do|build|implement|write|add)\b"
#: Words that tie no turn to the one before.
COMMON = (
    "with", "into", "just", "back", "goal", "under", "over", "this", "that", "these", "those",
    "then", "than", "them", "they", "your", "have", "will", "from", "about", "across", "after",
    "approach", "instead", "reverting", "switching", "collapsing", "understood", "reorienting",
    "misread", "deleting", "returning", "added", "done", "made", "built", "rebuilt", "using",
    "thanks", "later", "minimize", "maximize", "target", "budget", "local", "bench",
)
#: Words that state no goal.
NO_GOAL = (
    "support", "update", "updates", "feature", "features", "system", "systems", "please", "should",
    "would", "could", "about", "these", "those", "their", "there", "which", "while", "where", "thing",
    "things", "something", "devices", "device", "images", "image", "field", "pull", "make", "build",
    "built", "using", "with", "from", "into", "over", "they", "them", "this", "that", "have", "need",
    "needs", "want", "wants", "when", "then", "than", "your", "each", "able", "code", "work", "works",
)


def _none() -> Column:
    return F.array().cast("array<string>")


def _words(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _core(text: Column) -> Column:
    """The text without blanks around it and interjections before it."""
    return _stripped(F.regexp_replace(_stripped(text), f"(?i){ascii_edges(P.INTERJECTION)}", ""))


def _within(text: Column, most: int, found: Column) -> Column:
    fits = (F.length(_stripped(text)) <= most) & (_stripped(text) != "")
    return F.coalesce(F.when(fits, found), F.lit(False))


def action_tokens(files: Column, narration: Column) -> Column:
    """Distinct tokens of four letters or more: files' names and the parts of their paths, and the narration's words; in lower case."""
    paths = F.transform(F.filter(F.coalesce(files, _none()), lambda f: f.isNotNull()), F.lower)
    names = F.transform(paths, lambda f: F.regexp_extract(f, r"([^\\/]*)\z", 1))
    parts = F.flatten(F.transform(paths, lambda f: F.split(f, r"[\\/.+_-]+")))
    said = F.regexp_extract_all(F.lower(F.coalesce(narration, F.lit(""))), F.lit(r"[a-z][a-z0-9_-]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(F.concat(names, parts, said), lambda t: F.length(t) >= 4))


def goal_tokens(text: Column) -> Column:
    """Distinct words of four letters or more that state a goal, and hyphenated phrases of six or more."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.array_except(F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9_-]{3,}"), F.lit(0)), _words(*NO_GOAL))
    phrases = F.filter(F.regexp_extract_all(low, F.lit(r"[a-z]{2,}(?:-[a-z]{2,})+"), F.lit(0)), lambda p: F.length(p) >= 6)
    return F.array_union(words, phrases)


def refers_back(text: Column, prior: Column) -> Column:
    """A word that points at what was done, or one of its tokens anywhere in the text."""
    return matches(text, DEMONSTRATIVE) | F.exists(F.coalesce(prior, _none()), lambda t: (F.length(t) >= 4) & F.contains(F.lower(text), t))


def names_one(text: Column, tokens: Column, but: tuple[str, ...] = ()) -> Column:
    """Whether the text has one of the tokens of four letters or more as a whole word, other than those of but."""
    low = F.lower(text)
    whole = lambda t: F.contains(low, t) & F.rlike(low, F.concat(F.lit(EDGE + r"\Q"), t, F.lit(r"\E" + EDGE)))
    own = F.filter(F.coalesce(tokens, _none()), lambda t: F.length(t) >= 4)
    return F.exists(F.array_except(own, _words(*but)) if but else own, whole)


def declines_action(text: Column, prior: Column) -> Column:
    """A short turn with a clause led by a verb of reversal that stands alone or refers back; or a complaint that the agent destroyed something, with another way to go."""

    def reverses(clause: Column) -> Column:
        verb = F.regexp_extract(clause, f"(?i){ascii_edges(REVERSAL_VERB)}", 0)
        place = F.instr(F.lower(clause), F.lower(verb))
        lead = F.regexp_replace(F.substr(clause, F.lit(1), place - 1), r"[,\s]+\z", "")
        leads = (lead == "") | matches(lead, LEAD_IN)
        return (verb != "") & leads & (matches(clause, BARE_STOP) | refers_back(F.substr(clause, place), prior))

    core = _core(text)
    clauses = F.transform(F.split(core, r"[.!?;\n]"), _stripped)
    damaged = matches(core, DAMAGE_BY_AGENT) & matches(core, OTHER_WAY) & refers_back(core, prior)
    return _within(text, 240, ~matches(core, P.BENIGN_DECLINE) & (F.exists(clauses, reverses) | damaged))


def redirects_action(text: Column, prior: Column) -> Column:
    """A turn that contradicts the agent's last action: it says that the agent did the wrong thing, or has a contrast or reversal and names what was touched."""
    core = _core(text)
    barred = matches(core, P.BENIGN_DECLINE) | matches(core, PERMISSIVE) | matches(core, SCOPE_AFFIRMED)
    cue = matches(core, NEGATED) | matches(core, WRONG_THING) | matches(core, TAKE_OUT)
    found = matches(core, YOU_WRONG) | (cue & names_one(core, prior, COMMON))
    return _within(text, 600, (F.size(F.coalesce(prior, _none())) > 0) & ~barred & found)


def takes_out(text: Column, prior: Column) -> Column:
    """A redirect that is a decline as well: a verb of reversal in a turn that names what was touched."""
    core = _core(text)
    return _within(text, 600, ~matches(core, P.BENIGN_DECLINE) & ~matches(core, PERMISSIVE) & matches(core, TAKE_OUT) & names_one(core, prior, COMMON))


def returns_to_goal(text: Column, goal: Column) -> Column:
    """A turn that says the goal was missed and names a token of it."""
    return _within(text, 600, matches(text, GOAL_FRAME) & names_one(text, goal))


def routed(text: Column, prior: Column, goal: Column) -> Column:
    """A struct: declined, whether the turn carries a decline of what was done, and redirects, whether it makes the turn a correction."""
    from .text import is_decline

    declines, returns = declines_action(text, prior), returns_to_goal(text, goal)
    declined = F.coalesce(is_decline(text), F.lit(False)) | declines | takes_out(text, prior) | returns
    return F.struct(declined.alias("declined"), (redirects_action(text, prior) | returns | declines).alias("redirects"))


def is_structural_refusal(text: Column) -> Column:
    """A refusal in known or in freer words. It counts only for a message without tool calls, as free words also occur in messages that comply."""
    from .text import is_refusal

    guarded = (F.length(text) <= 4000) & matches(text, UNWILLING) & (~matches(text, P.COMPLIANT) | matches(text, P.HARD_REFUSAL))
    return F.coalesce(is_refusal(text) | guarded, F.lit(False))
