"""Rules that a text sets for the work, as an array of (label, key, weight).

Defined results: null and empty texts set none; a text sets three at most, the named ones first, and each key once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .spans import let

# Rules with names, what sets a rule, what only asks or tells, where a rule begins, words that don't count, bounds.
NAMED = (
    (r"\b(?:no|don'?t add|do not add|without|never add)\b[^.]{0,20}\b(?:in[\s-]?line)\s+(?:code\s+)?comments?\b", "No inline code comments in shipped code"),
    (r"\b(?:no|without|avoid)\b[^.]{0,30}\bem[\s-]?dash", "No em dashes"),
    (r"\bem[\s-]?dash(?:es)?\b[^.]{0,30}\b(?:no|avoid|never|remove|don'?t)\b", "No em dashes"),
    (r"\b(?:keep|stays?|still says?|must be|use)\b[^.]{0,20}\bapache\b", "License must stay Apache"),
    (r"\bapache\b[^.]{0,20}\b(?:licens|2\.0)\b", "License must stay Apache"),
    (r"\b(?:zero|no)[\s-]?(?:new\s+)?dependenc(?:y|ies)\b", "Zero dependencies"),
    (r"\b(?:local[\s-]?(?:first|only)|no\s+(?:network|telemetry|uploads?|cloud))\b", "Local-only, no network or telemetry"),
    (r"\b(?:don'?t|do not|never)\b[^.]{0,30}\b(?:expose|leak)\b", "Do not expose or leak secrets"),
    (r"\bnarrow(?:ing)?\b[^.]{0,30}\bnot\b[^.]{0,20}\b(?:adding|features?)\b", "Narrow the product, do not add features"),
    (r"\b(?:no\s+ai|ai[\s-]?(?:generated|authored|written|tell))\b", "No AI-authorship tells"),
)
DIRECTIVE = r"\b(?:no|don'?t|do not|never|must(?: not)?|always|only|make sure|ensure|avoid|keep it|keep the|stay|don'?t add|do not add|no longer|stop|without|not a|never use|never add)\b"
DESCRIPTIVE = r"\b(?:i (?:don'?t|do not|can'?t|cannot)\b[^.]*\b(?:see|know|understand|think|see)|do you|does this|is this|why (?:do|does|is|are)|what (?:url|do|is|are)|how (?:do|does|can)|can you|could you|would (?:fable|it)|i (?:like|agree|see|don'?t see)\b)"
CUE = r"\b(?:no|don'?t|do not|never|must(?: not)?|always|only|make sure|ensure|avoid|keep it|keep the|stay|without)\b"
LEAD = r"^(?:and|also|but|so|then|please|okay|ok|yes|lol)\b[\s,]*"
TAIL = r"[\s,;:.!?-]+$"
ENDS = r"[.!?\n]+|\s*;\s*|\s+-\s+"
COMMA_BEFORE = r"(?:no|don'?t|do not|never|must|always|only|keep|ensure|make sure|avoid|stay)\b"
STOP_WORDS = (
    "the", "and", "for", "this", "that", "with", "you", "your", "are", "was", "has", "have",
    "not", "but", "can", "all", "any", "our", "out", "now", "too", "also", "please", "lol",
    "from", "into", "just", "like", "more", "some", "than", "then", "them", "they", "what",
    "when", "where", "which", "will", "about", "agent", "make", "made", "show", "look",
)
MOST, LONGEST, SHORTEST_CLAUSE, LONGEST_CLAUSE = 3, 160, 6, 220
NAMED_WEIGHT, CLAUSE_WEIGHT = 3, 1


def clauses(text: Column) -> Column:
    """The text's clauses, with blanks collapsed; a comma parts two only before a word that sets a rule."""
    parts = F.split(text, f"(?i){T.ascii_edges(ENDS)}|,\\s+(?={T.ascii_edges(COMMA_BEFORE)})")
    return F.filter(F.transform(parts, lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")


def phrase(clause: Column) -> Column:
    """The clause from its cue on, without words that lead in, or signs at its end."""
    cue = F.regexp_extract(clause, f"(?is){T.ascii_edges(CUE)}.*", 0)
    own = F.when(cue != "", cue).otherwise(clause)
    own = F.trim(F.regexp_replace(own, f"(?i){T.ascii_edges(LEAD)}", ""))
    return T.truncate(F.trim(F.regexp_replace(own, TAIL, "")), LONGEST)


def key(label: Column) -> Column:
    """The label's words that count, in order of the alphabet."""
    words = F.split(F.regexp_replace(F.lower(label), "[^a-z0-9 ]+", ""), " +")
    return F.array_join(F.array_sort(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))), " ")


def constraints(text: Column) -> Column:
    named = lambda c: F.reduce(F.array(*(T.matches(c, p) for p, _ in NAMED)), F.lit(False), lambda a, b: a | b)
    row = lambda label, weight: F.struct(label.alias("label"), key(label).alias("key"), F.lit(weight).alias("weight"))
    first = F.array_compact(F.array(*(F.when(T.matches(text, p), row(F.lit(label), NAMED_WEIGHT)) for p, label in NAMED)))
    sets = lambda c: F.length(c).between(SHORTEST_CLAUSE, LONGEST_CLAUSE) & T.matches(c, DIRECTIVE) & ~T.matches(c, DESCRIPTIVE) & ~c.rlike(r"\?\s*$") & ~named(c)
    said = F.filter(F.transform(F.filter(clauses(text), sets), phrase), lambda p: F.length(p) >= SHORTEST_CLAUSE)
    rest = F.transform(said, lambda p: row(F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))), CLAUSE_WEIGHT))
    both = F.filter(F.concat(first, rest), lambda r: r["key"] != "")
    once = let(both, lambda b: F.filter(b, lambda r, i: F.array_position(F.transform(b, lambda o: o["key"]), r["key"]) == i + 1))
    return F.coalesce(F.slice(once, 1, MOST), F.array().cast("array<struct<label:string,key:string,weight:int>>"))
