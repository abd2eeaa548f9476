"""Where a pattern's matches lie in a text, as expressions over columns.

Offsets are code points from 0, ends exclusive. What lies between the matches comes from a split by the same pattern, so that
lengths of gaps and matches, added up in turn, are the offsets; the sums are made by doubling steps, not by a list that grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the rules' white space takes in beside Java's.
BLANKS = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word's edge between ASCII letters, digits and _ alone; Java's own takes accented letters in.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_words(pattern: str) -> str:
    r"""The pattern with \b and \w over ASCII alone, and \s over every Unicode blank, inside classes and outside."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two[0] == "\\":
            new = {r"\b": EDGE, r"\s": BLANKS if depth else f"[{BLANKS}]", r"\S": two if depth else f"[^{BLANKS}]"}.get(two, two)
            out.append(new)
            i += 2
            continue
        depth += (two[0] == "[" and not depth) - (two[0] == "]" and depth > 0)
        out.append(two[0])
        i += 1
    return "".join(out)


def quoted(text: str) -> str:
    """The text as a literal of Spark's SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def running(values: str) -> str:
    """SQL for the sums of an array of whole numbers up to each place, in as many steps as its length has bits."""
    steps = ", ".join(str(1 << i) for i in range(31))
    return f"transform(array({values}), every -> aggregate(filter(array({steps}), d -> d < size(every)), every, (u, d) -> transform(u, (x, i) -> x + coalesce(get(u, i - d), 0))))[0]"


def spans_sql(text: str, pattern: str) -> str:
    """SQL for an array of (start, end, match) of the pattern's matches in a text, in order; the pattern matches no empty text.

    One string instead of columns, as a scan has some forty of them, and each call of a column function crosses to the JVM.
    """
    p = quoted(pattern)
    ends = running("transform(s.m, (m, i) -> length(m) + length(get(s.gaps, i)))")
    return (
        f"CASE WHEN rlike({text}, {p}) THEN transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'gaps', split({text}, {p}, -1))), "
        f"s -> zip_with(s.m, {ends}, (m, e) -> named_struct('start', e - length(m), 'end', e, 'match', m)))[0] ELSE CAST(array() AS array<struct<start:int,end:int,match:string>>) END"
    )


def spans(text: str, pattern: str) -> Column:
    """spans_sql as a column; text is a column's name or SQL."""
    return F.expr(spans_sql(text, pattern))


def holds(known: Column, place: Column) -> Column:
    """Whether a place lies in one of some spans."""
    return F.exists(known, lambda k: (place >= k["start"]) & (place < k["end"]))


def blanked(text: Column, where: Column) -> Column:
    """The text with the characters of some spans as line breaks, so that all other offsets stay."""
    return F.aggregate(where, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.repeat(F.lit("\n"), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t))))


def origins(text: str, left_out: str) -> Column:
    """An array of (at, start): where each run of characters that left_out doesn't match begins in the text without those that it does, and in the text."""
    runs = running("transform(found, f -> f.end - f.start)")
    return F.expr(f"transform(array({spans_sql(text, f'[^{left_out}]+')}), found -> zip_with(found, {runs}, (f, e) -> named_struct('at', e - (f.end - f.start), 'start', f.start)))[0]")


def origin(marks: Column, place: Column) -> Column:
    """Where a place of the squeezed text lies in the whole one."""
    mark = F.element_at(F.filter(marks, lambda m: m["at"] <= place), -1)
    return mark["start"] + place - mark["at"]
