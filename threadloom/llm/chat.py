"""Chat formatting by incremental rendering of a template that is known only by what it renders.

Successive prefixes of a conversation's turns are rendered. Where each output begins with the one before, what it adds is the
last turn's span; where it doesn't, the template rewrites history, and the conversation is reported as such without spans.
Inside a span, two probe texts that differ in one letter show where the text begins, and an empty one how long the rest is.

Turns are dealt by conversation, sorted, and streamed, and the hashes go on from block to block. A template that is declared
local (an attribute local that is true: what a turn adds depends on it and the turn before alone) is rendered in windows of
one turn before a block, in bounded memory. Any other template is rendered whole, prefix after prefix, whatever the length of
the conversation, so that a rewrite at any turn is found; that holds the conversation and takes time as its length squared.

Defined results: a null text or role is empty; turns of equal number come in the order of role and text; null numbers first;
repeated rows are turns of their own; a conversation whose number is null is one conversation; an empty table gives no rows;
other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns that a task renders at a time.
BLOCK = 64
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\([\\.])")
_MARKED = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)


def escape(text: str) -> str:
    r"""Backslashes doubled, and \. put after the first letter of each control string, so that none is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def template(turns: list[Turn]) -> str:
    """The template of the query: each turn between marks, its role between marks of its own."""
    return "".join(f"<s>[INST] {escape(role)} [/INST]\n{escape(text)}</s>\n" for role, text in turns)


template.local = True


def parse(formatted: str) -> list[Turn]:
    """The turns that a text of template() holds."""
    out, at = [], 0
    for m in _MARKED.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside the marks")
    return out


@dataclass
class Rendered:
    """What a run of turns adds to the output, with the span of each turn and of its text in it; no spans if history is rewritten."""

    added: str
    spans: list[tuple[int, int]] | None
    texts: list[tuple[int, int]] | None


def render(turns: list[Turn], render_all: Template, before: list[Turn] | None = None) -> Rendered:
    """Render turns one by one after the turns before."""
    done = list(before or [])
    last = render_all(done) if done else ""
    skip, spans, texts = len(last), [], []
    for role, text in turns:
        a, b, none = (render_all([*done, (role, probe)]) for probe in ("a", "b", ""))
        done.append((role, text))
        now = render_all(done)
        if not (now.startswith(last) and a.startswith(last)):
            return Rendered(render_all([*(before or []), *turns])[skip:], None, None)
        begin = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(last))
        spans.append((len(last) - skip, len(now) - skip))
        texts.append((begin - skip, begin - skip + len(now) - len(none)))
        last = now
    return Rendered(last[skip:], spans, texts)


class Reader:
    """Reads blocks of formatted turns back, and hashes what they hold."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.rewrites = False

    def take(self, r: Rendered) -> None:
        self.formatted_chars += len(r.added)
        if r.spans is None:
            self.rewrites = True
            return
        for (begin, end), (a, b) in zip(r.spans, r.texts):
            for role, text in parse(r.added[begin:end]):
                self.n_turns += 1
                self.turns.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    masked = unescape(r.added[a:b])
                    self.loss_chars += len(masked)
                    self.loss.update(masked.encode())


class Conversation:
    """A conversation whose turns arrive one by one."""

    def __init__(self, render_all: Template):
        self.render_all, self.reader = render_all, Reader()
        self.local = getattr(render_all, "local", False)
        self.block: list[Turn] = []
        self.before: list[Turn] = []

    def add(self, role: str, text: str) -> None:
        self.block.append((role, text))
        if self.local and len(self.block) == BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.reader.take(render(self.block, self.render_all, self.before))
            self.before, self.block = self.block[-1:], []

    def end(self) -> Reader:
        self._flush()
        return self.reader


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"


def in_order(turns: DataFrame) -> DataFrame:
    """Turns dealt by conversation and sorted, null texts and roles empty."""
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digest(turns: DataFrame, render_all: Template = template) -> DataFrame:
    """One row for each conversation: what the formatted text holds, read back from it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: object = None
        held: Conversation | None = None
        names = [c.split()[0] for c in DIGEST.split(", ")]

        def row(key, c: Conversation):
            r = c.end()
            return key, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.formatted_chars, r.rewrites

        for batch in batches:
            rows = []
            keys = [None if missing else int(k) for k, missing in zip(batch["conv_id"].fillna(0), batch["conv_id"].isna())]
            for k, role, text in zip(keys, batch["role"], batch["text"]):
                if held is None or k != key:
                    if held is not None:
                        rows.append(row(key, held))
                    key, held = k, Conversation(render_all)
                held.add(role, text)
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
        if held is not None:
            yield pd.DataFrame([row(key, held)], columns=names).astype({"conv_id": "Int64"})

    return in_order(turns).mapInPandas(run, DIGEST)


def formatted(turns: DataFrame, render_all: Template = template) -> DataFrame:
    """One row for each turn: its formatted text, and where its own text begins and ends within, or nulls if the template rewrites history before it or there.

    A template that isn't declared local is given all turns before, so a conversation is held by its task.
    """
    local = getattr(render_all, "local", False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, before, n = object(), [], 0
        for batch in batches:
            rows = []
            for k, role, text in zip(batch["conv_id"], batch["role"], batch["text"]):
                same = k == key or (pd.isna(k) and key is None)
                before, n = (before, n + 1) if same else ([], 0)
                key = None if pd.isna(k) else k
                r = render([(role, text)], render_all, before)
                a, b = r.texts[0] if r.texts else (None, None)
                rows.append((key, n, role, r.added, a, b, role == "assistant"))
                before = [(role, text)] if local else [*before, (role, text)]
            yield pd.DataFrame(rows, columns=["conv_id", "n", "role", "formatted", "begins", "ends", "loss"]).astype({"conv_id": "Int64", "begins": "Int64", "ends": "Int64"})

    return in_order(turns).mapInPandas(run, "conv_id long, n long, role string, formatted string, begins long, ends long, loss boolean")
