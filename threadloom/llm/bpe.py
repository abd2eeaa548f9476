"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a batch go, sorted, into a trie of bytes. Sorted insertion is a depth-first walk, so every node is
made right after its ancestors and gets its state from theirs: the last token of the BPE encoding of the node's prefix,
and the node where that token starts. A prefix that many words share is encoded once. The trie and the words' results stay
in the Python worker from batch to batch, up to a stated number of entries, then start afresh; nothing is shuffled.

Why one token is enough: a sequence of tokens is what BPE makes of its bytes if and only if BPE makes each neighbouring
pair of them of that pair's bytes. So a prefix's last token is the one token that ends it and that stands next to the last
token of what comes before.

Defined results: a null text is empty; an empty text, or one of white space, has no ids (0, and the hashes of the empty
string); a very long word is a long path of the trie; equal texts have equal results; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tokenizer_path

#: Entries of the trie and of the table of words after which a worker starts afresh.
MAX_NODES = 1_000_000
MAX_WORDS = 500_000

#: White space as the tokenizer's patterns have it, as part of a character class; Python's own takes four control characters more.
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BEYOND_LATIN = re.compile("[^\x00-\u024f]|[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable Latin-1, else 256 and up in order."""
    letters, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters.append(chr(b))
        else:
            letters.append(chr(extra))
            extra += 1
    return letters


class WordTrie:
    """The encodings of words under a merge list, shared by prefix. A word's last letter carries the suffix that marks ends of words."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.token = {i: t for t, i in vocab.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        own = len(suffix)
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(suffix) and self._alone(t, i)}
        self.final = {t[:-own]: i for t, i in vocab.items() if t.endswith(suffix) and len(t) > own and self._alone(t, i)}
        self.longest_inner = max(map(len, self.inner), default=1)
        self.longest_final = max(map(len, self.final), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.last, self.start, self.depth = array("i", [-1]), array("i", [0]), array("i", [0])

    def letters(self, token: int) -> list[str]:
        """The token as BPE sees it at first: single letters, the last one with the suffix if the token has it."""
        text = self.token[token]
        if text.endswith(self.suffix) and len(text) > len(self.suffix):
            body = text[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(text)

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE: again and again the pair of the lowest rank, the leftmost of equals."""
        rank, none = self.rank.get, 1 << 40
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
        return parts

    def _alone(self, text: str, token: int) -> bool:
        return self.merged(self.letters(token)) == [text]

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE, given the letters of both tokens, ends with just these two."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.letters(left) + self.letters(right)) == [self.token[left], self.token[right]]
        return known

    def _state(self, path: list[int], word: str, depth: int, table: dict[str, int], longest: int) -> tuple[int, int]:
        """The last token of word[:depth] among those of table, and the node where it starts; path has the nodes of shorter prefixes.

        Just one token fits, so the order of trials is free: first where the token before started, then from the end.
        """
        guess = self.depth[self.start[path[depth - 1]]]
        for begin in (guess, *range(depth - 1, max(0, depth - longest) - 1, -1)):
            token = table.get(word[begin:depth])
            if token is not None:
                before = path[begin]
                if begin == 0 or self.beside(self.last[before], token):
                    return token, before
        raise ValueError(f"no token ends {word[:depth]!r}")

    def encode(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """The ids of each distinct word, given in the vocabulary's letters."""
        child, last, start, deep = self.child, self.last, self.start, self.depth
        path, before = [0], ""
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del path[min(shared, len(path) - 1) + 1 :]
            for depth in range(len(path), len(word)):
                key = path[-1] << 9 | ord(word[depth - 1])
                node = child.get(key)
                if node is None:
                    token, origin = self._state(path, word, depth, self.inner, self.longest_inner)
                    node = child[key] = len(last)
                    last.append(token)
                    start.append(origin)
                    deep.append(depth)
                path.append(node)
            token, node = self._state(path, word, len(word), self.final, self.longest_final)
            ids = [token]
            while node:
                ids.append(last[node])
                node = start[node]
            ids.reverse()
            yield word, ids
            before = word


class WordTokenizer:
    """What a tokenizer file with word ends does with whole texts: special tokens, NFC, white space, lower case, words, then the trie."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.trie = WordTrie(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        own = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(own)
        # the same pattern with its classes written out, for texts of Latin letters alone: several times as fast
        latin = [chr(c) for c in range(0x250)]
        self.latin = re.compile(own.replace("\\p{L}", "".join(c for c in latin if unicodedata.category(c)[0] == "L")).replace("\\p{N}", "".join(c for c in latin if unicodedata.category(c)[0] == "N")).replace("\\s", SPACE))
        self.letter = byte_letters()
        size = max(max(model["vocab"].values()), *self.special.values()) + 1
        self.token = [""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.token[i] = t
        self.number = [str(i) for i in range(size)]
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        """The text's words as the trie's keys: normalized, in lower case, special tokens apart."""
        out = []
        for k, part in enumerate(self.split_special.split(text) if "<|" in text else [text]):
            if k % 2:
                out.append(part)
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # letter by letter where a final sigma, which has a form of its own in str.lower(), may be
            low = "".join(c.lower() for c in part) if "Σ" in part else part.lower()
            out += (self.word if BEYOND_LATIN.search(low) else self.latin).findall(low)
        return out

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > MAX_WORDS:
            self.known.clear()
        if len(self.trie.last) > MAX_NODES:
            self.trie.clear()
        spelled = {w if w.isascii() and w.isprintable() else "".join(self.letter[b] for b in w.encode()): w for w in words if w not in self.special}
        for letters, ids in self.trie.encode(list(spelled)):
            self.known[spelled[letters]] = array("H", ids).tobytes()
        for content, i in self.special.items():
            self.known[content] = array("H", [i]).tobytes()

    def encode_decode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of ids, the ids as text and the decoded text, as their joins with single spaces."""
        rows = [self.words(t) for t in texts]
        known = self.known
        if fresh := {w for row in rows for w in row if w not in known}:
            if len(known) + len(fresh) > MAX_WORDS:
                fresh = {w for row in rows for w in row}
            self._learn(fresh)
        number, token = self.number, self.token
        for row in rows:
            ids = array("H", b"".join([known[w] for w in row]))
            yield len(ids), " ".join([number[i] for i in ids]), " ".join([token[i] for i in ids])


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(name: str) -> WordTokenizer:
    if name not in _loaded:
        _loaded[name] = WordTokenizer(tokenizer_path(name))
    return _loaded[name]


def digest(text: Column, name: str = "word_bpe_49k.json") -> Column:
    """A struct of n_tokens, ids_sha256 and decoded_sha256 for a text column."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokenizer = _tokenizer(name)
        for batch in batches:
            texts, rows = ["" if t is None else t for t in batch], []
            for a, b in slices([len(t) for t in texts]):
                rows += [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()) for n, ids, plain in tokenizer.encode_decode(texts[a:b])]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode_documents(docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return docs.select("doc_id", digest(F.col("text"), name).alias("_d")).select("doc_id", "_d.*")
