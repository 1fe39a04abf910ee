"""Token counts at every prefix, by prefix dynamic programming over byte pairs.

A sequence of tokens is what byte-pair encoding makes of a word exactly if each token is what encoding makes of its
own bytes and each two neighbours are what it makes of theirs. So the encoding of each prefix of a word is that of
a shorter prefix and one more token, the one that fits the shorter prefix's last token; going from left
to right, each prefix needs its last token and its count alone. The word end is a mark on the last
byte, so a prefix taken by itself ends in a marked token, one inside a longer word doesn't: both
are kept.

A text's counts at its words' ends are running sums. The counts answer how many tokens any prefix has
and where a budget ends without encoding again; words are remembered, up to REMEMBER of them.

Prefixes are those of the normalised text (NFC, white space, lower case, as the file says).

Texts with a code point that Python's Unicode tables don't have are normalised and split into words by the tokenizers
library itself; a test compares all other code points.

Defined results: a null text counts as empty and has no tokens; special strings are one token each, as the
library has it; null ids and repeated rows are kept; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import id_and_text, per_text, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Words whose counts, and pairs whose fit, are remembered by a worker.
REMEMBER = 1 << 19


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies have for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Counter:
    """Counts tokens of words, and of each prefix of a word, for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: The pair each token is merged from, and the step at which; its letters alone have no pair.
        self.parts: dict[str, tuple[str, str]] = {}
        self.step: dict[tuple[str, str], int] = {}
        for k, (a, b) in enumerate(merges):
            self.step.setdefault((a, b), k)
            self.parts.setdefault(a + b, (a, b))
        self.order = {t: self.step[p] for t, p in self.parts.items()}
        self.letters = byte_letters()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(split)
        self.path = path
        self.counts: dict[str, int] = {}
        self.fit: dict[str, dict[str, bool]] = {}
        self.own: dict[str, bool] = {}
        #: Each end of a token that encoding can make: the token itself, or an empty string if it is but an end.
        self.ends: dict[str, str] = {}
        for t in self.vocab:
            if self._self(t):
                for k in range(1, len(t) - len(self.mark) if t.endswith(self.mark) else len(t)):
                    self.ends.setdefault(t[k:], "")
                self.ends[t] = t

    def _self(self, t: str) -> bool:
        """Whether the encoding of t's own letters is t."""
        if (known := self.own.get(t)) is None:
            p = self.parts.get(t)
            known = self.own[t] = p is None or (self._self(p[0]) and self._self(p[1]) and self._fits(p[0], p[1], self.order[t]))
        return known

    def _fits(self, left: str, right: str, limit: int = 1 << 40) -> bool:
        """Whether no merge across the border of left and right comes before the merges that make up the two.

        The merges of both are undone from the last to the first. Two pieces that touch at the border would have been
        merged if their step comes before the step that next uses one of them; on equal pairs the left merge is first.
        """
        while True:
            s = self.step.get((left, right))
            if s is not None and s < limit:
                return False
            a, b = self.order.get(left, -1), self.order.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, limit = self.parts[left][1], a
            else:
                # The right token's first merge at the border comes later in its step than one further left.
                right, limit = self.parts[right][0], b + 1

    def row(self, left: str) -> dict[str, bool]:
        """What is known of the tokens that may follow one."""
        known = self.fit.get(left)
        if known is None:
            if len(self.fit) * 16 >= REMEMBER:
                self.fit.clear()
            known = self.fit[left] = {}
        return known

    def prefixes(self, w: str, marked: bool) -> list[int]:
        """For i = 1 to len(w): the count of w[:i], its end marked if so asked (else at the last i alone)."""
        ends, n = self.ends, len(w)
        last, rows, count, out = [""] * (n + 1), [{}] * (n + 1), [0] * (n + 1), []
        for i in range(1, n + 1):
            for mark in (self.mark,) if i == n else ("", self.mark) if marked else ("",):
                piece = w[:i] + mark
                for j in range(i - 1, -1, -1):
                    t = ends.get(piece[j:])
                    if not t:
                        if t is None:
                            raise ValueError(f"{w[:i]!r} can't be encoded")
                        continue
                    if j:
                        ok = rows[j].get(t)
                        if ok is None:
                            ok = rows[j][t] = self._fits(last[j], t)
                        if not ok:
                            continue
                    break  # no other token fits
                if mark or i == n:
                    out.append(count[j] + 1)
                if not mark:
                    count[i], last[i], rows[i] = count[j] + 1, t, self.row(t)
        return out

    def prefix_counts(self, word: str) -> list[int]:
        """The token counts of the word's prefixes of 1, 2, ... characters, each as a text of its own."""
        letters = ["".join([self.letters[b] for b in c.encode()]) for c in word]
        counts = self.prefixes("".join(letters), marked=True)
        return [counts[k - 1] for k in itertools.accumulate(map(len, letters))]

    def count(self, word: str) -> int:
        """The token count of a whole word."""
        if (known := self.counts.get(word)) is None:
            w = word if word.isascii() and word.isalnum() else "".join([self.letters[b] for b in word.encode()])
            if len(self.counts) >= REMEMBER:
                self.counts.clear()
            known = self.counts[word] = self.prefixes(w, marked=False)[-1]
        return known

    def split(self, text: str) -> Iterator[str | None]:
        """The words of the normalised text; None for a special string."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield from self._words(text[at : m.start()])
            yield None
            at = m.end()
        yield from self._words(text[at:] if at else text)

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and "Cn" in map(unicodedata.category, set(text)):
            # Unassigned for Python, so its tables and the library's may differ.
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        text = unicodedata.normalize("NFC", text).lower() if not text.isascii() else text.lower()
        return self.words.findall(text)

    def sums(self, text: str) -> np.ndarray:
        """Token counts of the text up to the end of each of its words."""
        known, count = self.counts, self.count
        return np.cumsum([1 if w is None else known.get(w) or count(w) for w in self.split(text)], dtype=np.int64)


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


class Prefixes:
    """The stored counts of one text; every question is answered from them."""

    def __init__(self, c: Counter, text: str):
        self.counter, self.words, self.upto = c, list(c.split(text)), c.sums(text)

    def total(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def at(self, word: int, chars: int) -> int:
        """Tokens of the first `word` words and so many characters of the next."""
        before = int(self.upto[word - 1]) if word else 0
        w = self.words[word] if chars else None
        if not chars or w is None:
            return before + bool(chars)
        if w[:1] == "'" and chars < len(w) and w in ("'re", "'ve", "'ll"):
            return before + self.counter.count("'") + (self.counter.count(w[1:chars]) if chars > 1 else 0)
        return before + self.counter.prefix_counts(w)[chars - 1]

    def within(self, budget: int) -> int:
        """The most whole words whose tokens are within the budget."""
        return int(np.searchsorted(self.upto, budget, side="right"))


def _count(path: str, limit: int, arrays: bool, texts: list[str]) -> pa.Array:
    c = counter(path)
    sums = [c.sums(t) for t in texts]
    cols = {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [int(s[-1]) if len(s) else 0 for s in sums], "words_within": [int(np.searchsorted(s, limit, side="right")) for s in sums]}
    made = {k: pa.array(v, pa.int64()) for k, v in cols.items()} | ({"upto": pa.array(sums, pa.list_(pa.int64()))} if arrays else {})
    return pa.StructArray.from_arrays(list(made.values()), fields=[pa.field(k, v.type) for k, v in made.items()])


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT, arrays: bool = True) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_tokens, words_within (the words that fit limit), upto (tokens up to each word's end)."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    schema = "n_bytes bigint, n_tokens bigint, words_within bigint" + ", upto array<bigint>" * arrays
    made = per_text(docs.sparkSession, lambda texts: _count(path, limit, arrays, texts), schema, F.col("text")).alias("made")
    return id_and_text(docs, id_col, text_col).select("doc_id", made).select("doc_id", "made.*")
