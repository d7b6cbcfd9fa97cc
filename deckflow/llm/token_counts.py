"""Token counts by the whole-token shortcut.

The model sees one pre-token at a time, so a pre-token always makes the same tokens. Before
the corpus is read, ``prove`` runs every vocabulary entry that ends a word through the model
and keeps the strings that come back as that one token. In the texts, pre-tokens among
those count one without a merge; only the rest is merged by the model, once per process as
long as it is remembered.

How a text falls into pre-tokens is proved as well. For a tokenizer whose steps never look
across a space (``parts_at_spaces``), words between spaces are counted on their own, and
words of characters that the steps were seen to leave in their class (``Alphabet``) are cut
by one pattern. All other words, and all texts of any other tokenizer, go through the
library's own normalizer and pre-tokenizer. Special strings in a text are one token each,
found before everything else, as the library does by default.

Defined cases: a null or empty text has no bytes and no tokens; a text of any length is
counted whole, one slice of about two million characters at a time, a longer text alone;
repeated rows each keep their row; null ids stay null; an empty table gives no rows; other
columns are not read, so their names may clash.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from deckflow.llm.common import slices, text_rows

# --- fixed values -----------------------------------------------------------
# Steps before the model that never join or look across a space.
SPACE_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
SPACE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# ----------------------------------------------------------------------------

#: What ``SPACE_PATTERN`` makes of lower-cased words of the proved alphabet.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_LETTERS = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts_at_spaces(path: str) -> bool:
    """Whether the steps before the model are the ones known never to look across a space."""
    with open(path, encoding="utf-8") as file:
        config = json.load(file)
    normalizer, before = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [{}]
    return (
        normalizer.get("normalizers") == SPACE_NORMALIZERS
        and len(steps) == 2
        and steps[0].get("pattern") == {"Regex": SPACE_PATTERN}
        and (steps[0].get("behavior"), steps[0].get("invert")) == ("Removed", True)
        and steps[1].get("type") == "ByteLevel"
        and not steps[1].get("add_prefix_space")
        and not steps[1].get("use_regex")
    )


def prove(path: str) -> frozenset[str]:
    """Pre-tokens, spelled as the model gets them, that the model returns as one token.

    At most as many as the vocabulary has entries. Runs once, before any text is read.
    """
    tokenizer = _load(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    whole = set()
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        alone = token.removesuffix(suffix) if token.endswith(suffix) else ""
        if alone and [t.id for t in tokenizer.model.tokenize(alone)] == [number]:
            whole.add(alone)
    return frozenset(whole)


class Alphabet:
    """Spelling of the characters that the tokenizer's steps leave in their class.

    Holds if every character alone is lower-cased to one character of its class, letters
    stay together, digits stand alone and marks stay together. Without combining marks
    among them, composition changes no sequence of them.
    """

    def __init__(self, tokenizer):
        normalize = tokenizer.normalizer.normalize_str
        cut = tokenizer.pre_tokenizer.pre_tokenize_str
        digits, marks = "0123456789", [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
        self.spelling = {}
        for c in (*_LETTERS, *digits, *marks):
            low = normalize(c)
            alone = [p for p, _ in cut(low)]
            self.proved = low == c.lower() and len(low) == len(alone) == 1 and (alone[0] == low or not low.isascii())
            if not self.proved:
                return
            self.spelling[ord(low)] = alone[0]
        self.proved = (
            all(len(cut(normalize("a" + c))) == 1 for c in _LETTERS)
            and all(len(cut(c + d)) == 2 for c in digits for d in "0a!")
            and all(len(cut("!" + c)) == 1 and len(cut("a" + c)) == 2 for c in marks)
        )


class Counter:
    """Counts tokens of texts; remembers words and pieces of ``limit`` characters, and of one batch more."""

    def __init__(self, path: str, whole: frozenset[str], limit: int = 8_000_000):
        self._tokenizer, self._whole, self._limit = _load(path), whole, limit
        special = list(self._tokenizer.get_added_tokens_decoder().values())
        if any(t.lstrip or t.rstrip or t.single_word for t in special):
            raise ValueError("added tokens that look at their surroundings are not supported")
        names = sorted((t.content for t in special), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, names))) if names else None
        alphabet = Alphabet(self._tokenizer) if parts_at_spaces(path) else None
        self._spelling = alphabet.spelling if alphabet and alphabet.proved else None
        self._words: dict[str, int] = {"": 0}
        self._merged: dict[str, int] = {}
        self._held = 0

    def count(self, texts: list[str | None]) -> list[int]:
        if self._held > self._limit:
            self._words, self._merged, self._held = {"": 0}, {}, 0
        if self._spelling is None:
            return [self._segments(t or "") for t in texts]
        split = [
            (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts
        ]
        known = self._words
        for word in set().union(*split).difference(known):
            known[word] = self._word(word)
            self._held += len(word)
        return [sum(map(known.__getitem__, words)) for words in split]

    def _word(self, word: str) -> int:
        if not _PLAIN.fullmatch(word) or (self._special and self._special.search(word)):
            return self._segments(word)
        pieces = _PIECES.findall(word.lower())
        if not word.isascii():  # only ASCII is spelled as it is
            pieces = [p.translate(self._spelling) for p in pieces]
        return sum([p in self._whole or self._rest(p) for p in pieces])

    def _segments(self, text: str) -> int:
        """Any text: special strings first, then the library's own steps."""
        if not text:
            return 0
        parts = self._special.split(text) if self._special else [text]
        return len(parts) - 1 + sum(map(self._steps, filter(None, parts)))

    def _steps(self, text: str) -> int:
        if self._tokenizer.normalizer:
            text = self._tokenizer.normalizer.normalize_str(text)
        if not self._tokenizer.pre_tokenizer:
            return self._rest(text)
        return sum([self._rest(p) for p, _ in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)])

    def _rest(self, spelled: str) -> int:
        """A pre-token as the model gets it: one if proved, else as many as its merges leave."""
        if spelled in self._whole:
            return 1
        n = self._merged.get(spelled)
        if n is None:
            n = self._merged[spelled] = len(self._tokenizer.model.tokenize(spelled))
            self._held += len(spelled)
        return n


_COUNTERS: dict[str, Counter] = {}


def count(
    docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and whether those are more than ``limit``."""
    whole = prove(tokenizer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTERS:  # one per worker process
            _COUNTERS[tokenizer] = Counter(tokenizer, whole)
        counter = _COUNTERS[tokenizer]
        for batch in batches:
            for some in slices(batch):
                texts = some.column("text")
                n = counter.count(texts.to_pylist())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": some.column("doc_id"),
                        "n_bytes": pc.binary_length(texts).fill_null(0).cast(pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "over_limit": pa.array([k > limit for k in n], pa.bool_()),
                    }
                )

    fields = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return text_rows(docs, id_col, text_col).mapInArrow(rows, fields)
