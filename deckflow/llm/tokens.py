"""Token ids of whole texts, by a public tokenizer and a bounded memory of words."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np

from deckflow.llm.common import only


def word_bpe() -> str:
    """Place of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of Latin letters and what may follow it: the pre-tokenizer always parts the two,
#: and the normalizer lowers such letters one by one.
_PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#]*)")

class _Words(dict):
    """Ids of words; one that is missing is learned when it is asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__({"": b""})
        self._learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self._learn(word)
        return ids


class WordEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False)``, a space-separated word at a time.

    For tokenizers whose normalizer and pre-tokenizer never join or look across a space
    (the word-end BPE here: composition, white space, lower case, and a pattern that
    drops white space). Then the ids of a text are those of its words in a row, and a
    word that was seen needs no second pass; nor do its capitals and closing marks.
    ``limit`` bounds the remembered words.
    """

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._model, self._limit = self._tokenizer.model, limit
        # Small Latin letters as the byte-level step spells them; normalizer and pattern leave them alone.
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._bytes = {c: split(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self._kind = "H" if self.dtype.itemsize == 2 else "I"
        # Words and parts of words in one table of two generations: what is in use outlives a
        # full table, and a small word that is its own part is held once.
        self.clear()

    def clear(self) -> None:
        """Forget all words; each is learned again when it is asked for."""
        self._young, self._old = _Words(self._learn), {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian in ``dtype``; a null text has none."""
        only(self)
        if len(self._young) > 2 * self._limit:
            self._old, self._young = self._young, _Words(self._learn)
        ids = self._young.__getitem__
        return [
            b"".join(map(ids, (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
            for t in texts
        ]

    def _learn(self, word: str) -> bytes:
        if word in self._old:
            return self._old[word]
        if word.isascii() and word.isalpha():
            core, marks = word.lower(), ""
        else:
            found = _PARTS.fullmatch(word)
            if not found:
                return array(self._kind, self._tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            core, marks = found[1].lower(), found[2]
        if core != word:
            return self._young[core] + self._young[marks]
        spelled = core if core.isascii() else core.translate(self._bytes)
        return array(self._kind, [t.id for t in self._model.tokenize(spelled)]).tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process, so that its words last over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
