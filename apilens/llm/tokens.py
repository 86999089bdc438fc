"""Token ids of whole texts, with a memory of the words already encoded.

The vocabulary's pre-tokenizer never joins characters across white space, and its normaliser treats
every character outside white space by itself or together with its neighbours in the same word. A
text therefore has the ids of its words, one after the other, and a word that was encoded once in a
Python worker is looked up afterwards. Only the tokenizers library computes ids. A new word of letters with marks behind
them is taken apart, as the pre-tokenizer never joins the two, and its letters go to the library's model; all other
new words go to the whole library many at a time, and the offsets that it returns say which ids belong to which word.

The vocabulary is lower case, so ASCII capitals are lowered before words are looked up. Only in texts with combining marks
they stay, because some marks join a small letter but not the capital.

``tests/llm/test_tokens.py`` holds this against encoding whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Words kept in memory per generation; at most two generations are held.
REMEMBERED = 600_000
#: Longer words are not remembered.
_LONGEST = 64
#: New words that go to the library at once, and their bytes.
_TOGETHER, _TOGETHER_BYTES = 4096, 1 << 17
#: First bytes of the combining marks from U+0300 to U+036F, the only ones that join ASCII letters.
_COMBINING = (b"\xcc", b"\xcd")
# Latin letters that stay one letter in lower case (the dotted capital I does not), and ASCII marks and digits.
_LETTERS_AND_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-;=?@\[-`{}~]*)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of texts as packed unsigned little-endian 32-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self._whole = Tokenizer.from_file(path)
        self._model = self._whole.model
        self._byte_names = _byte_names()
        self._remembered = remembered
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def encode(self, text: bytes) -> bytes:
        if not any(mark in text for mark in _COMBINING):
            text = text.lower()
        words = text.split()
        found = list(map(self._new.get, words))
        if None in found:
            missing = dict.fromkeys(w for w, ids in zip(words, found) if ids is None)
            ids_of = self._compute_all(missing)
            found = [ids_of[w] if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def forget(self) -> None:
        """Give back the memory of words; texts have the same ids afterwards."""
        self._new, self._old = {}, {}

    def _compute_all(self, missing: dict[bytes, None]) -> dict[bytes, bytes]:
        """Ids of words that the newer generation does not hold; it learns them."""
        ids_of: dict[bytes, bytes] = {}
        together: list[bytes] = []
        size = 0
        for word in missing:
            ids = self._old.get(word)
            if ids is None:
                parts = _LETTERS_AND_MARKS.fullmatch(word.decode("utf-8", "replace"))
                if parts is not None and len(word) <= _LONGEST:
                    ids = self._letters(parts[1]) + (self._marks(parts[2]) if parts[2] else b"")
            if ids is not None:
                ids_of[word] = ids
                continue
            together.append(word)
            size += len(word) + 1
            if len(together) >= _TOGETHER or size >= _TOGETHER_BYTES:
                ids_of.update(zip(together, self._compute(together)))
                together, size = [], 0
        if together:
            ids_of.update(zip(together, self._compute(together)))
        for word, ids in ids_of.items():
            if len(word) <= _LONGEST:
                self._learn(word, ids)
        return ids_of

    def _learn(self, word: bytes, ids: bytes) -> None:
        if len(self._new) >= self._remembered:
            self._old, self._new = self._new, {}
        self._new[word] = ids

    def _letters(self, letters: str) -> bytes:
        lowered = letters.lower()
        word = lowered.encode()
        ids = self._new.get(word) or self._old.get(word)
        if ids is None:
            # letters reach the model as they are, their bytes under printable names
            named = lowered if lowered.isascii() else word.decode("latin-1").translate(self._byte_names)
            ids = np.array([t.id for t in self._model.tokenize(named)], dtype="<u4").tobytes()
            self._learn(word, ids)
        return ids

    def _marks(self, marks: str) -> bytes:
        word = marks.encode()
        ids = self._new.get(word) or self._old.get(word)
        if ids is None:
            (ids,) = self._compute([word])
            self._learn(word, ids)
        return ids

    def _compute(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        encoded = self._whole.encode(" ".join(texts), add_special_tokens=False)
        ids = np.array(encoded.ids, dtype="<u4").tobytes()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lengths)
        begins = np.fromiter((a for a, _ in encoded.offsets), np.int64, len(encoded.ids))
        cuts = [0, *(4 * np.searchsorted(begins, ends, side="left")).tolist()]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _byte_names() -> dict[int, str]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 characters stand for
    themselves, all other bytes take the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> WordEncoder:
    """One encoder per Python worker and vocabulary; its memory outlives single tasks."""
    if (path, remembered) not in _ENCODERS:
        _ENCODERS[path, remembered] = WordEncoder(path, remembered)
    return _ENCODERS[path, remembered]
