"""Byte-pair ids through the tokenizers library, one encoding a distinct word.

A byte-level BPE model cuts a text into words with a fixed pattern and merges
within words only, so the ids of a text are those of its words in a row. Words
repeat; the library's model merges those that the bounded cache does not hold,
many in one text with a line feed as a word of its own between them.
Texts with characters outside ``_PLAIN``, whose class could differ between
Unicode versions, or with the text of a special token, go to the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

CACHE = 400_000  # words of a generation; two are held
# Latin letters up to U+024F, general punctuation, the euro sign; of the control
# characters tab, line feed, form feed and carriage return.
_PLAIN = "\t\n\f\r\x20-\x7e\xa0-\u024f\u2010-\u2022\u2026\u20ac"
_ODD = re.compile(f"[^{_PLAIN}]")
_LETTER, _NUMBER, _BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", r" \t\n\f\r\xa0"
# the model's word pattern with its classes spelled out for plain characters
_WORDS = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+"
)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[int, str]:
    """Byte -> its character in byte-level vocabularies: printable Latin-1 stands
    for itself, the others for U+0100 onward in order. A line feed gets blanks
    around, which makes it a word."""
    own = {b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173}
    others = iter(range(256, 512))
    out = {b: chr(b) if b in own else chr(next(others)) for b in range(256)}
    return out | {10: f" {out[10]} "}


_ALPHABET = _alphabet()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str, dtype: type = np.uint16, plain_specials: bool = False, cache: int = CACHE) -> Encoder:
    """One encoder a worker process: what it has learned serves its later tasks."""
    return Encoder(path, pattern, dtype, plain_specials, cache)


class Encoder:
    """``batch(texts)`` -> the ids of each text as little-endian bytes of
    ``dtype``, without special tokens. Null counts as empty. ``pattern`` is the
    model's word pattern; one that is not known here sends all texts whole."""

    def __init__(self, path: str, pattern: str, dtype: type = np.uint16, plain_specials: bool = False, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if plain_specials:
            self.tokenizer.encode_special_tokens = True
        if self.tokenizer.get_vocab_size() > np.iinfo(dtype).max + 1:
            raise ValueError("the vocabulary does not fit the id type")
        self.dtype, self.by_word = np.dtype(dtype).newbyteorder("<"), pattern == _PATTERN
        self.known = Known(cache)
        self.model = Tokenizer(self.tokenizer.model)  # for words in the model's own alphabet
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _in_lines(self, words: list[str]) -> list[bytes]:
        """Ids of words without line feeds, as the lines of one text. The model's
        alphabet has a character for each byte and none of them is blank."""
        if not words:
            return []
        text = "\n".join(words).encode().decode("latin-1").translate(_ALPHABET)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(ids == self.line[0])
        if len(self.line) != 1 or len(cuts) != len(words) - 1:
            return self._whole(words)
        raw, size = ids.tobytes(), ids.itemsize
        begin, end = np.concatenate(([0], cuts + 1)) * size, np.append(cuts, len(ids)) * size
        return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    def _learn(self, words: set[str]) -> None:
        blank = [w for w in words if w.isspace()]
        plain = [w for w in words if not w.isspace()]
        self.known.update(zip(blank, self._whole(blank), strict=True))
        for i in range(0, len(plain), 512):
            part = plain[i : i + 512]
            self.known.update(zip(part, self._in_lines(part), strict=True))

    def batch(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        known.turn()
        found: list[list[bytes | None] | None] = []
        asked: list[list[str]] = []
        for t in texts:
            if t and self.by_word and "<|" not in t and not _ODD.search(t):
                known.asked = []
                found.append(list(map(known.__getitem__, _WORDS.findall(t))))
                asked.append(known.asked)
            else:
                found.append(None)
                asked.append([])
        self._learn(set().union(*asked))
        for ids, words in zip(found, asked, strict=True):
            i = -1
            for w in words:  # the gaps, in order
                i = ids.index(None, i + 1)
                ids[i] = known[w]
        odd = [t for t, ids in zip(texts, found, strict=True) if t and ids is None]
        whole = iter(self._whole(odd) if odd else ())
        return [b"".join(ids) if ids is not None else next(whole) if t else b"" for t, ids in zip(texts, found, strict=True)]


class Known(dict):
    """Word -> ids, two generations of about ``most`` words. A word in neither is
    noted in ``asked`` and read as None."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most
        self.old: dict[str, bytes] = {}
        self.asked: list[str] = []

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes | None:
        got = self.old.get(word)
        if got is None:
            self.asked.append(word)
        else:
            self[word] = got
        return got
