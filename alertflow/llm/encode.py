"""Token ids of whole texts by a library tokenizer, with the ids of frequent chunks remembered."""

from __future__ import annotations

import re
import sys
from array import array
from functools import lru_cache

#: Chunks remembered by a worker; past it the memory starts afresh. It bounds memory and never changes a result.
REMEMBER = 1_000_000
#: Where a letter or digit meets a sign, a new token starts.
_SIGN = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿ])(?=[!-/:-@\[-`{-~])")
#: White space other than a single space or line end between two other characters.
_BLANK = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word of Latin letters, which is one pre-token whatever the vocabulary.
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The printable letter a byte-level vocabulary writes for each byte: itself if visible, else one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def plain_spacing(text: str) -> bool:
    """Whether every run of white space is one space or one line end inside the text."""
    return not (
        "  " in text
        or "\n\n" in text
        or " \n" in text
        or "\n " in text
        or text[:1] in (" ", "\n")
        or text[-1:] in (" ", "\n")
        or _BLANK.search(text)
    )


class _Known(dict):
    """Remembers what ``make`` gives for a key."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class ChunkEncoder:
    """Encodes with ``tokenizers``, one chunk at a time.

    Both vocabularies start a new word at a single space before a visible character, and a line end between visible
    characters is a word of its own, so chunks cut there have the same ids alone as inside the text. Other texts (runs
    of blanks, tabs, special strings) go to the library whole.
    """

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(name))
        self.library.no_truncation()
        self.library.no_padding()
        #: Byte-level vocabularies keep white space in their tokens, the others drop it.
        self.keeps_blanks = self.library.normalizer is None
        # the words that reach the library are new; its own cache of words only costs time then
        getattr(self.library.model, "_resize_cache", lambda n: None)(0)
        self.model, self.letters = self.library.model, dict(enumerate(byte_letters()))
        self.space = self.letters[32]
        self.parts = _Known(self.whole)
        self.first = _Known(self._first)
        self.after = _Known(self._after)
        self.line_end = self.whole("\n")

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        ids = array("I", ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def whole(self, text: str) -> bytes:
        return self._bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A single pre-token goes to the library's model at once, in the letters it writes for bytes."""
        word = word if self.keeps_blanks else word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        elif word[0] == " ":
            word = self.space + word[1:]
        return self._bytes([t.id for t in self.model.tokenize(word)])

    def _chunk(self, chunk: str) -> bytes:
        if _WORD.fullmatch(chunk):
            return self._word(chunk)
        return b"".join(self._word(p) if _WORD.fullmatch(p) else self.parts[p] for p in _SIGN.split(chunk))

    # words are remembered once for all the points and commas that follow them
    def _first(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and _WORD.fullmatch(word, 0, len(word) - 1):
            return self.first[word[:-1]] + self.parts[word[-1]]
        return self._chunk(word)

    def _after(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and _WORD.fullmatch(word, 0, len(word) - 1):
            return self.after[word[:-1]] + self.parts[word[-1]]
        return self._chunk(" " + word)

    def encode(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        if "<|" in text or not plain_spacing(text):
            return self.whole(text)
        for known in (self.first, self.after, self.parts):
            if len(known) > REMEMBER:
                known.clear()
        if not self.keeps_blanks:
            return b"".join(map(self.first.__getitem__, text.replace("\n", " ").split(" ")))
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            lines.append(self.first[words[0]] + b"".join(map(self.after.__getitem__, words[1:])))
        return self.line_end.join(lines)


@lru_cache(maxsize=4)
def encoder(name: str) -> ChunkEncoder:
    """One encoder for each vocabulary and Python worker."""
    return ChunkEncoder(name)
