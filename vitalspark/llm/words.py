"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once."""

from __future__ import annotations

import os
import string
import sys
import unicodedata
from array import array

#: Words that a worker remembers before the ones not met again may go.
REMEMBERED = 400_000
#: Longer words are encoded where they occur and not remembered.
LONG_WORD = 64
#: White space in the sense of any of the tokenizers' patterns, besides the space and the line feed.
OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
WIDE_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def little(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class WordEncoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids; the dictionary remembers words.

    Both kinds of tokenizer split a text before merging, and a space always starts a piece
    unless it stands beside other white space. So the ids of a text are the ids of its words,
    one after another; a text with white space side by side is encoded as one. Within a word, the
    punctuation at the end is a piece of its own after a letter, and letters alone are one piece,
    which goes to the tokenizer's model directly.
    """

    def __init__(self, path: str, byte_level: bool):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.byte_level = byte_level
        self.letters = dict(enumerate(byte_letters()))
        self.older: dict[str, bytes] = {}
        self.feed = self._encode("\n")
        self.marks: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return little(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece by the model alone."""
        shown = piece if piece.isascii() and piece.isalpha() else (
            piece.encode().decode("latin-1").translate(self.letters))
        return little([t.id for t in self.model.tokenize(shown)])

    def _marks(self, run: str) -> bytes:
        ids = self.marks.get(run)
        if ids is None:
            ids = self._encode(run)
            if len(run) < 4:
                self.marks[run] = ids
        return ids

    @staticmethod
    def _ends_in_letter(letter: str) -> bool:
        """Is the last character still a letter in lower case? That of some, such as İ, ends in a mark."""
        return letter.isascii() or unicodedata.normalize("NFC", letter.lower())[-1].isalpha()

    def _word(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)
        if core != word and core[-1:].isalpha() and (self.byte_level or self._ends_in_letter(core[-1])):
            return self[core] + self._marks(word[len(core):])
        if self.byte_level:
            if word[:1] == "\n":
                rest = word[1:]
                return self.feed + (self._piece(rest) if rest.isalpha() else self._encode(rest))
            return self._piece(" " + word) if word.isalpha() else self._encode(" " + word)
        if word.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word):
            low = word.lower()
            return self[low] if low != word else self._piece(word)
        return self._encode(word)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._word(word)
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # the text of a special token is that token
            self.tokenizer.encode_special_tokens = False
            try:
                return self._encode(text)
            finally:
                self.tokenizer.encode_special_tokens = True
        if not self.byte_level:
            return self.join(text.replace("\n", " ").split(" "))
        if not text or self._side_by_side(text):
            return self._encode(text)
        return self.join(("\n" + text.replace("\n", " \n")).split(" "))[len(self.feed):]

    @staticmethod
    def _side_by_side(text: str) -> bool:
        """May white space stand beside other white space, or at the start?"""
        return (text[0] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                or any(c in text for c in OTHER_SPACES)
                or not text.isascii() and any(c in text for c in WIDE_SPACES))

    def join(self, words: list[str]) -> bytes:
        """Ids of the words, each but those that begin with a line break after a space."""
        return b"".join(map(self.__getitem__, words))


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, byte_level: bool) -> WordEncoder:
    """The worker's encoder of a file; what it remembers only saves time."""
    key = (path, byte_level)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, byte_level)
    return _encoders[key]


def forget() -> None:
    """Drop what the worker remembers of words, for stages that have no use for it."""
    for words in _encoders.values():
        words.clear()
        words.older = {}
