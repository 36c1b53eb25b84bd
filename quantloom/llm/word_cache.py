"""Exact word-level memo around the public tokenizers.

A byte-pair encoder works on pre-tokens, so the ids of a text are the ids of its
space-separated pieces wherever a piece boundary is also a pre-token boundary. Texts
where that could fail (runs of white space around a space, special strings) are
encoded whole by the library. Every id comes from the tokenizers library: plain words
go straight to its BPE model, all else through its complete pipeline.
"""

from __future__ import annotations

import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: A space between two white-space characters, or a trailing one after white space:
#: the only places where splitting at a space could cut a pre-token.
_UNSAFE = re.compile(r"\s \s|\s $")
#: Marks whose run after a word is a pre-token of its own (an apostrophe may open a contraction).
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def _byte_alphabet() -> dict[int, str]:
    """Byte -> character used by byte-level vocabularies (printable bytes stand for themselves)."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()


_LEAD = {"": "", " ": _ALPHABET[32]}


def _pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def mapped(word: str) -> str:
    """The word in the byte-level alphabet."""
    return word.encode().decode("latin-1").translate(_ALPHABET)


class ByteBpe:
    """Ids of whole texts under a byte-level BPE file, as little-endian 32-bit bytes."""

    def __init__(self, path: str, max_words: int = 600_000):
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tokenize = self.tk.model.tokenize
        self.max_words = max_words
        #: piece -> ids of the piece after a space; ids of a text's first piece
        self.cache: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        #: ids of short runs of marks that end a word
        self.tails: dict[str, bytes] = {}
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return _pack(self.tk.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _word(self, p: str, lead: str) -> bytes:
        """Ids of letters only, which are one pre-token together with a space before them."""
        return _pack([t.id for t in self.tokenize(_LEAD[lead] + p if p.isascii() else mapped(lead + p))])

    def _piece(self, p: str, lead: str, known: dict[str, bytes]) -> bytes:
        if p.isalpha():
            got = self._word(p, lead)
        elif "\n" in p and all(parts := p.split("\n")) and not any(q[0].isspace() for q in parts[1:]):
            # white space after a newline may share its pre-token
            got = self.line_end.join([(own := self.firsts if i else known).get(q) or self._piece(q, "" if i else lead, own) for i, q in enumerate(parts)])
        elif (word := p.rstrip(_MARKS)).isalpha():
            head = known.get(word)
            if head is None:
                head = known[word] = self._word(word, lead)
            marks = p[len(word) :]
            tail = self.tails.get(marks)
            if tail is None:
                tail = self._whole(marks)
                if len(marks) < 8:
                    self.tails[marks] = tail
            got = head + tail
        else:
            got = self._whole(lead + p)
        known[p] = got
        return got

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text or _UNSAFE.search(text):
            return self._whole(text)
        pieces = text.split(" ")
        head = pieces.pop(0)
        known = self.cache
        ids = list(map(known.get, pieces))
        if None in ids:
            if len(known) > self.max_words:
                known.clear()
            for i, v in enumerate(ids):
                if v is None:
                    p = pieces[i]
                    ids[i] = known.get(p) or self._piece(p, " ", known)
        if not head:
            return b"".join(ids)
        first = self.firsts.get(head)
        if first is None:
            if len(self.firsts) > self.max_words // 4:
                self.firsts.clear()
            first = self._piece(head, "", self.firsts)
        return first + b"".join(ids)
