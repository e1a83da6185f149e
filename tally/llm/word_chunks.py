"""Cutting texts where a byte-level BPE tokenizer always cuts, so that parts can be cached.

A cut before a space that follows a letter, digit or ASCII sign never changes
the tokens: no match of the byte-level pattern contains such a place in its
inside. Words repeat, so a cache of encoded parts does most of the work.
"""

from __future__ import annotations

import re

#: Plain characters for which the pattern below splits as byte-level tokenizers do.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = re.compile(f"[ \\n!-~{_LETTER}]*").fullmatch
#: Parts without anything that needs care: one space at most, no apostrophe, no line ends.
WORD = re.compile(f" ?[!-&(-~{_LETTER}]+").fullmatch
PIECES = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^ \n0-9{_LETTER}]+|[ \n]+(?![^ \n])|[ \n]+").findall


def byte_characters() -> str:
    """The characters by which byte-level tokenizers show the bytes 0 to 255, in order:
    printable Latin-1 characters stand for themselves, the rest for those from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256))


def closed(part: str) -> bool:
    """True if nothing that follows a space can join the end of ``part``."""
    last = part[-1:]
    return "!" <= last <= "~" or last.isalnum()


def chunks(text: str) -> list[str]:
    """Parts of ``text``, in order and without loss; each but the first starts with a space."""
    first, *rest = text.split(" ")
    out, own = [], [first]
    for part in rest:
        if closed(own[-1]):
            out.append(" ".join(own))
            own = ["", part]
        else:
            own.append(part)
    out.append(" ".join(own))
    return out


class PieceCache(dict):
    """piece -> bytes by ``fill(piece)``. Holds at most ``most`` pieces twice over: full,
    it sets them aside and takes back those that are asked for again."""

    def __init__(self, fill, most: int = 600_000):
        super().__init__()
        self.fill, self.most, self.aside = fill, most, {}

    def make_room(self) -> None:
        if len(self) > self.most:
            self.aside = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        value = self.aside.get(piece)
        if value is None:
            value = self.fill(piece)
        self[piece] = value
        return value


class PartCache(dict):
    """part -> bytes by ``fill(part)``. Holds at most ``most`` parts twice over: full,
    it sets them aside and takes back those that are asked for again.

    A part that the next one may join has None here: its text is then cut
    with :func:`chunks` and looked up in ``odd``.
    """

    def __init__(self, fill, most: int = 200_000):
        super().__init__()
        self.fill, self.most, self.odd, self.aside = fill, most, {}, {}

    def __missing__(self, part: str):
        if part in self.aside:
            value = self.aside[part]
        else:
            value = self.fill(part) if closed(part) else None
        self[part] = value
        return value

    def _odd(self, part: str) -> bytes:
        if part not in self.odd:
            self.odd[part] = self.fill(part)
        return self.odd[part]

    def make_room(self) -> None:
        if len(self) > self.most:
            self.aside = dict(self)
            self.clear()

    def document(self, text: str) -> bytes:
        """The joined values of the parts of ``text``."""
        if len(self) > 2 * self.most:
            self.make_room()
        if len(self.odd) > self.most // 10:
            self.odd.clear()
        first, *rest = text.split(" ")
        try:
            return b"".join([self[first], *[self[" " + p] for p in rest]])
        except TypeError:
            return b"".join([self._odd(c) for c in chunks(text)])
