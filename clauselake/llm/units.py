"""Byte-level vocabularies, and texts cut where no token can cross.

A text is cut before each space that follows a character that is no blank.  The pre-tokenizer's pattern looks back
nowhere and lets a space stand only at the head of a token or inside a run of blanks, so every such place ends a token.
Each piece, called a unit, can thus be encoded alone and remembered; remembered units are kept per Python worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import regex

# fixed value: the split pattern of byte-level vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SAME_CLASSES = "Ԁ"
"""Below this character all Unicode versions class letters, numbers and blanks alike."""

REMEMBER = 96 << 20
"""Bytes of the units remembered per worker, beside other memories."""

LONGEST = 64
"""Longer units are encoded each time."""

MARKS = ".,;:!?|%&*$#"
"""Marks at the end of a unit that form one token after a letter or number."""

LINE = "\n"

BARE = "\0"
"""Stands before a unit that has no space before it."""

RARE_BLANKS = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n\t\r")
RARE_ASCII = tuple(filter(str.isascii, RARE_BLANKS))

ODD_MARK = re.compile(rf"[{re.escape(MARKS)}](?<![^\W_].)(?=\s|\Z)")
"""A mark at the end of a unit that does not follow a letter or number, so that it may be part of a longer token."""

CHUNK = 1 << 20
"""Characters whose units are held at once; a longer text is held alone."""


def byte_of_char() -> dict[str, int]:
    """The byte that each visible stand-in character of a byte-level vocabulary means."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file: tokens as byte strings, merges in order, added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        chars = byte_of_char()

        def to_bytes(token: str) -> bytes:
            return bytes(chars[c] for c in token)

        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {to_bytes(t): i for t, i in model["vocab"].items() if t not in self.added}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.merges = [tuple(to_bytes(x) for x in (m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self._stand_in = chars
        self._library = Tokenizer.from_file(path).pre_tokenizer
        self._pattern = regex.compile(PATTERN)

    def words(self, text: str) -> list[bytes]:
        """The pre-tokens of a text without added tokens, as bytes."""
        if text.isascii() or max(text) < SAME_CLASSES:
            return [w.encode() for w in self._pattern.findall(text)]
        own = self._stand_in
        return [bytes(own[c] for c in w) for w, _ in self._library.pre_tokenize_str(text)]


class Recent:
    """What was used last, by key, in a bounded number of bytes: a young generation, and the one before it.

    When the young generation fills half the bytes, it becomes the old one; what is still used moves back.
    """

    ENTRY = 150
    """Bytes of an entry besides its key and value: two object heads and a place in the table."""

    def __init__(self, most: int):
        self.young: dict = {}
        self.old: dict = {}
        self._most, self._size = most // 2, 0

    def get(self, key):
        """The value of a key, or None."""
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value, size: int = 0) -> None:
        """Remember a value that has `size` bytes with its key."""
        if self._size > self._most:
            self.young, self.old, self._size = {}, self.young, 0
        self.young[key] = value
        self._size += self.ENTRY + size

    def update(self, entries: dict) -> None:
        """Remember many values, keys and values being texts or bytes."""
        if self._size > self._most:
            self.young, self.old, self._size = {}, self.young, 0
        self.young.update(entries)
        self._size += self.ENTRY * len(entries) + sum(map(len, entries)) + sum(map(len, entries.values()))


class UnitEncoder:
    """Texts to packed ids, one remembered unit at a time.

    `encode_units` gives the packed ids of units that are not remembered; `remember` bounds the bytes of those that are.
    """

    def __init__(self, encode_units: Callable[[Sequence[str]], list[bytes]], remember: int = REMEMBER):
        self._encode = encode_units
        self._units = Recent(remember)

    def __call__(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > CHUNK:
                out += self._chunk(texts[start: i + 1])
                start, size = i + 1, 0
        return out + self._chunk(texts[start:])

    def _chunk(self, texts: Sequence[str]) -> list[bytes]:
        look = self._units.young.get
        heads, bodies, fresh = [], [], set()
        for text in texts:
            easy = _easy(text)
            if easy is not None:
                head, rest = "", easy
            elif BARE in text:
                head, rest = text, []
            elif _has_runs(text):
                head, *units = _merged(*text.split(" "))
                rest = [u[1:] for u in units]
            else:
                head, *rest = text.split(" ")
            values = list(map(look, rest))
            if None in values:
                fresh.update([p for p, v in zip(rest, values) if v is None])
            heads.append(head)
            bodies.append((rest, values))
        first_ids, found = self._made(heads, fresh)
        return [
            first + b"".join([found[p] if v is None else v for p, v in zip(rest, values)] if None in values else values)
            for first, (rest, values) in zip(first_ids, bodies)
        ]

    def _made(self, heads: list[str], fresh: set[str]) -> tuple[list[bytes], dict[str, bytes]]:
        """Ids of the heads, and of each unit that the young generation does not have; these are remembered."""
        known, heads_of = self._units, sorted(set(heads))
        found = {p: v for p in fresh if (v := known.old.get(p)) is not None} if known.old else {}
        new = list(fresh.difference(found))
        ids = self._encode([*heads_of, *[p[1:] if p[:1] == BARE else " " + p for p in new]])
        head_ids = dict(zip(heads_of, ids))
        found.update(zip(new, ids[len(heads_of):]))
        known.update(found)
        return [head_ids[h] for h in heads], found


def _easy(text: str) -> list[str] | None:
    """The units of a text in which words, marks and line ends can be cut apart at once, or None.

    Blanks must stand alone between words, and marks at the end of a word must follow a letter or number.  Line ends and
    such marks are tokens of their own then, and the word after a line end has no space before it.
    """
    if (not text or BARE in text or "\t" in text or "\r" in text or "\n\n" in text or " \n" in text or _has_runs(text)
            or text[-1].isspace() or text[0] == LINE or ODD_MARK.search(text)):
        return None
    text = BARE + text.replace(LINE, f" {BARE}{LINE} {BARE}") + " "
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark + " ", f" {BARE}{mark} ")
    units = text.split(" ")
    units.pop()
    return units


def _runs(part: str) -> bool:
    """Whether a blank stands before the next cut, so that it is no cut."""
    return not part or part[-1].isspace()


def _has_runs(text: str) -> bool:
    """Whether a blank may stand before a space; texts with rare blanks count as such."""
    return (text[:1] == " " or "  " in text or "\n " in text or "\t " in text or "\r " in text
            or any(c in text for c in (RARE_ASCII if text.isascii() else RARE_BLANKS)))


def _merged(head: str, *rest: str) -> list[str]:
    """The units of a text with runs of blanks, all but the first with their leading space."""
    units, held = [], [head]
    for part in rest:
        if _runs(held[-1]):
            held.append(part)
        else:
            units.append(" ".join(held))
            held = ["", part]
    return [*units, " ".join(held)]
