"""Column helpers for codes, whitespace, tokens and character classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# every Unicode blank, spelled out because regular expression engines differ on the short classes
SPACE = (r"[ \t\n\r\f\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
         r"\x{3000}]")
WIDE_DIGITS = "０１２３４５６７８９"
WORD = r"[\p{L}\p{N}]+"
CJK = r"[\x{4e00}-\x{9fff}]"


def strip(col: Column) -> Column:
    """Trim blanks of every kind at both ends."""
    return F.regexp_replace(col, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(col: Column) -> Column:
    """Remove all blanks."""
    return F.regexp_replace(col, SPACE, "")


def plain_digits(col: Column) -> Column:
    """Full-width digits as plain ones."""
    return F.translate(col, WIDE_DIGITS, "0123456789")


def norm_code(col: Column, level: str = "c") -> Column:
    """Comparable form of a document code.

    a: drop blank and wide blank; b: drop all blanks; c: b plus one kind of dash; d: drop plain blank only;
    all four in upper case.  e: lower case without blanks, for searching.
    """
    if level == "a":
        return F.upper(F.translate(col, " 　", ""))
    if level == "b":
        return F.upper(squeeze(col))
    if level == "c":
        return F.upper(F.translate(squeeze(col), "－‐‑–—", "-----"))
    if level == "d":
        return F.upper(F.translate(col, " ", ""))
    if level == "e":
        return F.lower(squeeze(col))
    raise ValueError(f"unknown level {level!r}")


def tokens(col: Column, punctuation: bool = False) -> Column:
    """Lower-case words; optionally every other non-blank character as its own token."""
    pattern = f"{WORD}|[^{SPACE[1:-1]}\\p{{L}}\\p{{N}}]" if punctuation else WORD
    return F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(0))


def cjk_tokens(col: Column, punctuation: bool = True) -> Column:
    """Words of other scripts as they are, runs of ideographs as overlapping pairs."""
    other = r"[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]+" + (f"|[^{SPACE[1:-1]}\\p{{L}}\\p{{N}}]" if punctuation else "")
    # a token is looked ahead at; an ideograph then moves on by one character, so pairs overlap
    pattern = f"(?=({CJK}{{2}}|(?<!{CJK}){CJK}(?!{CJK})|{other}))(?:{CJK}|{other})"
    return F.regexp_extract_all(F.lower(col), F.lit(pattern), F.lit(1))


def mixed_tokens(col: Column) -> Column:
    """Words of any script, runs of ideographs as overlapping pairs; texts without ideographs take the short way."""
    return F.when(col.rlike(CJK), cjk_tokens(col, punctuation=False)).otherwise(tokens(col))


def count_class(col: Column, char_class: str) -> Column:
    """Number of characters of a class."""
    return F.length(col) - F.length(F.regexp_replace(col, char_class, ""))


def contains_any(col: Column, words: list[str]) -> Column:
    """True when at least one literal occurs."""
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def count_present(col: Column, words: list[str]) -> Column:
    """How many of the literals occur at least once."""
    return sum((F.when(col.contains(w), 1).otherwise(0) for w in words), F.lit(0))
