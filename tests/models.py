"""Sequential models of the rules that the library states with windows and joins."""

from __future__ import annotations

import re


def pack(text: str, limit: int) -> list[str]:
    """Paragraphs packed one after the other."""
    packs: list[list[str]] = []
    for p in (x.strip() for x in text.split("\n")):
        if not p:
            continue
        if packs and sum(map(len, packs[-1])) + len(p) <= limit:
            packs[-1].append(p)
        else:
            packs.append([p])
    return ["\n".join(x) for x in packs]


def merge(chunks: list[dict], shortest: int) -> list[tuple]:
    """(clause, chapter, text, count) after gluing, walking from the front; the chapter is that of the second part."""
    out, i = [], 0
    while i < len(chunks):
        c = chunks[i]
        n = chunks[i + 1] if i + 1 < len(chunks) else None
        glue = (
            c["type"] == "clause" and c["char_count"] < shortest and n is not None and n["type"] == "clause"
            and n["section"] == c["section"]
        )
        if glue:
            out.append((f"{c['clause']}+{n['clause']}", n["chapter"], f"{c['text']}\n{n['text']}", c["char_count"] + n["char_count"] + 1))
            i += 2
        else:
            out.append((c["clause"], c["chapter"], c["text"], c["char_count"]))
            i += 1
    return out


def places(text: str, pattern: str) -> list[tuple]:
    """(pos, prefix, word, suffix) of every match."""
    return [
        (m.start(), text[max(0, m.start() - 8) : m.start()], m.group().strip(), text[m.end() : m.end() + 8])
        for m in re.finditer(pattern, text)
    ]


def agreement(a: tuple, b: tuple) -> int:
    """Equal characters next to both words."""
    tail = head = 0
    while tail < min(len(a[1]), len(b[1])) and a[1][-1 - tail] == b[1][-1 - tail]:
        tail += 1
    while head < min(len(a[3]), len(b[3])) and a[3][head] == b[3][head]:
        head += 1
    return tail + head


def aligned(answer: str, sources: list[str], pattern: str, least: int, directions: str) -> str:
    """Answer with each word set to that of the best agreeing source place."""
    known = [p for s in sources for p in places(s, pattern)]
    out = answer
    for a in reversed(places(answer, pattern)):
        def clash(k: tuple) -> bool:
            x, y = a[3][:1], k[3][:1]
            return bool(x and y and x in directions and y in directions and x != y)

        scored = [(agreement(a, k), -i, k[2]) for i, k in enumerate(known) if not clash(k)]
        best = max(scored, default=(0, 0, ""))
        if best[0] >= least:
            out = out[: a[0]] + best[2] + out[a[0] + len(a[2]) :]
    return out
