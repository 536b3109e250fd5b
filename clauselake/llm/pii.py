"""Personal data: four kinds found by form, and more found by bootstrapping from their contexts.

Emails, IP addresses, card and phone numbers are found by their patterns; they are the seeds.  A slot is a place where
an identifier may stand: a seed, or a run of non-blanks, cut into labels and values, with a digit or @ that overlaps no
seed.  The word before a slot and the word after it, glued to it by a mark or not, are its lexical patterns.  Instances and patterns form a graph, with the number of slots they share on the
edges.  In each round a pattern is trusted if, of all places in the corpus where its word stands, enough are filled
by known instances of one kind, and if enough different instances speak for it; an instance is known if the
trusted patterns around it make it likely enough.  Slots of instances that became known are spans beside the seeds.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import record_batch, sliced, stored, strings

# fixed values: the kinds in their order and the forms of the seeds
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS = (16, 19)
PHONE_DIGITS = (8, 15)

HINT = re.compile(r"[0-9@]")
# letters of scripts without blanks or with endings glued to foreign words, and the marks among them
GLUED, GLUED_MARKS = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af", "\u3000-\u303f\uff01-\uff0f\uff1a-\uff20"
TOKEN = re.compile(rf"[^\s{GLUED}{GLUED_MARKS}]+")
CUTS = re.compile(r"[\"<>{}\[\]|&=;]|(?:(?<=[^\W\d_]{3})|(?<=[^\W\d_])(?<![0-9A-Fa-f]{2})):")
"""Where a run is cut into labels and values; a colon after letters only, so that times and addresses stay whole."""

WORD = re.compile(rf"(?:[^\s\"'`()\[\]{{}}<>,;:!?*&#$%|=/+\\{GLUED}{GLUED_MARKS}]+|[{GLUED}]+)[:=]?")
"""A pattern word, with the colon or equals sign right after it."""
EDGES = "\"'`()[]{}<>.,;:!?*&#$%|"

LONGEST = 128
"""A run longer than this is cut at its marks; a piece of it that is still longer has no mark inside and is no slot."""

INNER = re.compile(r"[^\"'`()\[\]{}<>.,;:!?*&#$%|=/+\\]+")
"""Pieces of a long run, or of one with a seed in it."""

SUPPORT = 3
"""Different instances that must speak for a pattern."""

TRUST = 0.5
"""Share of a pattern's places that known instances must fill, and the likelihood that makes an instance known."""

MARKS = 1 << 20
"""Bits of the mark table that tells which words are counted."""


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost emails: a run of local characters up to an @, not before the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        run = text[done:at]
        start = done + len(run.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def seeds(text: str) -> list[tuple[int, int, int]]:
    """The base spans of a text as (kind, start, end), by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if HINT.search(text) is None:
        return out
    for m in IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= CARD_DIGITS[0]:
            digits = _digits(m[0])
            if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]:
                out.append((3, *m.span()))
    return out


def _word(run: str) -> str:
    return run.lower().strip(".")


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """The places where identifiers may stand: runs, cut into labels and values, and values that are long at every mark."""
    for m in TOKEN.finditer(text):
        at = m.start()
        for end, go_on in [*((c.start(), c.end()) for c in CUTS.finditer(text, *m.span())), (m.end(), m.end())]:
            yield from ((at, end),) if end - at <= LONGEST else (i.span() for i in INNER.finditer(text, at, end))
            at = go_on


def slots(text: str, base: list[tuple[int, int, int]]) -> list[tuple[str, int | None, int, int, str, str]]:
    """Instance, kind of a seed or None, start, end, word before, word after."""
    if HINT.search(text) is None:
        return []
    taken = sorted((s, e, k) for k, s, e in base)
    reaches, begins = list(accumulate((e for _, e, _ in taken), max)), [s for s, _, _ in taken]
    places: list[tuple[int, int, int | None]] = [(s, e, k) for s, e, k in taken]

    def free(s: int, e: int) -> bool:
        t = bisect_left(begins, e)
        return not t or reaches[t - 1] <= s

    for s, e in (x for p in pieces(text) for x in ([p] if free(*p) else [i.span() for i in INNER.finditer(text, *p)])):
        if e - s > LONGEST or HINT.search(text, s, e) is None or not free(s, e):
            continue
        run = text[s:e]
        a, b = e - len(run.lstrip(EDGES + "/")), s + len(run.rstrip(EDGES + "/"))
        if a < b:
            places.append((a, b, None))
    words = [(*m.span(), w) for m in WORD.finditer(text) if (w := _word(m[0]))]
    starts, ends = [s for s, _, _ in words], [e for _, e, _ in words]
    out = []
    for s, e, k in sorted(places, key=lambda p: p[:2]):
        i = bisect_right(ends, s) - 1  # the last word that ends before the slot
        j = bisect_left(starts, e)  # the first one after it
        out.append((text[s:e].lower(), k, s, e, words[i][2] if i >= 0 else "", words[j][2] if j < len(words) else ""))
    return out


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One stored row per document: uid, doc_id, its base spans and its slots."""
    source = docs.select(F.monotonically_increasing_id().alias("uid"), docs[id_col].cast("long").alias("doc_id"),
                         docs[text_col].cast("string").alias("text"))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    slot = pa.struct([("instance", pa.string()), ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()),
                      ("before", pa.string()), ("after", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("base", pa.list_(span)),
                            ("slots", pa.list_(slot))])
        for batch in sliced(batches, "text"):
            texts = strings(batch.column("text"))
            base = [seeds(x) for x in texts]
            found = [slots(x, b) for x, b in zip(texts, base)]
            yield record_batch(
                schema, uid=batch.column("uid"), doc_id=batch.column("doc_id"),
                base=[[dict(zip(("kind", "start", "end"), s)) for s in b] for b in base],
                slots=[[dict(zip(("instance", "kind", "start", "end", "before", "after"), s)) for s in f] for f in found])

    return stored(source.mapInArrow(
        run, "uid long, doc_id long, base array<struct<kind int, start int, end int>>, slots array<struct<"
        "instance string, kind int, start int, end int, before string, after string>>"), "pii-scan")


def _places(docs: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """How often each of the words stands in the corpus: word, places.

    A table of fixed size marks the words by their crc32; texts are read once, marked words are counted per task, and a
    join leaves the words asked for.
    """
    marked = {r[0] for r in words.select((F.crc32(F.col("word").cast("binary")) % MARKS).cast("int")).distinct().collect()}
    table = bytearray(MARKS)
    for i in marked:
        table[i] = 1
    marks = docs.sparkSession.sparkContext.broadcast(bytes(table))
    source = docs.select(docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("places", pa.int64())])
        is_marked, seen, counts = marks.value, {}, Counter()

        def look(word: str) -> bool:
            if len(seen) > 200_000:
                seen.clear()
            got = seen[word] = bool(is_marked[zlib.crc32(word.encode()) % MARKS])
            return got

        for batch in sliced(batches, "text", 4 << 20):
            for text in strings(batch.column("text")):
                for w in map(_word, WORD.findall(text)):  # as slots() cuts them
                    got = seen.get(w)
                    if look(w) if got is None else got:
                        counts[w] += 1
            if len(counts) > 200_000:
                yield record_batch(schema, word=list(counts), places=list(counts.values()))
                counts.clear()
        if counts:
            yield record_batch(schema, word=list(counts), places=list(counts.values()))

    counted = source.mapInArrow(run, "word string, places long").groupBy("word").agg(F.sum("places").alias("places"))
    return words.join(counted, "word")


def bootstrap(scan: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, trust: float = TRUST,
              rounds: int | None = None) -> DataFrame | None:
    """Instances that are no seeds and became known: instance, kind; None if no pattern is worth counting.

    An instance keeps the kind under which it became known, so that rounds end when one finds nothing; `rounds` ends them before.
    """
    slot = F.explode("slots").alias("s")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("s.before").alias("word")),
                              F.struct(F.lit("r").alias("side"), F.col("s.after").alias("word")))).alias("c")
    graph = stored(
        scan.select(slot).select("s.instance", "s.kind", sides).filter("c.word != ''")
        .groupBy("instance", "c.side", "c.word").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "pii-graph")
    patterns = graph.groupBy("side", "word").agg(F.count("*").alias("instances"), F.count("kind").alias("seeds")).filter(
        (F.col("instances") >= support))
    words = stored(patterns.select("word").distinct(), "pii-words")
    if not words.head(1):
        return None
    counted = stored(_places(docs, text_col, words), "pii-places")
    edges = stored(graph.join(counted, "word"), "pii-edges")
    seed_of = graph.filter("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    known, done = stored(seed_of, "pii-known"), 0
    while rounds is None or done < rounds:
        done += 1
        told = edges.drop("kind").join(known, "instance")
        trusted = told.groupBy("side", "word", "kind").agg(
            F.count("*").alias("by"), (F.sum("n") / F.max("places")).alias("trust")).filter(
            (F.col("by") >= support) & (F.col("trust") >= trust))
        likely = edges.drop("kind").join(trusted, ["side", "word"]).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))).alias("p")).filter(F.col("p") >= trust)
        found = likely.groupBy("instance").agg(F.max(F.struct("p", -F.col("kind"))).alias("best")).select(
            "instance", (-F.col("best")["col2"]).alias("kind"))
        new = stored(found.join(known, "instance", "left_anti"), "pii-new")
        if new.isEmpty():
            break
        known = stored(known.unionByName(new), "pii-known")
    return known.join(seed_of, "instance", "left_anti")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per document: doc_id, spans of both sorts and their digests.

    Columns: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the seeds, spans of all as kind:start:end, by
    kind and start, joined by commas (code points, end exclusive).  A null text is empty and has no span, rows that repeat come
    out as often, and an empty table gives no rows.
    """
    scan = _scanned(docs, id_col, text_col)
    more = bootstrap(scan, docs, text_col, **limits)
    rows = scan.select("uid", "doc_id", "base")
    if more is None:
        rows = rows.withColumn("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    else:
        extra = (
            scan.select("uid", F.explode("slots").alias("s")).filter("s.kind is null")
            .select("uid", "s.instance", "s.start", "s.end").join(more, "instance")
            .groupBy("uid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
        )
        rows = rows.join(extra, "uid", "left").withColumn(
            "added", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>")))

    def joined(spans):
        names = F.array(*map(F.lit, KINDS))
        return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(F.encode(joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
                       joined(F.concat("base", "added")).alias("spans"))
