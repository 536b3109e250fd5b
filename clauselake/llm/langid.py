"""Language identification of mixed texts: scripts narrow the candidates, Viterbi over words finds the spans.

Letter trigrams of all labelled training texts are counted per language, and how often each language uses each
script.  A word is a run of letters; its score for a language is the sum of the log shares of its trigrams, and only
the languages that use its script are candidates.  The best labelling of a text's words, where each change of language
costs a penalty, gives its spans; the language of the most letters is the text's.  What a word may say grows with its
letters, and runs of scripts without blanks are cut into pieces that count as words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.common import held_out, record_batch, sliced, strings

# fixed values: blocks of the larger scripts, first and last character
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)

BITS = 17
"""Trigrams are hashed to so many bits; a language's model has one share per hash value."""

PENALTY = 14.0
"""Cost of a change of language, in units of log likelihood."""

CLIP, CLIP_LETTERS = 8.0, 8
"""The most by which a word of up to so many letters may speak against a language that uses its script; longer words in proportion."""

BLANKLESS, PIECE = ("han", "kana", "thai"), 4
"""Scripts written without blanks between words, and the letters of a piece that stands for a word there."""

BARRED = 4.0
"""What a word in a script that a language does not use speaks against it beyond the clip, in changes of language; over two, as a span needs."""

SCRIPT_SHARE = 0.005
"""A language uses a script that holds at least this share of its letters."""

UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per character: its lower case, and its script (0: no letter, 1: other scripts, 2 and up: SCRIPTS by name)."""
    names = list(dict.fromkeys(n for n, _, _ in SCRIPTS))
    chars = [chr(c) for c in range(0x110000)]
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in chars:
        if c.isalpha():
            low = c.lower()
            if len(low) == 1:
                lower[ord(c)] = ord(low)
    script = np.fromiter(map(str.isalpha, chars), np.uint8, 0x110000)
    for name, first, last in SCRIPTS:
        script[first: last + 1] *= 2 + names.index(name)
    return lower, script


@lru_cache(maxsize=1)
def blankless() -> np.ndarray:
    """Per script, as numbered by letter_tables: whether its words are cut into pieces."""
    names = list(dict.fromkeys(n for n, _, _ in SCRIPTS))
    cut = np.zeros(256, bool)
    cut[[1, *(2 + names.index(n) for n in BLANKLESS)]] = True
    return cut


class Letters:
    """The letters of many texts: trigram hashes, words and the text that each word belongs to."""

    def __init__(self, texts: list[str]):
        lower, script = letter_tables()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        chars = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = script[chars]
        folded = np.where(kinds > 0, lower[chars], 0).astype(np.uint32)
        at = np.flatnonzero(kinds)
        padded = np.concatenate([np.zeros(1, np.uint32), folded, np.zeros(1, np.uint32)])
        mixed = (padded[at] * np.uint32(0x9E3779B1) + padded[at + 1] * np.uint32(0x85EBCA77)
                 + padded[at + 2] * np.uint32(0xC2B2AE3D))
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        self.grams = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
        self.at = at
        self.kinds = kinds[at]
        # a word ends where letters or their script do; scripts without blanks, and those not told apart, go in pieces
        begins = (np.diff(at, prepend=-2) > 1) | (np.diff(self.kinds, prepend=self.kinds[:1]) != 0)
        number = np.arange(len(at))
        run = np.maximum.accumulate(np.where(begins, number, 0))
        self.starts = np.flatnonzero(begins | (blankless()[self.kinds] & ((number - run) % PIECE == 0)))
        self.lengths = np.diff(np.append(self.starts, len(at)))
        first = at[self.starts]
        self.text_of_word = np.searchsorted(self.offsets, first, side="right") - 1
        self.script_of_word = self.kinds[self.starts]
        self.first = first - self.offsets[self.text_of_word]


def train(labelled: DataFrame, text_col: str, lang_col: str) -> list[tuple[str, bytes, list[int]]]:
    """Per language: its name, the log shares of the hashed trigrams as float32, and its scripts.

    All texts are counted; every task sends one row per language and hash value, and a language's shares are put
    together from at most 2**BITS rows.
    """
    rows = labelled.select(labelled[lang_col].cast("string").alias("lang"), labelled[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64())])
        grams: dict[str, np.ndarray] = {}
        for batch in sliced(batches, "text", 2 << 20):
            langs, texts = batch.column("lang").to_pylist(), strings(batch.column("text"))
            for lang in dict.fromkeys(langs):
                found = Letters([t for t, x in zip(texts, langs) if x == lang])
                counts = grams.setdefault(lang, np.zeros((1 << BITS) + 256, np.int64))
                counts[: 1 << BITS] += np.bincount(found.grams, minlength=1 << BITS)
                counts[1 << BITS:] += np.bincount(found.kinds, minlength=256)
        for lang, counts in grams.items():
            codes = np.flatnonzero(counts)
            yield record_batch(schema, lang=[lang] * len(codes), code=codes.astype(np.int32), n=counts[codes])

    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((1 << BITS) + 256)
        counts[pdf["code"].to_numpy()] = pdf["n"].to_numpy()
        grams, scripts = counts[: 1 << BITS], counts[1 << BITS:]
        shares = np.log((grams + 0.5) / (grams.sum() + 0.5 * len(grams))).astype("<f4")
        used = np.flatnonzero(scripts >= max(1.0, SCRIPT_SHARE * scripts.sum())).tolist()
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "shares": [shares.tobytes()], "scripts": [used]})

    summed = rows.filter("lang is not null").mapInArrow(count, "lang string, code int, n long").groupBy(
        "lang", "code").agg(F.sum("n").alias("n"))
    made = summed.groupBy("lang").applyInPandas(model, "lang string, shares binary, scripts array<int>")
    return sorted((r["lang"], bytes(r["shares"]), list(r["scripts"])) for r in made.collect())


class Identifier:
    """Labels words and texts by a trained model."""

    def __init__(self, model: list[tuple[str, bytes, list[int]]], penalty: float = PENALTY):
        self.langs = [lang for lang, _, _ in model]
        self.penalty = penalty
        self._shares = np.stack([np.frombuffer(s, "<f4") for _, s, _ in model], axis=1)
        self._barred = np.ones((256, len(model)), bool)
        for i, (_, _, scripts) in enumerate(model):
            self._barred[scripts, i] = False
        self._barred[self._barred.all(axis=1)] = False  # a script that no language uses bars none

    def _word_scores(self, letters: Letters) -> np.ndarray:
        scores = np.add.reduceat(self._shares[letters.grams], letters.starts, axis=0)
        barred = self._barred[letters.script_of_word]
        scores = scores - np.where(barred, -np.inf, scores).max(axis=1, keepdims=True)
        clip = CLIP * np.maximum(1.0, letters.lengths / CLIP_LETTERS)[:, None]
        floor = -(clip + BARRED * self.penalty)
        return np.where(barred, floor, np.maximum(scores, -clip)).astype(np.float64)

    def _path(self, scores: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The best label of each word."""
        best = int(total.argmax())
        gains = np.delete(scores, best, axis=1).max(axis=1, initial=-np.inf) - scores[:, best]
        sums = np.concatenate([[0.0], np.cumsum(gains)])
        if len(self.langs) == 1 or float((sums - np.minimum.accumulate(sums)).max()) <= self.penalty:
            return np.full(len(scores), best)  # no stretch in another language gains what its change costs
        now, back = [0.0] * len(self.langs), []
        for row in scores.tolist():
            top = max(range(len(now)), key=now.__getitem__)
            least = now[top] - self.penalty
            back.append([i if v >= least else top for i, v in enumerate(now)])
            now = [max(v, least) + s for v, s in zip(now, row)]
        label = max(range(len(now)), key=now.__getitem__)
        path = np.empty(len(scores), np.int64)
        for i in range(len(scores) - 1, -1, -1):
            path[i] = label
            label = back[i][label]
        return path

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, score and spans (start, end, language) of each text."""
        out: list = [(UNKNOWN, 0.0, [])] * len(texts)
        letters = Letters(texts)
        if not len(letters.starts) or not self.langs:
            return out
        scores = self._word_scores(letters)
        owners = letters.text_of_word
        bounds = np.flatnonzero(np.diff(owners, prepend=-1))
        for a, b in zip(bounds, np.append(bounds[1:], len(owners))):
            mine = scores[a:b]
            total = mine.sum(axis=0)
            path = self._path(mine, total)
            weights = np.bincount(path, letters.lengths[a:b], minlength=len(self.langs))
            best = int(weights.argmax())
            odds = float(np.exp(np.clip(total - total[best], -50, 50)).sum())
            cuts = np.flatnonzero(np.diff(path, prepend=-1))
            first, size = letters.first[a:b], letters.lengths[a:b]
            ends = np.append(cuts[1:], b - a) - 1
            spans = [(int(first[i]), int(first[j] + size[j]), self.langs[path[i]]) for i, j in zip(cuts, ends)]
            out[owners[a]] = (self.langs[best], float(weights[best] / weights.sum()) / max(1.0, odds), spans)
        return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             penalty: float = PENALTY, keep: bool = False) -> DataFrame:
    """Predicted language of every text: doc_id, held_out, lang_pred, score, spans.

    Learned from all texts with a language whose crc32(id) mod 4 is not 2; the prediction reads the text only.  A null
    text or one without letters is "und" with score 0 and no span; so is every text if nothing could be learned.  The
    score is the share of letters in the language, divided by the odds of the other ones.  Rows that repeat come out as often, an
    empty table gives no rows.  With keep, all columns of the documents come out, followed by those named.
    """
    ids = docs[id_col]
    kept_out = held_out(id_col, 4, 2)
    learned = train(docs.filter(~kept_out & docs[lang_col].isNotNull() & docs[text_col].isNotNull()), text_col, lang_col)
    model = docs.sparkSession.sparkContext.broadcast(learned)  # 2**BITS shares per language
    if keep:
        names = docs.columns
        source = docs.withColumn("_held_out", kept_out)
    else:
        names = ["doc_id"]
        source = docs.select(ids.cast("long").alias("doc_id"), kept_out.alias("_held_out"),
                             docs[text_col].cast("string").alias("_text"))
    text_name = text_col if keep else "_text"
    out_schema = ", ".join([
        *[f"`{n}` {t}" for n, t in source.select(*[f"`{n}`" for n in names]).dtypes],
        "held_out boolean, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        labels = Identifier(model.value, penalty) if model.value else None
        for batch in sliced(batches, text_name, 2 << 20):
            texts = strings(batch.column(text_name))
            found = labels.label(texts) if labels else [(UNKNOWN, 0.0, [])] * len(texts)
            arrays = [batch.column(n) for n in names] + [
                batch.column("_held_out"), pa.array([f[0] for f in found], pa.string()),
                pa.array([min(1.0, max(0.0, f[1])) for f in found], pa.float64()),
                pa.array([[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found], pa.list_(span))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "held_out", "lang_pred", "score", "spans"])

    return source.mapInArrow(run, out_schema)


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents whose language could be told, with their columns; "und" goes.

    The columns travel under names of their own, so they may have any names.
    """
    own = [f"c{i}_" for i in range(len(docs.columns))]
    place = {c.lower(): name for c, name in zip(docs.columns, own)}
    found = identify(docs.toDF(*own), place[id_col.lower()], place[text_col.lower()], place[lang_col.lower()], keep=True, **options)
    return found.filter(F.col("lang_pred") != UNKNOWN).select(*own).toDF(*docs.columns)
