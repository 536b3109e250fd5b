"""BPE encoding and decoding by dynamic programming over prefixes.

A byte string has exactly one sequence of tokens that the merges produce, and so has each of its prefixes: the last
token of that sequence is unique.  An automaton with suffix links over all tokens gives the tokens that end at each
position, and a token is the last one of a prefix if it is compatible with the last token of what precedes it, that is
if no merge across the border between the two would come first.  One pass stores the last token of every prefix;
following these back from the end gives the ids, in time linear in the text for a given vocabulary.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clauselake.llm.common import free_name, record_batch, sliced, strings
from clauselake.llm.units import LONGEST, Recent, UnitEncoder, Vocabulary

NEVER = 1 << 62
PAIRS = 48 << 20
"""Bytes of the pairs whose compatibility is remembered per worker."""

WORDS = 48 << 20
"""Bytes of the pre-tokens remembered per worker."""


class PrefixBpe:
    """Encoder and decoder of one byte-level vocabulary whose every token encodes to itself."""

    def __init__(self, path: str):
        vocab = Vocabulary(path)
        self._vocab = vocab
        ids = vocab.ids
        self._whole = {t.decode("latin-1"): i for t, i in ids.items()}
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(vocab.merges):
            left, right, both = ids[a], ids[b], ids[a + b]
            self._rank[left, right] = rank
            self._parts.setdefault(both, (left, right, rank))
        self._ends = ahocorasick.Automaton()
        for text, i in self._whole.items():
            self._ends.add_word(text, (len(text), i))
        self._ends.make_automaton()
        self._fits = Recent(PAIRS)
        self._words = Recent(WORDS)
        self._table = [vocab.bytes_of.get(i, b"") for i in range(max(vocab.bytes_of) + 1)]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the border between two adjacent tokens survives all merges.

        The merges are undone from the last one back, on the right edge of the left token and on the left edge of the
        right one.  At each state the pair across the border would merge if its rank comes before the merges that are
        next at the edges; of equal ranks the leftmost goes first.
        """
        next_left = next_right = NEVER  # the merges that take the pieces at the border into their tokens
        rank, parts = self._rank, self._parts
        while True:
            across = rank.get((left, right))
            if across is not None and across < next_left and across <= next_right:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[2] >= b[2]:
                left, next_left = a[1], a[2]
            else:
                right, next_right = b[0], b[2]

    def word(self, data: bytes) -> array:
        """Ids of one pre-token."""
        text = data.decode("latin-1")
        whole = self._whole.get(text)
        if whole is not None:
            return array("I", (whole,))
        last, first = [-1] * len(text), [0] * len(text)
        fits = self._fits
        for end, length, token in self._matches(text):
            if last[end] >= 0:
                continue
            before = end - length
            if before >= 0:
                pair = last[before] << 32 | token
                good = fits.get(pair)
                if good is None:
                    good = self._compatible(last[before], token)
                    fits.put(pair, good)
                if not good:
                    continue
            last[end], first[end] = token, before
        out, at = array("I"), len(text) - 1
        while at >= 0:
            out.append(last[at])
            at = first[at]
        out.reverse()
        return out

    def _matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Tokens that end at each position, longest first: position, length, id."""
        return ((end, length, token) for end, (length, token) in self._ends.iter(text))

    def _packed(self, words: Sequence[bytes]) -> bytes:
        known, out = self._words, []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self.word(w).tobytes()
                if len(w) <= LONGEST:
                    known.put(w, ids, len(w) + len(ids))
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, added tokens included, packed as little-endian unsigned 32-bit integers."""
        vocab = self._vocab
        if not any(t in text for t in vocab.added):
            return self._packed(vocab.words(text))
        out, at = [], 0
        for found in vocab.special.finditer(text):
            out += [self._packed(vocab.words(text[at: found.start()])), struct.pack("<I", vocab.added[found[0]])]
            at = found.end()
        return b"".join([*out, self._packed(vocab.words(text[at:]))])

    def encode_units(self, units: Sequence[str]) -> list[bytes]:
        """Packed ids of many texts."""
        return list(map(self.encode, units))

    def decode(self, packed: bytes) -> str:
        """Text of packed ids; bytes that are no UTF-8 become replacement characters."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self._table.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[PrefixBpe, UnitEncoder]:
    """The worker's codec for a vocabulary file, with what it remembers."""
    bpe = PrefixBpe(path)
    return bpe, UnitEncoder(bpe.encode_units)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode the ids, and return digests: id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty (no ids, empty text); rows that repeat come out as often as they come in; an id that is
    null is passed on.  Rows stay in their partitions: nothing is shuffled.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                            ("decoded_sha256", pa.string())])
        bpe, encode = codec(path)
        for batch in sliced(batches, "text"):
            packed = encode(strings(batch.column("text")))
            yield record_batch(
                schema, doc_id=batch.column("doc_id"), n_tokens=[len(p) // 4 for p in packed],
                ids_sha256=[hashlib.sha256(p).hexdigest() for p in packed],
                decoded_sha256=[hashlib.sha256(bpe.decode(p).encode()).hexdigest() for p in packed])

    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """All columns of the documents and the ids of each text as an array; a null text has no ids.

    The array is the last column; its name gets underscores in front if the documents have a column of that name.  A column
    that is no text is read as text and passed on as it is.
    """
    out = free_name(docs, out)
    wide = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    is_text = dict(docs.dtypes)[docs.select(text_col).columns[0]] == "string"
    read = docs.select(text_col).columns[0] if is_text else free_name(docs, "_text")
    source = docs if is_text else docs.withColumn(read, docs[text_col].cast("string"))
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = codec(path)
        for batch in sliced(batches, read):
            packed = encode(strings(batch.column(read)))
            sizes = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(sizes), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], ids], names=[*batch.schema.names[:n], out])

    return source.mapInArrow(run, wide)
