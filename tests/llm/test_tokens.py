import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clauselake.llm import bpe, tokens, units
from clauselake.llm.units import UnitEncoder, Vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n: int) -> list[str]:
    rng = random.Random(1)
    letters = " \n\t'aseltdn1.,!<|> é日　🙂́\x1c"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_encoding_equals_the_library(library, texts):
    codec = bpe.PrefixBpe(PATH)
    some = [*texts, *random_texts(3000), "x<|endoftext|> y  <|endoftext|>", "a" * 3000, " " * 500 + "b"]
    expected = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    units = UnitEncoder(codec.encode_units, remember=500)
    got = [np.frombuffer(p, "<u4").tolist() for p in units(some)]
    assert got == expected
    assert [np.frombuffer(codec.encode(t), "<u4").tolist() for t in some] == expected
    decoded = [codec.decode(np.array(e, "<u4").tobytes()) for e in expected]
    assert decoded == [library.decode(e, skip_special_tokens=False) for e in expected]
    assert codec.decode(np.array([library.encode("é").ids[0]], "<u4").tobytes()[:4]) == library.decode(library.encode("é").ids[:1])


def test_every_token_encodes_to_itself():
    codec = bpe.PrefixBpe(PATH)
    codec._whole = {}
    assert all(list(codec.word(t)) == [i] for t, i in Vocabulary(PATH).ids.items())


def test_encode_decode_rows(corpus, empty, library):
    rows = {r.doc_id: r for r in corpus.collect()}
    got = bpe.encode_decode(corpus, PATH).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    for r in got:
        ids = library.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((rows[r.doc_id].text or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, PATH).collect() == []


def test_token_ids_keep_all_columns(corpus, library):
    got = bpe.token_ids(corpus.withColumnRenamed("size", "n_tokens"), PATH)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_tokens", "ids"]
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids for r in got.collect())
    for taken, name in (("ids", "_ids"), ("IDS", "_ids")):
        got = bpe.token_ids(corpus.withColumnRenamed("size", taken), PATH)
        assert got.columns == ["doc_id", "text", "lang", "source", taken, name]
        assert got.filter("doc_id = 3").first()[name] == library.encode(corpus.filter("doc_id = 3").first().text).ids
    numbers = bpe.token_ids(corpus.select("doc_id"), PATH, "doc_id").collect()
    assert all(r.ids == library.encode(str(r.doc_id)).ids for r in numbers)


def test_remembered_units_are_bounded():
    recent = units.Recent(40 * units.Recent.ENTRY)
    for i in range(1000):
        recent.put(str(i), b"", 0)
        assert recent.get("0") == b"" and len(recent.young) + len(recent.old) <= 44
    assert recent.get("500") is None


def test_a_small_memory_changes_no_ids(texts, library):
    encode = units.UnitEncoder(lambda us: [np.array(library.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in us], 4000)
    for _ in range(2):
        for text, packed in zip(texts, [encode([t])[0] for t in texts]):
            assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


class Held:
    """Bytes with the reading call of a file."""

    def __init__(self, data: bytes):
        self._data = data

    def read_at(self, size: int, offset: int) -> bytes:
        return self._data[offset: offset + size]


@pytest.mark.parametrize("top", [200, 60_000, 2**32 - 1])
def test_shards_give_random_access(top):
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, top, n, dtype=np.uint32, endpoint=True) for n in (1, 0, 700, 3000, 5)]
    shard = tokens.ShardReader(Held(b"".join(tokens.pack_shard([7, None, -3, 2**60, 9], docs))))
    everything = np.concatenate(docs)
    ids, starts = shard.documents()
    assert ids == [7, None, -3, 2**60, 9] and starts.tolist() == [0, 1, 1, 701, 3701, 3706]
    for i in rng.integers(0, len(everything), 400).tolist():
        assert shard.token(i) == everything[i]
    for _ in range(60):
        a, b = sorted(rng.integers(0, len(everything) + 1, 2).tolist())
        assert (shard.slice(a, b) == everything[a:b]).all()
    with pytest.raises(IndexError):
        shard.token(len(everything))


@pytest.mark.parametrize("shard_ids,read_ids", [(tokens.SHARD_IDS, tokens.READ_IDS), (300, 50)])
def test_files_round_trip(spark, corpus, empty, library, tmp_path, monkeypatch, shard_ids, read_ids):
    monkeypatch.setattr(tokens, "READ_IDS", read_ids)
    listed = tokens.write_tokens(corpus, PATH, str(tmp_path / "t"), shard_ids=shard_ids)
    got = {r.doc_id: r for r in tokens.read_tokens(listed, str(tmp_path / "t")).collect()}
    at = 0
    for r in sorted(corpus.collect(), key=lambda r: r.doc_id):
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    nothing = tokens.write_tokens(empty, PATH, str(tmp_path / "e"))
    assert tokens.read_tokens(nothing, str(tmp_path / "e")).collect() == []


def test_missing_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (5, "b c"), (5, "b c"), (2, None)], "doc_id long, text string")
    got = tokens.read_tokens(tokens.write_tokens(df, PATH, str(tmp_path / "t")), str(tmp_path / "t")).collect()
    assert sorted((r.start, r.doc_id) for r in got) == [(0, None), (2, 2), (3, 5), (6, 5)]
