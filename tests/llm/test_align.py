"""Token alignment against a plain walk over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clauselake.llm import align
from clauselake.llm.units import byte_of_char

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)))
def test_cuts_are_the_common_ends(a, b):
    a, b = sorted(a | {61}), sorted(b | {61})
    cuts_a, cuts_b = align.common_cuts(np.array(a), np.array(b))
    common = sorted(set(a) & set(b))
    assert [a[i - 1] for i in cuts_a] == common == [b[j - 1] for j in cuts_b]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 1000])
def test_long_diagonals_with_a_break(n):
    ends = list(range(1, n + 1))
    assert [c.tolist() for c in align.common_cuts(np.array(ends), np.array(ends))] == [ends, ends]
    for at in {0, n // 2, n - 1}:
        a, b = ends + [n + 2, n + 3], ends[:at] + ends[at + 1:] + [n + 1, n + 3]
        cuts_a, cuts_b = align.common_cuts(np.array(a), np.array(b))
        assert [a[i - 1] for i in cuts_a] == sorted(set(a) & set(b)) == [b[j - 1] for j in cuts_b]


def brute_force(rows):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)
    stand_in = byte_of_char()
    counts, docs = Counter(), []
    for doc_id, text in rows:
        e = library.encode(" " + text, add_special_tokens=False) if text else None
        a = list(zip(e.ids, [bytes(stand_in[c] for c in t) for t in e.tokens])) if text else []
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode())
             for i in (pieces.encode(text) if text else []) for p in [pieces.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            docs.append((doc_id, [], [], [], ""))
            continue

        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((at, at + len(x), i))
                at += len(x)
            return out

        sa, sb = spans(a), spans(b)
        links = [(x[2], y[2]) for x in sa for y in sb if x[0] < y[1] and y[0] < x[1]]
        counts.update(links)
        groups, start = [], 0
        for end in sorted({x[1] for x in sa} & {y[1] for y in sb}):
            groups.append("|".join(",".join(str(i) for s, t, i in side if start <= s and t <= end) for side in (sa, sb)))
            start = end
        docs.append((doc_id, sa, sb, links, ";".join(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [(doc_id, len(sa), len(sb), g.count("|"), len(links), sum(counts[p] == best[p[1]] for p in links),
             sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for doc_id, sa, sb, links, g in docs]


def some_texts(texts):
    rng = random.Random(2)
    letters = " \n\t'aseltdn1.,!<|> é日　🙂́\x1c\0"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    return [*[t[:400] for t in texts], *odd, None, "", " ", "x", "<s> a</s>", "<|endoftext|>", "▁a", "a ▁", "<0x0A>\n", "word " * 60, "\n" * 50, "a" + " " * 5000 + "b", "日本 " + "\n" * 300]


@pytest.mark.parametrize("lookup", [align.LOOKUP_PAIRS, 0])
def test_equals_brute_force(spark, texts, lookup):
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(some_texts(texts))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, a string, row int").repartition(3)
    got = align.link_statistics(docs, A, B, lookup=lookup)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_force(rows), key=repr)


def test_groups_have_the_bytes_of_the_text(spark, texts):
    pair = align.tokenizer_pair(A, B)
    for r in align.aligned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B).collect():
        text = texts[r.doc_id]
        assert (r.a_cuts[-1:], r.b_cuts[-1:]) == (([len(r.a)], [len(r.b)]) if r.a else ([], []))
        for (i, k), (j, m) in zip(zip([0, *r.a_cuts], r.a_cuts), zip([0, *r.b_cuts], r.b_cuts)):
            assert b"".join(pair.bytes_a[x] for x in r.a[i:k]) == b"".join(pair.bytes_b[x] for x in r.b[j:m])
        if r.a:
            assert b"".join(pair.bytes_a[x] for x in r.a) == b" " + text.encode()


def test_no_rows(spark):
    for rows in ([], [(1, None)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = align.link_statistics(docs, A, B)
        assert [tuple(r) for r in got.collect()] == [(1, 0, 0, 0, 0, 0, 0, "") for _ in rows]
