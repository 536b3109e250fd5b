import hashlib
import random
import re
from collections import defaultdict

import pytest

from clauselake.llm import exactdup, neardup


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_duplicates(corpus, empty):
    groups = defaultdict(list)
    rows = corpus.collect()
    for r in rows:
        groups[plain(r.text)].append(r.doc_id)
    got = {r.doc_id: r for r in exactdup.exact_duplicates(corpus).collect()}
    for r in rows:
        ids = groups[plain(r.text)]
        assert tuple(got[r.doc_id]) == (r.doc_id, min(ids), len(ids), r.doc_id == min(ids), hashlib.sha256(plain(r.text).encode()).hexdigest())
    assert exactdup.exact_duplicates(empty).collect() == []
    kept = exactdup.without_copies(corpus)
    assert kept.columns == corpus.columns and sorted(r.doc_id for r in kept.collect()) == sorted(map(min, groups.values()))
    assert exactdup.without_copies(empty).collect() == []


def test_repeated_rows_and_missing_ids(spark):
    rows = [(3, "x"), (3, "x"), (None, "x"), (None, "y"), (None, "y"), (1, "z"), (1, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in exactdup.exact_duplicates(df).collect())
    assert got == sorted([(3, 3, 3, True), (3, 3, 3, False), (-1, 3, 3, False), (-1, -1, 2, True), (-1, -1, 2, False), (1, 1, 1, True), (1, 1, 1, True)])
    assert sorted((r.doc_id or -1, r.text) for r in exactdup.without_copies(df).collect()) == [(-1, "y"), (1, "w"), (1, "z"), (3, "x")]


def test_hot_groups_take_the_broadcast_side(spark, monkeypatch):
    monkeypatch.setattr("clauselake.llm.common.HOT_SHARE", 4)
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i // 6}") for i in range(300)], "doc_id long, text string")
    got = exactdup.exact_duplicates(df).collect()
    assert len(got) == 300 and sum(r.kept for r in got) == 51
    assert {r.group_size for r in got if r.doc_id % 3} == {200}


def test_cuckoo_filter_holds_what_was_inserted():
    rng = random.Random(3)
    keys = [rng.randbytes(32) for _ in range(3000)]
    shard = exactdup.ShardIndex()
    for i, k in enumerate(keys):
        shard.insert(k, i, 1)
    assert shard.resizes > 0 and all(k in shard.filter and shard.find(k) == [i, 1] for i, k in enumerate(keys))
    for k in keys[::2]:
        shard.delete(k, 1)
    assert all(k in shard.filter for k in keys[1::2]) and all(shard.find(k) is None for k in keys[::2])
    assert sum(k in shard.filter for k in keys[::2]) < 50
    again = exactdup.ShardIndex([(k, 1, 1) for k in keys[1::2]], shard.filter.to_bytes())
    assert all(again.find(k) for k in keys[1::2])
    full = exactdup.CuckooFilter(1)
    taken = [k for k in keys if full.insert(k)]
    assert len(taken) < 20 and all(k in full for k in taken)


def test_index_grows_and_shrinks(spark):
    def rows(ids, text):
        return exactdup.digests(spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string"))

    index = exactdup.build_index(rows([4, 5], "a").unionByName(rows([9], "b")), 3)
    index = exactdup.insert(index, rows([1], "a").unionByName(rows([7], "c")))
    index = exactdup.delete(index, rows([9], "b").unionByName(rows([5], "a")).unionByName(rows([5], "unknown")))
    got = {(r.keep_id, r.group_size) for r in exactdup.groups_of(index).collect()}
    assert got == {(1, 2), (7, 1)}


def brute_components(rows, words, percent):
    sets = {i: neardup.shingle_set(t or "", words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words,percent", [(2, 80), (5, 80), (3, 60)])
def test_near_duplicates_brute_force(corpus, words, percent):
    expected = brute_components([(r.doc_id, r.text) for r in corpus.collect()], words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(corpus, words=words, percent=percent).collect()}
    assert got == expected
    assert len({c for _, c in expected.values()}) < len(expected)


def test_hot_buckets_meet_a_broadcast(corpus, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_SHARE", 2000)
    monkeypatch.setattr("clauselake.llm.common.HOT_SHARE", 50)
    plain_ids = {r.doc_id: r.component_id for r in neardup.near_duplicates(corpus, words=2).collect()}
    monkeypatch.setattr(neardup, "HOT_SHARE", 10**9)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(corpus, words=2).collect()} == plain_ids


def test_near_duplicate_stage(corpus, empty, spark):
    expected = brute_components([(r.doc_id, r.text) for r in corpus.collect()], 5, 80)
    kept = neardup.without_near_copies(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert neardup.near_duplicates(empty).collect() == [] and neardup.without_near_copies(empty).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "alone"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got == [(-1, -1, True), (-1, 2, False), (2, 2, True), (2, 2, True), (3, 3, True)]


def test_chains_and_crowds_are_found_without_their_centre(spark, monkeypatch):
    """Copies of a text that is not the least id, far from one another: stragglers must find the centre."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SLICE", 16)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(5):
            w[rng.randrange(120)] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    rows.append((60, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, words=2).collect()}
    assert got == brute_components(rows, 2, 80)


def test_signature_keys_follow_the_pigeonhole():
    import numpy as np

    rng = np.random.default_rng(0)
    m = neardup.chunks_needed(80)
    for _ in range(100):
        a = rng.integers(0, 1 << 16, neardup.PLACES).astype("<u2")
        b = a.copy()
        places = rng.choice(m * neardup.CHUNK, m * (neardup.ERRORS + 1) - 1, replace=False)
        b[places] ^= 1
        ka, kb = neardup.keys_of(np.stack([a, b]), m)
        assert set(ka.tolist()) & set(kb.tolist())
