import hashlib
import re
from collections import defaultdict

import pytest

from clauselake.llm import mixing


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Weights 3, 1, 2 by code point, null last; what is above twice the size is shared again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = {}, 1.5 * sum(sizes.values())
    while True:
        rest = {s: weight[s] for s in order if s not in full}
        share = {s: (total - sum(full.values())) * w / sum(rest.values()) for s, w in rest.items()}
        above = [s for s in rest if share[s] > 2 * sizes[s]]
        if not above:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in above}


@pytest.mark.parametrize("share", [10_000, 10])
def test_targets_and_taken(corpus, monkeypatch, share):
    monkeypatch.setattr(mixing, "PART_ROWS", share)
    rows = corpus.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += size_of(r.text)
    targets = brute_targets(dict(sizes))
    got = mixing.mix(corpus).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    # brute force: all copies in the order of their finish times, as long as they fit
    queues, copies = defaultdict(list), []
    by_id = {r.doc_id: r for r in rows}
    for r in rows:
        queues[r.source].append((hashlib.md5(f"0:{r.doc_id}".encode()).hexdigest(), r.doc_id))
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    for rank, source in enumerate(order):
        done = 0
        for turn in range(2):
            for key, i in sorted(queues[source]):
                n = size_of(by_id[i].text)
                done += n
                if n:
                    copies.append((done / targets[source], rank, key, i, n, turn))
    taken, used = defaultdict(int), 0
    for _, _, _, i, n, _ in sorted(copies):
        used += n
        if 2 * used > 3 * sum(sizes.values()):
            break
        taken[i] += n
    for r in got:
        assert (r.size, r.source_size, r.taken) == (size_of(by_id[r.doc_id].text), sizes[by_id[r.doc_id].source], taken[r.doc_id])
        assert r.target == pytest.approx(targets[by_id[r.doc_id].source]) and r.taken <= 2 * r.size


def test_mixed_documents(corpus, empty, spark):
    shares = {r.doc_id: r.taken // r.size if r.size else 0 for r in mixing.mix(corpus).collect()}
    mixed = mixing.mixed_documents(corpus)
    assert mixed.columns == corpus.columns
    seen = defaultdict(int)
    for r in mixed.collect():
        seen[r.doc_id] += 1
    assert dict(seen) == {i: n for i, n in shares.items() if n}
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0), (0, 0)]
    same = spark.createDataFrame([(1, "a b", "a")] * 3 + [(None, "c", "a")], "doc_id long, text string, source string")
    assert {r.taken for r in mixing.mix(same).collect()} <= {0, 1, 2, 4} and mixing.mixed_documents(same).count() >= 4
