import numpy as np
import pytest

from clauselake.llm import ann


def brute(rows, k, every):
    """(query, ids and scores) over the vectors that take part."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and len(v) == 8
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, q in good:
        if i % every == 0:
            s = (x * q).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 8)) * rng.uniform(0.5, 2, (1500, 1))
    x[::7] = x[3]  # one vector holds a seventh of all rows
    out = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    return out + [(2000, None), (2020, [0.0] * 8), (2040, [1.0] * 7 + [float("nan")]), (2060, [None] + [1.0] * 7),
                  (2080, [float("inf")] + [1.0] * 7), (2100, [1.0]), (None, [1.0] * 8), (2120, [])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def test_recall_and_scores(spark, rows, monkeypatch):
    monkeypatch.setattr(ann, "LIST_VECTORS", 40)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    expected = brute(rows, 20, 20)
    got: dict = {}
    for r in ann.nearest(frame(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(expected)
    hits = 0
    for q, near in expected.items():
        assert [g[0] for g in got[q]] == list(range(1, 21)) and q not in [g[1] for g in got[q]]
        assert [(-s, v) for _, v, s in got[q]] == sorted((-s, v) for _, v, s in got[q])
        hits += len({v for v, _ in near} & {g[1] for g in got[q]})
    assert hits >= 0.9 * 20 * len(expected)


def test_small_tables(spark, rows):
    few = rows[:9] + rows[-8:]
    got = {}
    for r in ann.nearest(frame(spark, few), every=1).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, round(r.score, 9))
    expected = {q: {n + 1: (v, round(s, 9)) for n, (v, s) in enumerate(near)} for q, near in brute(few, 20, 1).items()}
    assert got == expected
    assert ann.nearest(frame(spark, rows).limit(0)).collect() == []
    assert ann.nearest(frame(spark, rows[:1])).collect() == []


def test_rows_that_repeat_an_id_are_one_candidate(spark):
    rng = np.random.default_rng(8)
    others = [(i, rng.normal(size=8)) for i in range(2, 40) if i != 20]
    query = rng.normal(size=8)
    for copies in ([5 * query] * 25, [5 * query + i * 1e-3 for i in range(25)]):
        rows = [(20, query), *others, *((1, v) for v in copies)]
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
        got = [(r.vec_id, r.score) for r in ann.nearest(df).filter("query_id = 20").orderBy("rank").collect()]
        best = {}
        for i, v in rows[1:]:
            best[i] = max(best.get(i, -np.inf), float(v @ query))
        wanted = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [i for i, _ in got] == [i for i, _ in wanted] and np.allclose([s for _, s in got], [s for _, s in wanted])


@pytest.mark.parametrize("kind", ["queries apart", "crowd", "tiny"])
def test_recall_on_other_rows(spark, monkeypatch, kind):
    """Queries unlike the other rows, half of all rows far closer than they are long, and squares below single precision."""
    monkeypatch.setattr(ann, "LIST_VECTORS", 40)
    rng = np.random.default_rng(4)
    n = 8000
    x = rng.normal(size=(30, 8))[rng.integers(30, size=n)] + 0.05 * rng.normal(size=(n, 8))
    if kind == "queries apart":
        x[::40] = rng.normal(size=(n // 40, 8))
    elif kind == "crowd":
        x[rng.random(n) < 0.8] = x[0]
        x += 1e-4 * rng.normal(size=x.shape)
    else:
        x = 1e-25 * rng.normal(size=(n, 8))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got: dict = {}
    for r in ann.nearest(frame(spark, rows), k=2, every=40).collect():
        got.setdefault(r.query_id, []).append(r.score)
    hits = [min(2, sum(s >= near[-1][1] for s in got[q])) for q, near in brute(rows, 2, 40).items()]
    assert sum(hits) >= 0.95 * 2 * len(hits)


def test_a_query_is_one_row_however_many_lists_it_looks_into(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_VECTORS", 20)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(3000, 8)))]
    kept, stored = {}, ann.stored
    monkeypatch.setattr(ann, "stored", lambda df, name: kept.setdefault(name, stored(df, name)))
    assert ann.nearest(frame(spark, rows)).count() == 150 * 20
    assert kept["ann-queries"].count() == 150


def test_walks_in_step_are_the_walks_one_by_one():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 8))
    lists = ann.fit(x, float(np.sqrt((x**2).sum(axis=1)).max()), 60)
    sizes = rng.integers(1, 40, len(lists.centroids)).astype(float)
    aimed = lists.aimed(rng.normal(size=(ann.WALKED + 40, 8)))
    for ratio in (1.0, 1.1, 1.5):
        for least in (0, 100):
            some = ann.replace(lists, ratio=ratio)
            one_by_one = [sorted(set(some.walk(q, sizes, least))) for q in aimed]
            in_step = [np.flatnonzero(w).tolist() for w in some.walks(aimed, sizes, least)]
            assert sum(a == b for a, b in zip(one_by_one, in_step)) >= 0.97 * len(aimed)
