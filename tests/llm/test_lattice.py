"""Lattice hashing against all pairs."""

import numpy as np
import pytest

from clauselake.llm import lattice


def brute_force(rows, threshold=0.9):
    """vec_id, n_links, component_id, kept of each row."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold] for i in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        after = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if after == label:
            break
        label = after
    out = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec_id, len(near[i]), component, component is None or component == vec_id))
    return sorted(out, key=repr)


def found(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows],
                               f"vec_id long, embedding array<{kind}>, key int, ball int").repartition(3)
    return sorted(map(tuple, lattice.near_vectors(df, **options).collect()), key=repr)


def clouds(rng, sizes, spread, dims=32):
    """Groups of vectors around random centres."""
    out = []
    for n in sizes:
        centre = rng.normal(size=dims)
        out += list(centre + spread * rng.normal(size=(n, dims)))
    return out


def test_lattice_points_are_the_nearest():
    rng = np.random.default_rng(1)
    y = rng.uniform(-3, 3, (500, 8))
    points = lattice.decoded(y)
    assert (np.rint(2 * points) == 2 * points).all() and ((points.sum(axis=1) % 2) == 0).all()
    assert all((p == np.rint(p)).all() or (p - 0.5 == np.rint(p - 0.5)).all() for p in points)
    steps = lattice.steps()
    assert len(np.unique(steps, axis=0)) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    here = ((y - points) ** 2).sum(axis=1)
    assert all((here <= ((y - points - s) ** 2).sum(axis=1) + 1e-9).all() for s in steps)


def test_probed_keys_are_those_of_the_neighbouring_cells():
    own = lattice.Tables(16, 2, 1.6, 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    keys = own.keys(x)
    assert (keys & 0xFF == np.arange(3)[None, :, None]).all()
    assert all(len(set(k)) == lattice.PROBES + 1 for row in keys for k in row)
    assert (own.keys(x[7:8])[0] == keys[7]).all()


@pytest.mark.parametrize("spread, sizes", [(0.02, [1] * 60 + [2, 3, 40, 90]), (0.16, [1] * 40 + [30, 70, 100])])
def test_equals_brute_force(spark, monkeypatch, spread, sizes):
    for name, value in (("CROWDED", 4), ("SMALL", 16), ("BLOCK", 8), ("SLICE", 32)):
        monkeypatch.setattr(lattice, name, value)
    monkeypatch.setattr(lattice, "MISS", 1e-7)
    lattice.tables.cache_clear()
    rng = np.random.default_rng(3)
    vectors = clouds(rng, sizes, spread)
    vectors += vectors[-20:] + [3 * v for v in vectors[-5:]] + vectors[-1:] * 30
    rows = list(enumerate(vectors))
    rng.shuffle(rows := [tuple(r) for r in rows])
    assert found(spark, rows) == brute_force(rows)
    lattice.tables.cache_clear()


def test_pairs_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        a, c = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        c -= (a @ c) * a
        c /= np.linalg.norm(c)
        share = 0.9005 if i % 2 else 0.8995
        rows += [(2 * i, a), (2 * i + 1, share * a + np.sqrt(1 - share**2) * c)]
    got = {r[0]: r[1] for r in found(spark, rows)}
    wanted = {r[0]: r[1] for r in brute_force(rows)}
    assert all(got[i] <= wanted[i] for i in wanted)  # none below the threshold
    assert sum(got.values()) >= 0.99 * sum(wanted.values())


def test_vectors_that_take_no_part_repeated_ids_and_lengths(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]),
            (7, e), (7, e), (8, [1e200, 0.0, 0.0]), (9, [1.0, 0.1, 0.0]), (9, [0.0, 0.0, 1.0]), (10, [1.0, 0.0]), (11, [1e-300, 0.0]),
            (None, e), (None, [0.0, 1.0, 0.0]), (12, [-1.0, 0.0, 0.0]), (13, [5.0]), (14, [2.0]), (15, [-1.0])]
    got, wanted = found(spark, rows), brute_force([(i, v) for i, v in rows if i not in (8, 11)] + [(8, e), (11, [1.0, 0.0])])
    assert got == wanted
    assert found(spark, [], "float") == []
    assert found(spark, [(1, e), (2, None)], "float") == [(1, 0, 1, True), (2, 0, 2, True)]
