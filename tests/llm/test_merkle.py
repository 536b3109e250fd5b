"""The Merkle manifest against plain trees."""

import hashlib
import random
import zlib

import pytest

from clauselake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def tree(nodes):
    """The root, and the siblings left and right of each leaf by level."""
    paths = [[] for _ in nodes]
    level = [(h, [i]) for i, h in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), 3):
            run = level[at: at + 3]
            for i, (_, under) in enumerate(run):
                for x in under:
                    paths[x].append(([h for h, _ in run[:i]], [h for h, _ in run[i + 1:]]))
            above.append((digest(h for h, _ in run), [x for _, under in run for x in under]))
        level = above
    return level[0][0], paths


def expected(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        trees[name] = tree([leaf(r) for r in by_source[name]])
    if not names:
        return []
    root, tops = tree([trees[n][0] for n in names])
    out = []
    for name, top in zip(names, tops):
        for row, path in zip(by_source[name], trees[name][1]):
            text = row[4]
            if text is not None and zlib.crc32(("" if row[0] is None else str(row[0])).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf((*row[:4], text))
            for left, right in [*path, *top]:
                folded = digest([*left, folded, *right])
            proof = digest(h for left, right in [*path, *top] for h in (*left, *right))
            out.append((row[0], leaf(row), trees[name][0], root, proof, folded, folded == root))
    return out


def random_rows(seed, n, sources):
    rng = random.Random(seed)
    texts = [None, "", "a\nb", "plain", "\n\n", "ü\n" * 50, "x" * 3000]
    return [(None if rng.random() < 0.05 else rng.randrange(n), rng.choice(sources), rng.choice([None, "en"]),
             rng.choice([None, 3, -7]), rng.choice(texts)) for _ in range(n)]


def found(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("n, sources, height", [
    (0, [None], 1), (10, ["a"], 2), (90, [None, "", "b", "ä", "B"], 1), (300, ["hot"] * 4 + [f"s{i}" for i in range(40)], 1)])
def test_equals_plain_trees(spark, n, sources, height):
    rows = random_rows(n, n, sources)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = found(merkle.verified(merkle.Manifest(height=height).append(docs)))
    assert got == sorted(expected(rows), key=repr)


def test_appends_equal_one_append(spark):
    rows = [(i, ["a", None, "b"][i % 7 % 3], "en", i, f"line\n{i}") for i in range(100)]
    manifest = merkle.Manifest(height=1)
    for lo, hi in ((0, 1), (1, 40), (40, 40), (40, 100)):
        manifest = manifest.append(spark.createDataFrame(rows[lo:hi], SCHEMA))
    assert found(merkle.verified(manifest)) == sorted(expected(rows), key=repr)


def test_closed_blocks_are_not_written_again(spark):
    rows = [(i, "a", "en", i, "t") for i in range(20)]
    first = merkle.Manifest(height=2).append(spark.createDataFrame(rows[:10], SCHEMA))
    second = first.append(spark.createDataFrame(rows[10:], SCHEMA))
    assert second.closed[0] is first.closed[0] and first.closed[0].count() == 9
    assert sorted(r["doc_id"] for r in second.closed[1].select("doc_id").collect()) == list(range(9, 18))
    assert [r["doc_id"] for r in second.open.orderBy("pos").collect()] == [18, 19]


def test_other_columns_and_repeated_rows(spark):
    rows = [(1, "a", "en", 1, "x\ny")] * 4
    docs = spark.createDataFrame([(*r, "p", "q", 0, 1) for r in rows], SCHEMA + ", leaf string, tree string, pos int, n int")
    assert found(merkle.merkle_manifest(docs)) == sorted(expected(rows), key=repr)


def test_witnesses_are_extended_by_later_siblings():
    stream = merkle.Appender()
    a, b, c, d = (hashlib.sha256(x).digest() for x in (b"a", b"b", b"c", b"d"))
    stream.append(a)
    stream.append(b)
    assert stream.witnesses == [bytearray(), bytearray()]
    stream.append(c)
    assert [merkle.siblings(w) for w in stream.witnesses] == [[b, c], [a, c], [a, b]]
    stream.append(d)
    root = stream.root(None)
    assert all(merkle.folded(x, bytes(w)) == root for x, w in zip((a, b, c, d), stream.witnesses))
    assert root == merkle.parent([merkle.parent([a, b, c]), merkle.parent([d])])
