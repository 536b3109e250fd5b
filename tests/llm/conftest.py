"""Small documents with the hard cases, shared by the operator tests."""

import random

import pytest

ODD = ["", " ", "\n", "a", "A  a\tA", "don't  stop\n now", "　x y", "naïve café", "日本語 テキスト", "<|endoftext|> end", "ab" * 2000]


@pytest.fixture(scope="session")
def texts():
    """Prose with copies, near copies, blanks and odd texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéñü") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 120))) for _ in range(60)]
    near = []
    for t in base[:25]:
        for _ in range(rng.randint(1, 6)):
            w = t.split()
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(words)
            near.append(" ".join(w))
    blanks = [t.replace(" ", "  \n") for t in base[:5]]
    return [*base, *near, *blanks, *base[:8], *ODD, " ".join(base) * 3]


@pytest.fixture(scope="session")
def corpus(spark, texts):
    """doc_id, text, lang, source and a clashing column; nulls in every column."""
    rows = [(i, t, "xy"[i % 2] if i % 7 else None, f"s{i % 4}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "last one", "x", "s0", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long").repartition(5)


@pytest.fixture(scope="session")
def empty(corpus):
    return corpus.limit(0)
