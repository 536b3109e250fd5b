import random

import pytest

from clauselake.llm import langid

SYLLABLES = {"aa": ["the", "ing", "ther", "wh", "on"], "bb": ["sch", "ung", "heit", "lich", "ein"], "cc": ["при", "вет", "мир", "ова", "то"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, prose(lang, rng.randint(3, 60), rng), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=300))]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 -- 34!", None), (403, prose("aa", 40, rng) + " " + prose("bb", 40, rng) + "! " + prose("cc", 30, rng), None), (None, prose("bb", 30, rng), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)


def test_languages_and_spans(docs):
    rows = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    import zlib

    for i, r in rows.items():
        assert got[i].held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2)
        if i is not None and i < 300:
            assert got[i].lang_pred == r.lang and 0.5 < got[i].score <= 1
    assert [got[i].lang_pred for i in (400, 401, 402, None)] == ["und", "und", "und", "bb"]
    assert got[400].score == 0 and got[402].spans == []
    mixed = got[403].spans
    assert [s.lang for s in mixed] == ["aa", "bb", "cc"]
    text = rows[403].text
    assert mixed[0].start == 0 and mixed[-1].end == len(text) and abs(mixed[1].end - text.index("!")) < 25


def test_viterbi_is_the_best_path():
    """Against trying every labelling of a few words."""
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(1)
    model = [(x, np.zeros(1 << langid.BITS, "<f4").tobytes(), [2]) for x in "abc"]
    labels = langid.Identifier(model, penalty=3.0)
    for _ in range(60):
        s = rng.normal(size=(6, 3)) * 2.5
        path = labels._path(s, s.sum(axis=0))

        def value(p):
            return sum(s[i, c] for i, c in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))

        assert value(path) == pytest.approx(max(map(value, product(range(3), repeat=6))))


def test_stage_keeps_columns(docs, spark):
    clash = docs.withColumnRenamed("lang", "score")
    kept = langid.known_language(docs.withColumn("score", docs.lang).withColumn("spans", docs.doc_id))
    assert kept.columns == ["doc_id", "text", "lang", "score", "spans"]
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {400, 401, 402}
    assert clash.columns == ["doc_id", "text", "score"]
    assert langid.identify(docs.limit(0)).collect() == []
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:4] for r in langid.identify(nothing).collect()] == [("und", 0.0)]


def test_short_runs_in_another_script_are_spans(spark):
    rng = random.Random(5)
    han = "天地玄黄宇宙洪荒日月盈昃辰宿列张"
    rows = [(i, prose(lang, 40, rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(100 + i, "".join(rng.choice(han) for _ in range(60)), "zh") for i in range(20)]
    words, passage = prose("cc", 3, rng), "".join(rng.choice(han) for _ in range(30))
    inner = [(900, prose("aa", 20, rng), words, prose("aa", 20, rng)), (901, prose("bb", 20, rng), prose("cc", 1, rng), prose("bb", 9, rng)),
             (902, prose("aa", 6, rng), passage, prose("aa", 6, rng))]
    rows += [(i, f"{a} {b} {c}", None) for i, a, b, c in inner] + [(903, "the" + passage * 20 + "the", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for (i, a, b, c), outer, other in zip(inner, ("aa", "bb", "aa"), ("cc", "cc", "zh")):
        assert [(s.start, s.end, s.lang) for s in got[i].spans] == [
            (0, len(a), outer), (len(a) + 1, len(a) + 1 + len(b), other), (len(a) + len(b) + 2, len(a) + len(b) + len(c) + 2, outer)]
        assert got[i].lang_pred == outer and 0.5 < got[i].score <= 1
    assert got[903].lang_pred == "zh" and [s.lang for s in got[903].spans if s.end - s.start > 3] == ["zh"]


def test_words_speak_by_their_letters():
    import numpy as np

    shares = [np.full(1 << langid.BITS, v, "<f4").tobytes() for v in (-9.0, -12.0)]
    labels = langid.Identifier([(x, s, [2]) for x, s in zip("ab", shares)])
    scores = labels._word_scores(langid.Letters(["abc " + "abcd" * 8 + " " + "天" * 9]))
    assert scores[0].tolist() == [0.0, -8.0] and scores[1].tolist() == [0.0, -32.0] and len(scores) == 5


def test_columns_may_have_any_names(spark):
    rng = random.Random(6)
    rows = [(i, prose("aa", 20, rng), "aa", *range(7)) for i in range(8)] + [(8, "--", "aa", *range(7))]
    names = "doc_id long, text string, lang string, Score int, _own_Score int, held_out int, Spans int, lang_pred int, c0_ int, _Text int"
    docs = spark.createDataFrame(rows, names)
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] != 8]
