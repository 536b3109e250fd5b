import random
import zlib

import pytest

from clauselake.llm import toxicity

BAD = ["dolt", "grumbler", "nitwit", "scoundrel"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    terms = [toxicity.Term(w, False, 1.0) for w in dict.fromkeys(words)]
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(3000):
        w = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 8)))
        near = [distance(w, t.text) for t in terms if distance(w, t.text) <= toxicity.edit_limit(len(t.text))]
        got = automaton.match(w)
        assert (got is None) == (not near)
        if got:
            assert got[1] == min(near) == distance(w, terms[got[0]].text)


def test_stems_match_heads_only():
    automaton = toxicity.LexiconAutomaton([toxicity.Term("grum", True, 1.0), toxicity.Term("table", False, 1.0)])
    assert automaton.match("grumbling") == (0, 0) and automaton.match("grim") is None and automaton.match("agrum") is None
    assert automaton.match("tabel") is None and automaton.match("tabl") == (1, 1)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("klmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w = rng.choice(BAD)
                if len(w) > 5 and rng.random() < 0.2:
                    w = w[:3] + "x" + w[3:]
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic), 1))
    rows += [(700, None), (701, ""), (None, "a dolt and nitwit, you dolt"), (703, " ".join(words))]
    labels += [(702, None, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == 604
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    mine = [r for i, r in got.items() if i is not None and i < 600 and r.held_out]
    right = sum(r.predicted == int(r.doc_id % 4 == 0) for r in mine)
    assert right >= 0.97 * len(mine)
    assert got[700].predicted == got[701].predicted == got[703].predicted == 0 and got[None].predicted == 1


def test_without_labels_or_rows(labelled):
    docs, labels = labelled
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels).collect() == []


def test_quotation_is_told_from_abuse():
    scorer = toxicity.Scorer([toxicity.Term("dolt", False, 5.0, 3.0)], toxicity.fit([]))
    said, meant = scorer.score('the word "dolt" is old'), scorer.score("you are a dolt today")
    assert said < 0.5 < meant
    assert [h[3] for h in scorer.hits('he wrote "what a dolt" here, dolt')] == [True, False]
    assert scorer.hits("dollt")[0][2] and not scorer.hits("doltish")


def test_misspellings_absent_from_training(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("klmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(300)] + ["bolt"]
    texts, labels, toxic = [], [], range(0, 600, 2)
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(10, 40))]
        if i in toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["grumbler", "scoundrel", "dolt"]))
        texts.append((i, " ".join(text)))
        labels.append((i, int(i in toxic)))
    texts += [(1000, "krum grumbxler tosk"), (1001, "scondrel"), (1002, "you doltt"), (1003, "scoundrek grumbker"),
              (1010, "a bolt of krum"), (1011, "bolt bolt bolt")]
    got = {r.doc_id: r for r in toxicity.score_toxicity(
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [1] * 4, [got[i].score for i in range(1000, 1004)]
    assert [got[i].predicted for i in (1010, 1011)] == [0, 0]
    assert sum(got[i].predicted == int(i in toxic) for i in range(600)) >= 590


def test_marks_are_paired():
    assert [toxicity.quoted(x.split(), x.split().index("dolt")) for x in (
        'he said "stop" you dolt , then "go"', '"what a dolt you are" he said', 'as “one” he , dolt that he is, “two” said',
        'the " old dolt " here', '"so it was, you dolt then "go"', 'it said “the «old» dolt of old”')] == [
            False, True, False, True, False, True]
