import hashlib
import random
import re

import pytest

from clauselake.llm import pii

FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(digits[::-1])]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute(text):
    out = []
    for kind, form in FORMS.items():
        for m in form.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_seeds_equal_the_patterns():
    rng = random.Random(3)
    letters = "aZ0123456789.@+-( )_%é,"
    for _ in range(40_000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.seeds(t)] == brute(t), t
    assert pii.seeds("4111 1111-1111 1111, 0255.1.2.3, 999.1.1.1") == [(1, 21, 31), (2, 0, 19)]
    assert pii.seeds("9" * 20_000) == [] and len(pii.seeds("a@b.c" + "@b.c" * 5000)) > 0


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    filler = ["".join(rng.choice("lmnoprst") for _ in range(5)) for _ in range(60)]

    def some():
        return " ".join(rng.choice(filler) for _ in range(6))

    rows = [(i, f"{some()} mail: u{i}@h{i}.org {some()}") for i in range(12)]
    rows += [(100 + i, f"{some()} mail: user{i}(at)host{i} {some()}") for i in range(3)]
    rows += [(200 + i, f"{some()} model {i}xx{i} {some()}") for i in range(9)]
    rows += [(300, None), (301, ""), (302, some()), (None, "mail: q9@z.org")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_contexts_discover_unseen_identifiers(docs):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows.items():
        base = brute(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert got[i].n_email == sum(b.startswith("email") for b in base) and got[i].n_ip == got[i].n_card == got[i].n_phone == 0
        found = [s for s in got[i].spans.split(",") if s]
        assert set(base) <= set(found)
        if i is not None and 100 <= i < 103:
            _, start, end = found[0].split(":")
            assert found[0].startswith("email:") and text[int(start): int(end)].startswith("user")
        else:
            assert found == base


def test_empty_and_repeated(docs, spark):
    assert pii.find_personal_data(docs.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "a@b.c")] * 3, "doc_id long, text string")
    assert [r.spans for r in pii.find_personal_data(same).collect()] == ["email:0:5"] * 3


def test_long_blankless_texts_are_linear():
    text = "a1" * 200_000
    assert pii.slots(text, pii.seeds(text)) == []


def test_long_runs_are_cut_at_their_marks():
    text = "log " + ",".join(f'"k{i}"/user{i}' for i in range(40)) + ",u@h.org end"
    found = pii.slots(text, pii.seeds(text))
    assert {f[0] for f in found} == {"u@h.org", *(f"k{i}" for i in range(40)), *(f"user{i}" for i in range(40))}
    assert all(text[f[2]: f[3]].lower() == f[0] for f in found)
    word = "x" * 300
    assert pii.slots(f"{word} a1", [])[0][4] == word


def test_rounds_go_on_until_nothing_is_new(spark):
    rows, n = [], 0
    for step in range(7):
        before = [f"u{i}@h.org" if step == 0 else f"id{step}x{i}" for i in range(4)]
        rows += [f"lab{step} {x} tail{n + i}" for i, x in enumerate(before)]
        rows += [f"lab{step} id{step + 1}x{i} more{n + i}" for i in range(4)]
        n += 4
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    assert all(got[i].startswith("email:5:") for i in range(len(rows)))


def test_labels_glued_to_values(spark):
    forms = ["mailto:{}", '{{"email":"{}","id":1}}', "contact={}", "邮箱：{}谢谢"]
    texts = [f.format(f"u{i}@h{i}.org") + f" t{i}" for f in forms for i in range(12)]
    hidden = [f.format(f"user{i}x") + f" v{i}" for i, f in enumerate(forms)]
    docs = spark.createDataFrame(list(enumerate(texts + hidden)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(docs).collect()}
    for i, text in enumerate(hidden):
        at = text.index("user")
        assert f"email:{at}:{at + 6}" in got[len(texts) + i].split(","), (text, got[len(texts) + i])
    assert [x[0] for x in pii.slots("tel:555-1234 at 12:30 aa:bb:01 x=5&y=6", [])] == ["555-1234", "12:30", "aa:bb:01", "5", "6"]


def test_contexts_are_counted_words():
    rng = random.Random(4)
    for _ in range(5000):
        text = "".join(rng.choice('ab1@.:=", /(天') for _ in range(rng.randint(0, 40)))
        counted = set(map(pii._word, pii.WORD.findall(text))) | {""}
        assert all(b in counted and a in counted for *_, b, a in pii.slots(text, pii.seeds(text)))
