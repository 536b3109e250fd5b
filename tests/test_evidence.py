import random

import pytest
from pyspark.sql import functions as F

from clauselake.operators import evidence
from clauselake.profiles import NUMBER_PATTERN, STANDARD_MODALS
from models import aligned, places


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def align(spark, answer, sources, question=None):
    a = frame(spark, [(1, answer, question)], "id int, text string, question string")
    s = frame(spark, [(1, i, t) for i, t in enumerate(sources)], "id int, ev_no int, text string")
    r = evidence.align_modals(a, s, "id", question="question" if question else None).collect()[0]
    return r.text, r.n_changes


def test_anchor_places(spark):
    text = "建筑不应低于应有高度，宜可严禁。\n必须"
    rows = evidence.anchors(frame(spark, [(1, text), (2, ""), (3, None)], "id int, t string"), ["id"], "t", STANDARD_MODALS.pattern)
    got = [(r.pos, r.prefix, r.word, r.suffix) for r in rows.orderBy("no").collect()]
    assert got == places(text, STANDARD_MODALS.pattern)


@pytest.mark.parametrize("answer,sources,want", [
    ("住宅间距应大于三十米。", ["住宅间距宜大于三十米。"], ("住宅间距宜大于三十米。", 1)),
    ("住宅间距不应小于三十米。", ["住宅间距宜大于三十米。"], ("住宅间距不应小于三十米。", 0)),
    ("完全不同应有别", ["住宅间距宜大于三十米。"], ("完全不同应有别", 0)),
    ("绿地应设置座椅，道路宜设置照明", ["绿地宜设置座椅，道路应设置照明"], ("绿地宜设置座椅，道路应设置照明", 2)),
    ("公园应设置厕所", ["公园可设置厕所", "公园宜设置厕所"], ("公园可设置厕所", 1)),
    ("公园应设置厕所", [], ("公园应设置厕所", 0)),
])
def test_alignment(spark, answer, sources, want):
    assert align(spark, answer, sources) == want


def test_quoted_question_is_protected(spark):
    q = "幼儿园服务半径不应大于多少米？"
    source = ["幼儿园服务半径宜大于多少米"]
    answer = f"未查询到“{q}”的依据，幼儿园服务半径不应大于多少米"
    assert align(spark, answer, source)[1] == 2
    text, n = align(spark, answer, source, q)
    assert n == 1 and q in text


def test_alignment_matches_all_pairs_model(spark):
    rng = random.Random(4)
    alphabet = ["住", "宅", "间", "大", "小", "应", "宜", "不应", "可", "米"]
    rows, sources, want = [], [], {}
    for i in range(150):
        base = [rng.choice(alphabet) for _ in range(rng.randint(5, 40))]
        answer = "".join(base)
        texts = ["".join(rng.choice(alphabet) if rng.random() < 0.15 else c for c in base) for _ in range(rng.randint(1, 3))]
        rows.append((i, answer))
        sources += [(i, n, t) for n, t in enumerate(texts)]
        want[i] = aligned(answer, texts, STANDARD_MODALS.pattern, 5, STANDARD_MODALS.direction_chars)
    a, s = frame(spark, rows, "id int, text string"), frame(spark, sources, "id int, ev_no int, text string")
    got = {r.id: r.text for r in evidence.align_modals(a, s, "id").collect()}
    assert got == want


@pytest.mark.parametrize("answer,source,want", [
    ("服务半径不应大于500m，", "服务半径不应大于300m，", ("服务半径不应大于300m，", 1)),
    ("面积为3.0m的房间", "面积为3.0m²的房间", ("面积为3.0m²的房间", 1)),
    ("高度应大于20m的楼", "高度应小于30m的楼", ("高度应大于20m的楼", 0)),
    ("宽度为5 m的路面宽", "宽度为5m的路面宽", ("宽度为5 m的路面宽", 0)),
])
def test_numbers(spark, answer, source, want):
    a = frame(spark, [(1, answer)], "id int, text string")
    s = frame(spark, [(1, 0, source)], "id int, ev_no int, text string")
    r = evidence.align_numbers(a, s, "id").collect()[0]
    assert (r.text, r.n_changes) == want


def test_number_anchors(spark):
    text = "范围300m~500m，占35 %以上"
    rows = evidence.anchors(frame(spark, [(1, text)], "id int, t string"), ["id"], "t", NUMBER_PATTERN).orderBy("no").collect()
    assert [(r.pos, r.word) for r in rows] == [(2, "300m"), (7, "500m"), (13, "35 %")]


@pytest.mark.parametrize("text,want", [
    ("答案\n## 补充说明\n多余\n更多\n## 依据\n保留", "答案\n## 依据\n保留"),
    ("答案\n\n**备注**：多余\n续行\n\n结尾", "答案\n\n结尾"),
    ("答案\n**关于面积的补充**：x\n**结论**：保留", "答案\n**结论**：保留"),
    ("没有附加内容", "没有附加内容"),
    ("答案\n### 说明（仅供参考）\n" + "行\n" * 20000, "答案"),
])
def test_sections(spark, text, want):
    r = frame(spark, [(text,)], "t string").select(evidence.strip_sections(F.col("t")).alias("s")).collect()[0].s
    assert r.text == want and r.removed == len(text) - len(want)


def test_detect(spark):
    text = "a\n## 另注 x\nb\n\n**附注**：" + "c" * 80
    rows = frame(spark, [(text,)], "t string").select(F.inline(evidence.detect_sections(F.col("t")))).collect()
    assert [r.label for r in rows] == ["heading", "bold_label", "inline_note"]
    assert rows[1].preview == " **附注**：" + "c" * 52 and rows[2].preview == rows[1].preview


@pytest.mark.parametrize("raw,want", [
    ('{"grounded": true, "issues": []}', (True, [], True)), ('x {"grounded": true, "issues": ["a", " "]} y', (False, ["a"], True)),
    ('{"issues": "text"}', (True, [], True)), ('{"grounded": null}', (False, [], True)), ('{"grounded": "no"}', (True, [], True)),
    ('{"grounded": 0.0}', (False, [], True)), ("none", (True, [], False)), ("{bad}", (True, [], False)), (None, (True, [], False)),
    ('{"issues": [1, 2.5, null, {"a": 1}]}', (False, ["1", "2.5"], True)),
])
def test_verdicts(spark, raw, want):
    r = frame(spark, [(raw,)], "t string").select(evidence.parse_verdict(F.col("t")).alias("v")).collect()[0].v
    assert (r.grounded, list(r.issues), r.verified) == want


def test_references(spark):
    r = frame(spark, [("见[1][02][3] 建标[2015] [0]",)], "t string").select(
        evidence.references(F.col("t")).alias("r"), evidence.dangling(F.col("t"), F.lit(2)).alias("d")
    ).collect()[0]
    assert (r.r, r.d) == ([1, 2, 3, 0], [3, 0])


def test_tiers_skip_other_words(spark):
    df = frame(spark, [(1, "应用不算，适宜不算，应算，宜算，不应算，不可算，可不算")], "id int, t string")
    got = {r.tier: r.n for r in evidence.modal_tiers(df, "id", "t").collect()}
    assert got == {"must": 2, "should": 1, "may": 1}
