import pytest
from pyspark.sql import functions as F

from clauselake import profiles as P
from clauselake.operators import quality


def one(spark, text):
    return spark.createDataFrame([(1, "s", text)], "id int, source string, text string")


def test_every_dictionary_entry(spark):
    rows = [(i, f"前{a}后{a}") for i, a in enumerate(P.REPAIRS)]
    done = quality.repair_words(spark.createDataFrame(rows, "id int, text string"), "text").orderBy("id").collect()
    for r, (a, b) in zip(done, P.REPAIRS.items()):
        assert b in r.text and a not in r.text and r.n_words == 2, a


@pytest.mark.parametrize("text,want,n", [
    ("不少于0.35m/人，", "不少于0.35m²/人，", 1), ("0.50mr/人", "0.50m²/人", 1), ("指标（m/人）", "指标（m²/人）", 1),
    ("(mr / 床) 和 2 m/人次", "(m² / 床) 和 2 m²/人次", 2), ("已有0.5m²/人", "已有0.5m²/人", 0), ("线长 20m 每人", "线长 20m 每人", 0),
    ("速度5km/人", "速度5km/人", 0),
])
def test_units(spark, text, want, n):
    r = quality.repair_patterns(one(spark, text), "text").collect()[0]
    assert (r.text, r.n_units) == (want, n)


@pytest.mark.parametrize("text,want,marks,pages", [
    ("甲\n住房城乡建设部信息公开\n浏览专用\n12\n乙", "甲\n乙", 2, 1),
    ("12\n浏览专用\n乙", "乙", 1, 1),
    ("1\n甲\n2\n 浏览专用 ", "1\n甲", 1, 1),
    ("国家发展改革委住房城乡建设部印发的条文\n1\n2", "国家发展改革委住房城乡建设部印发的条文\n1\n2", 0, 0),
    ("浏览专用\n12345\n乙", "12345\n乙", 1, 0),
])
def test_furniture(spark, text, want, marks, pages):
    r = quality.strip_furniture(one(spark, text), "text").collect()[0]
    assert (r.text, r.n_furniture, r.n_page_no) == (want, marks, pages)


def test_census_and_rejoin(spark):
    text = "前句在此\n浏览专用\n7\n后句在此\n信息公开了吗\n信息公开了吗\n浏览专用"
    census = {r.line: r.n for r in quality.line_census(one(spark, text), "text").collect()}
    assert census == {"信息公开了吗": 2}
    around = quality.rejoin_audit(one(spark, text), "id", "text").collect()
    assert [(r.line_no, r.before, r.after) for r in around] == [(1, "前句在此", "后句在此")]


def kinds(spark, text):
    rows = one(spark, text).select(F.inline_outer(quality.scan_issues(F.col("text")))).collect()
    return sorted((r.kind, r.detail) for r in rows if r.kind)


def test_first_scan(spark):
    assert kinds(spark, "贼市规划，，，") == [("known_error", "贼市>城市"), ("punctuation_run", "，，，")]
    assert kinds(spark, "宽1〇米 长l0m 角∠") == [("one_mixup", "1"), ("zero_mixup", "0")]
    assert kinds(spark, "中文abc中文 🙂🙂") == [("mixed_run", ""), ("rare_char", "🙂"), ("rare_char", "🙂")]
    assert kinds(spark, "正常条文，含 GB 50180（2018）≥3m。") == []


def test_second_scan(spark):
    r = one(spark, "不应低丁0.5m/人，8.0m7人").select(F.inline(F.array(quality.scan_issues_2(F.col("text"))))).collect()[0]
    got = sorted((i.kind, i.detail) for i in r.issues)
    assert ("known", "不应低丁>不应低于") in got and ("known", "8.0m7人>8.0m²/人") in got
    assert ("unit_drop", "0.5m/人") in got and ("number_letter_mix", "8.0m7") in got and ("suspicious_char", "低丁:丁>于") in got
    assert r.confidence == "hi" and len(r.suggestions) == 3
    mid = one(spark, "每5m绿地").select(F.inline(F.array(quality.scan_issues_2(F.col("text"))))).collect()[0]
    assert mid.confidence == "mid" and mid.suggestions == ["每5m²绿地"]


def test_pairs_and_concordance(spark):
    text = "坏境=>环境\n 甲=>甲 \n错字=>正字\n一二三四=>五\nNONE\n乙=>丙"
    pairs = one(spark, text).select(quality.proposed_pairs(F.col("text")).alias("p")).collect()[0].p
    assert [(x.wrong, x.right) for x in pairs] == [("坏境", "环境"), ("乙", "丙")]
    rows = quality.concordance(one(spark, "区城区城市"), "text", "区城", 2).collect()
    assert sorted((r.left, r.right, r.n) for r in rows) == [("", "区城", 1), ("区城", "市", 1)]


def test_low_content(spark):
    df = spark.createDataFrame([("短",), ("abcdefghijklmnopqrstuvwxyz",), ("这是一个足够长的正常条文内容",)], "t string")
    assert [r.b for r in df.select(quality.low_content(F.col("t")).alias("b")).collect()] == [True, True, False]
