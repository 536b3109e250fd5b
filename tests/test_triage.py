import pytest
from pyspark.sql import functions as F

from clauselake.operators import triage
from clauselake.profiles import STANDARD_TRIAGE


@pytest.mark.parametrize("query,want", [
    ("  ", "input_empty"), (None, "input_empty"), ("字" * (STANDARD_TRIAGE.max_length + 1), "input_too_long"),
    ("字" * STANDARD_TRIAGE.max_length, "normal"), ("怎么能让方案顺利过审", "sensitive"), ("少算一点面积", "sensitive"),
    ("GB 50180-93 的要求是什么", "deprecated"), ("gb50016—2006还能用吗", "deprecated"), ("GB 50180-2018 绿地率", "normal"),
    ("你好呀！", "chitchat"), ("Hello", "chitchat"), ("这个系统能做什么", "chitchat"), ("今天天气如何", "out_of_scope"),
    ("写一段 Python", "out_of_scope"), ("高度", "ambiguous"), ("幼儿园的事", "ambiguous"), ("幼儿园的要求", "normal"),
    ("幼儿园服务半径", "normal"), ("是否合规呢朋友们", "ambiguous"), ("一句超过十五个字但没有任何具体名词的话吧", "normal"),
])
def test_scenario(spark, query, want):
    df = spark.createDataFrame([(query,)], "q string")
    assert df.select(triage.scenario(F.col("q")).alias("s")).collect()[0].s == want


@pytest.mark.parametrize("query,want,matched", [
    ("规范库里收录了哪些规范", "tool", "catalog"), ("GB 50180 还有效吗", "tool", "status"), ("GB 50180 5.0.3 讲什么", "tool", "clause_lookup"),
    ("第5.0.3条的原文", "tool", "clause_lookup"), ("建筑密度上限和容积率要求", "decompose", "compound"), ("幼儿园有哪些要求", "decompose", "broad"),
    ("园址选择对服务半径有什么要求", "plain", "broad_but_specific"), ("绿地率", "plain", ""), ("", "plain", ""),
])
def test_route(spark, query, want, matched):
    df = spark.createDataFrame([(query,)], "q string")
    r = df.select(triage.route(F.col("q")).alias("r")).collect()[0].r
    assert (r.route, r.matched) == (want, matched)


def test_escalation_touches_only_unsure_rows(spark):
    routed = spark.createDataFrame([(1, "decompose", "broad"), (2, "decompose", "broad"), (3, "plain", ""), (4, "decompose", "broad")],
                                   "query_id int, route string, matched string")
    verdicts = spark.createDataFrame([(1, "SINGLE, not broad"), (2, "broad"), (3, "broad")], "query_id int, verdict string")
    got = {r.query_id: (r.route, r.matched) for r in triage.escalate(routed, verdicts).collect()}
    assert got == {1: ("plain", "verdict_single"), 2: ("decompose", "verdict_broad"), 3: ("plain", ""), 4: ("decompose", "broad")}


def conversation():
    rows = [(1, 0, "system", "sys")]
    for i in range(1, 24):
        rows.append((1, i * 2, "user" if i % 2 else "assistant", f"m{i}" + "x" * (250 if i == 5 else 0)))
    rows += [(1, 100, "assistant", ""), (1, 101, "user", "last"), (2, 0, "user", "  very   long\nquestion about many things "), (2, 1, "assistant", "a")]
    return rows


@pytest.mark.parametrize("width", [8, 1 << 20])
def test_history_and_pairs_in_blocks(spark, width):
    rows = conversation()
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.history for r in triage.history(turns, width=width).collect()}
    want = {}
    for conv in (1, 2):
        done: list[str] = []
        for c, t, role, text in rows:
            if c != conv or role == "system" or not text:
                continue
            if role == "user":
                want[(c, t)] = "\n".join(done[-6:])
            done.append(("用户" if role == "user" else "助手") + "：" + text[:200])
    assert got == want
    pairs = {(r.conv_id, r.turn): r.answer for r in triage.answer_pairs(turns, width=width).collect()}
    assert pairs[(1, 2)] == "m2" and pairs[(1, 101)] is None and pairs[(2, 0)] == "a" and pairs[(1, 46)] == ""


def test_titles(spark):
    turns = spark.createDataFrame(conversation(), "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.title, r.n_messages) for r in triage.titles(turns).collect()}
    assert got == {1: ("m1", 25), 2: ("very long question about…", 2)}


def test_dispatch_order(spark):
    df = spark.createDataFrame(
        [("sensitive", "tool", True), ("ambiguous", "tool", True), ("ambiguous", "tool", False), ("normal", "decompose", False), ("normal", "tool", False)],
        "s string, r string, t boolean",
    )
    got = [r.h for r in df.select(triage.handled_by(F.col("s"), F.col("r"), F.col("t")).alias("h")).collect()]
    assert got == ["reply:sensitive", "tool", "reply:ambiguous", "decomposed search", "search"]


def test_deprecated_reply_is_filled(spark):
    triaged = spark.createDataFrame([(1, "查 JGJ 39-87", "deprecated")], "query_id int, query string, scenario string")
    replies = spark.createDataFrame([("deprecated", "{name} {code} -> {current} ({year})")], "scenario string, template string")
    assert triage.fallback_reply(triaged, replies).collect()[0].reply == "托儿所、幼儿园建筑设计规范 JGJ 39-87 -> JGJ 39-2016 (2016)"
