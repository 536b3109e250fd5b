import random

import pytest
from pyspark.sql import functions as F

from clauselake.operators import catalog, evaluation as ev
from clauselake.profiles import SUBCATEGORIES, SUBCATEGORY_ORDER


def hits(spark):
    rows = [(1, 1, "GB 1", "9.9"), (1, 2, "GB　1", "5.0.3+5.0.4"), (1, 3, "GB 2", "7"), (2, 1, "gb2", "x"), (3, 1, "GB 7", "1"), (4, 4, "GB 4", "")]
    return spark.createDataFrame(rows, "query_id int, rank int, code string, clause string")


def test_ranks_with_alternatives(spark):
    rows = spark.createDataFrame(
        [(1, "GB1", "5.0.3", ""), (2, "GB 9", "1", " GB 2 | x ; ; |y"), (3, "", "1", "GB7"), (4, "GB 4", "", None), (5, "GB 5", "1", None)],
        "query_id int, expected_code string, expected_clause string, also string",
    )
    truth = ev.truth_rows(rows, extra="also")
    got = {r.query_id: (r.rank_strict, r.rank_loose) for r in ev.first_hits(hits(spark), truth, rows).collect()}
    assert got == {1: (2, 1), 2: (1, 1), 3: (None, 1), 4: (None, 4), 5: (None, None)}
    known = {r.query_id: (r.rank_strict, r.rank_loose) for r in ev.expected_hits(hits(spark), truth).collect()}
    assert known == got


def test_metrics_and_breakdown(spark):
    ranks = spark.createDataFrame([(1, 2, "a", "x"), (None, 6, "a", "y"), (7, 7, "b", "x"), (None, None, "b", "y")],
                                  "rank_strict int, rank_loose int, domain string, level string")
    m = ranks.agg(*ev.metrics()).collect()[0]
    assert (m.n, m.hit5_strict, m.hit10_strict, m.hit5_loose, m.hit10_loose) == (4, 0.25, 0.5, 0.25, 0.75)
    assert m.mrr_strict == pytest.approx((1 + 1 / 7) / 4, abs=1e-6)
    sets = {(r.domain, r.level): r.n for r in ev.breakdown(ranks, "domain", "level").collect()}
    assert sets == {(None, None): 4, ("a", None): 2, ("b", None): 2, (None, "x"): 2, (None, "y"): 2}


@pytest.mark.parametrize("s1,l1,flipped,note", [(0.80, 0.80, False, ""), (0.80, 0.74, True, "loose down"), (0.8, 0.85, True, "loose up"), (0.7, 0.80, True, "strict changed")])
def test_flips(spark, s1, l1, flipped, note):
    new = spark.createDataFrame([("A", "v2", s1, l1)], "combo string, csv string, strict double, loose double")
    old = spark.createDataFrame([("A", "v1", 0.8, 0.8), ("A", "v2", 0.1, 0.1), ("B", "v1", 0.1, 0.1)], "combo string, csv string, strict double, loose double")
    rows = ev.flips(new, old, "combo", "csv").collect()
    assert [(r.old_set, r.flipped, r.note) for r in rows] == [("v1", flipped, note)]


def test_quality(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 1, 1), (1, 0, 1, 1, 0, 1, 1)],
                               "dim1_recall int, dim2_precision int, dim6_boundary int, dim3_citation int, dim4_wording int, dim5_numeric int, dim7_no_halluc int")
    got = [(r.c, r.v) for r in df.select(ev.composite().alias("c"), ev.vetoed().alias("v")).collect()]
    assert got == [(1.0, False), (0.7, True)]
    g = spark.createDataFrame([(0.75, False), (0.9, True), (0.6, False), (0.59, False)], "m double, v boolean")
    assert [r.g for r in g.select(ev.grade(F.col("m"), F.col("v")).alias("g")).collect()] == ["GREEN", "YELLOW", "YELLOW", "RED"]


def test_runs(spark):
    runs = spark.createDataFrame([("q", 90.0), ("q", 89.4), ("q", 90.5)], "m string, v double")
    r = ev.variance(runs, ["m"], "v").collect()[0]
    assert (r.n_runs, r.mean, r.std, r.lowest, r.highest) == (3, 89.966667, 0.449691, 89.4, 90.5)
    fails = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 2), ("c", 2)], "id string, run int")
    assert {r.n_runs: r.n_ids for r in ev.persistence(fails, "id", "run").collect()} == {3: 1, 1: 2}


def test_ttl_looks_at_the_newest_only(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00', 1), ('a', timestamp'2024-01-02 00:00:00', 2), ('b', timestamp'2024-01-01 10:00:00', 3) t(k, ts, v)")
    now = F.lit("2024-01-02 10:00:00").cast("timestamp")
    got = {r.k: r.v for r in ev.latest_within(df, ["k"], "ts", "v", ["v"], now).collect()}
    assert got == {"a": 2, "b": 3}
    assert {r.k for r in ev.latest_within(df, ["k"], "ts", "v", ["v"], now, 86399).collect()} == {"a"}


def test_overlay_and_pairing(spark):
    rows = spark.createDataFrame([(1, "q1", "s"), (2, "q2", "s"), (3, "q3", None)], "id int, query string, code string")
    rev = spark.createDataFrame([(1, "remapped", "moved", None, "t"), (3, "rewritten", "typo", "Q3", None)], "id int, status string, reason string, query string, code string")
    got = {r.id: tuple(r)[1:] for r in ev.overlay(rows, rev, "id", ["query", "code"]).collect()}
    assert got == {1: ("q1", "t", None, "s", "remapped", "moved"), 2: ("q2", "s", None, None, "kept", ""), 3: ("Q3", None, "q3", None, "rewritten", "typo")}
    a = spark.createDataFrame([(1, 3), (2, None), (3, 1), (4, 2), (5, None)], "id int, rank int")
    b = spark.createDataFrame([(1, 1), (2, 4), (3, None), (4, 2), (5, None)], "id int, rank int")
    assert {r.id: r.change for r in ev.paired(a, b, "id", "rank").collect()} == {1: "better", 2: "gained", 3: "lost", 4: "same", 5: "missing"}


def test_sample_and_round_robin(spark):
    df = spark.range(100).select(F.col("id"), (F.col("id") % 4 == 0).alias("veto"), (F.col("id") % 3).cast("string").alias("spec"))
    sample = ev.review_sample(df, "id", "veto", "7").collect()
    assert [r.id for r in sample[:15]] == list(range(0, 60, 4)) and len(sample) == 30
    assert sample == ev.review_sample(df.repartition(3), "id", "veto", "7").collect()
    picks = ev.round_robin(df, "spec", F.col("id"), "id", 2, 5).collect()
    assert [(r["round"], r.spec, r.id) for r in picks] == [(1, "0", 99), (1, "1", 97), (1, "2", 98), (2, "0", 96), (2, "1", 94)]


def test_citation_dims_use_five(spark):
    cites = [("GB 1", "1"), ("x", "1"), ("x", "1"), ("x", "1"), ("x", "1"), ("GB 2", "2")]
    df = spark.createDataFrame([(cites,)], "c array<struct<code: string, clause: string>>")
    got = [df.select(*ev.citation_dims(F.col("c"), F.lit(code), F.lit(cl))).collect()[0] for code, cl in (("gb1", "1.1"), ("GB 1", "7"), ("GB 2", "2"))]
    assert [tuple(r) for r in got] == [(1, 1), (1, 0), (0, 0)]


def test_taxonomy(spark):
    assert set(SUBCATEGORIES.values()) == {g for names in SUBCATEGORY_ORDER.values() for g in names}
    codes = [c for c, g in SUBCATEGORIES.items() if g in SUBCATEGORY_ORDER["规划"]]
    rows = [("规划", c) for c in codes] + [("规划", "XX 1"), ("消防", "GB 55037-2022")] + [("景观", c) for c in ("CJJ/T 75-2023", "CJJ/T 91-2017")]
    got = catalog.grouped_specs(spark.createDataFrame(rows, "domain string, code string"), "domain", "code").orderBy("group_pos").collect()
    assert [r.sub_group for r in got] == SUBCATEGORY_ORDER["规划"] + ["未分类"]
    assert sum(r.n_specs for r in got) == len(codes) + 1
    loose = spark.createDataFrame([("jgj 76-2019",), ("建标192—2018号",), ("none",)], "code string")
    assert [r.sub_group for r in catalog.with_group(loose, "code").collect()] == ["教育建筑", "教育建筑", None]


def test_costs(spark):
    r = catalog.scan_costs(spark.createDataFrame([("d", 2), ("d", 4)], "d string, m int"), "d", "m").collect()[0]
    assert (r.n, r.flat, r.grouped) == (6, 3.5, pytest.approx(1.5 + (3 + 10) / 6, abs=1e-6))


def test_clause_lookup_against_pairs(spark):
    labels = [("GB 1", "5.0.3+5.0.4", 1), ("GB1", "5.0.3", 2), ("GB 1", "15.0.3", 3), ("GB 2", "表5.0.3", 4), ("GB 2", "6.1", 5), ("GB 2", "6.10", 6)]
    chunks = spark.createDataFrame(labels, "code string, clause string, id int")
    asked = spark.createDataFrame([(1, "gb 1", "5.0.3"), (2, "GB 2", "5.0.3"), (3, "GB 1", "0.4"), (4, "GB 1", ""), (5, "GB 2", "6.7"), (6, "GB 3", "1"), (7, "GB2", "第6.1条")],
                                  "request_id int, code string, clause string")
    table = catalog.clause_labels(chunks, "code", "clause", "id")
    got = {r.request_id: (r.clause, r.exact) for r in catalog.lookup_clause(asked, table, "id").collect()}
    assert got == {1: ("5.0.3", True), 2: ("表5.0.3", False), 3: ("5.0.3+5.0.4", False), 7: ("6.1", False)}
    missing = asked.filter("request_id = 5")
    assert [(r.hint_no, r.hint) for r in catalog.near_clauses(missing, table).orderBy("hint_no").collect()] == [(1, "6.1"), (2, "6.10")]


def test_toggle_tier_and_entries(spark):
    r = spark.sql("SELECT array('a','b','x') s, array('a','b') g, array('b','c') h").select(catalog.toggle(F.col("s"), F.col("g")).alias("off"), catalog.toggle(F.col("s"), F.col("h")).alias("on")).collect()[0]
    assert (r.off, sorted(r.on)) == (["x"], ["a", "b", "c", "x"])
    cites = spark.createDataFrame([("GB 1",), ("gb1",), ("DB 31",), ("JGJ 3",)], "code string")
    assert [(x.tier, x.n_codes) for x in catalog.tier_summary(cites, "code").orderBy("pos").collect()] == [("国标", 1), ("行标", 1), ("地标", 1)]
    args = (F.lit(1), F.lit("名"), F.lit("GB 1"), F.lit("5.0.3"), F.lit(17), F.lit(True), F.lit("甲\n乙"))
    row = spark.range(1).select(catalog.evidence_entry(*args).alias("a"), catalog.check_entry(*args).alias("b")).collect()[0]
    assert row.a == '[1] 《名》GB 1 第 5.0.3 条（第 17 页·强制性条文）\n"甲\n乙"'
    assert row.b == "[1] 《名》GB 1 5.0.3（强制性条文 · 第17页）\n甲 乙"


def test_containment_of_labels(spark):
    rng = random.Random(8)
    labels = [*{(c, "".join(rng.choices("12.条", k=rng.randrange(1, 9)))) for c in "ab" for _ in range(60)}, ("a", "x" * 40 + "12.1" + "y" * 1956)]
    parts = [(c, "".join(rng.choices("12.条", k=rng.randrange(0, 5)))) for c in "ab" for _ in range(40)] + [("a", "xy"), ("a", "2.1yy"), (None, "1")]
    got = catalog.contained(spark.createDataFrame(parts, "code_key string, part string"), spark.createDataFrame(labels, "code_key string, text string"))
    want = {(c, p, t) for c, p in parts for d, t in labels if c == d and p and p in t}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_clause_lookup_with_a_long_label(spark):
    long = "第" + "".join(str(i) + "." for i in range(700))
    asked = spark.createDataFrame([(1, "GB 1", "6.7.8"), (2, "GB 1", long[5:1500]), (3, "GB 1", "5.1"), (4, "GB 1", "7.7.7")], "request_id long, code string, clause string")
    chunks = spark.createDataFrame([("c1", "GB 1", long), ("c2", "GB 1", "5.1"), ("c3", "GB 1", "")], "id string, code string, clause string")
    got = catalog.lookup_clause(asked, catalog.clause_labels(chunks, "code", "clause", "id"), "id")
    assert {(r.request_id, r.id, r.exact) for r in got.collect()} == {(1, "c1", False), (2, "c1", False), (3, "c2", True)}
