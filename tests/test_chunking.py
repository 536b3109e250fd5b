import random

from pyspark.sql import functions as F

from clauselake.operators import chunking
from clauselake.profiles import STANDARDS
from models import merge, pack

LINE = "doc_id string, page int, line_no int, text string, bold boolean, size double"

DECIMAL = [
    ("附录 A 目录行很小", 10, False), ("正文在第一条之前", 10, False), ("1 总则部分", 16, False), ("1.1 一般规定", 13, False),
    ("1.1.1 建筑应满足采光。", 10, False), ("续行内容", 10, False), ("1.1.1.2 四级条文内容在此", 10, False),
    ("1.1.2 宜设绿地", 10, True), ("表 1.1.2 指标", 10, False), ("甲 乙 丙", 10, True), ("式（1.1.3）计算", 10, False),
    ("1.2 不大的节标题但是粗体", 10, True), ("悬空的正文", 10, False), ("1.2.1", 10, False), ("1.2.1 重复的条文内容", 10, False),
    ("2 第二章标题", 16, False), ("2.0.1 啊", 10, False), ("附录 B 计算方法", 16, False), ("B.0.1 附录条文不得省略", 10, False),
    ("附录 C 第二个附录行", 16, False),
]


def lines(spark, rows, doc="d"):
    data = [(doc, 1 + i // 10, i, t, b, float(s)) for i, (t, s, b) in enumerate(rows)]
    return spark.createDataFrame(data, LINE)


def test_line_kinds_and_carry(spark):
    kinds = chunking.line_kinds(lines(spark, DECIMAL))
    got = [(r.kind, r.label) for r in kinds.orderBy("line_no").collect()]
    assert got[0] == ("body", None)
    assert got[2] == ("chapter", "1 总则部分")
    assert got[3] == ("section", "1.1 一般规定")
    assert got[4] == ("clause", "1.1.1")
    assert got[6] == ("clause", "1.1.1.2")
    assert got[8] == ("table", "表1.1.2")
    assert got[10] == ("formula", "式1.1.3")
    assert got[11] == ("section", "1.2 不大的节标题但是粗体")
    assert got[17] == ("appendix", "附录 B 计算方法")
    assert got[18] == ("clause", "B.0.1")
    assert got[19] == ("body", None)
    rows = {r.line_no: r for r in chunking.carry_structure(kinds).collect()}
    assert rows[4].section == "1.1 一般规定" and rows[4].chapter == "1 总则部分"
    assert rows[16].section is None and rows[16].chapter == "2 第二章标题"
    assert rows[18].chapter == "附录 B 计算方法" and rows[18].in_appendix


def test_segments(spark):
    segs = chunking.assemble(chunking.carry_structure(chunking.line_kinds(lines(spark, DECIMAL))))
    got = {(r.clause, r.type): r for r in segs.collect()}
    assert got[("1.1.1", "clause")].text == "1.1.1 建筑应满足采光。\n续行内容"
    assert got[("1.1.1", "clause")].is_mandatory
    assert got[("1.1.2", "clause")].is_mandatory  # bold opener
    assert not got[("表1.1.2", "table")].is_mandatory
    assert got[("B.0.1", "appendix")].is_mandatory
    assert got[("B.0.1", "appendix")].text.endswith("附录 C 第二个附录行")
    assert not any("悬空" in r.text or "第一条之前" in r.text for r in got.values())


def test_ids_get_repeat_numbers(spark):
    pieces = chunking.split_long(chunking.assemble(chunking.carry_structure(chunking.line_kinds(lines(spark, DECIMAL)))))
    ids = [r.chunk_id for r in chunking.number_copies(pieces, F.lit("GB 1")).orderBy("seq").collect()]
    assert "GB 1#1.2.1" in ids and "GB 1#1.2.1_d1" in ids


def test_article_mode_wins_only_with_more_chunks(spark):
    article = [("第一章 总则", 10, False)] + [(f"第{n}条 本条内容应当执行，" + "字" * 50, 10, False) for n in "一二三四五六七八九十"] + [
        ("第三条例不是条文", 10, False)
    ]
    both = lines(spark, article, "a").union(lines(spark, DECIMAL, "d"))
    got = chunking.chunk_documents(both, F.col("doc_id")).collect()
    modes = {r.doc_id: r.mode for r in got}
    assert modes == {"a": "article", "d": "decimal"}
    labels = [r.clause for r in sorted((r for r in got if r.doc_id == "a"), key=lambda r: r.seq)]
    assert labels[0] == "第一条" and len(labels) == 10
    assert any("第三条例" in r.text for r in got)


def test_pack_matches_sequential_model(spark):
    rng = random.Random(1)
    texts = ["\n".join("x" * rng.choice([0, 1, 5, 30, 60, 110]) + rng.choice(["", " "]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", chunking.pack_paragraphs(F.col("t"), 100).alias("p")).collect()}
    assert all(got[i] == pack(t, 100) for i, t in enumerate(texts))


def test_long_clause_is_cut_and_tables_are_not(spark):
    long = "\n".join("字" * n for n in (300, 300, 300, 900, 10))
    segs = spark.createDataFrame(
        [("d", 1, "1.1", "clause", long), ("d", 2, "表1", "table", long), ("d", 3, "1.2", "clause", "字" * 801)],
        "doc_id string, seg int, clause string, type string, text string",
    )
    got = [(r.clause, r.char_count) for r in chunking.split_long(segs).orderBy("seg", "piece").collect()]
    assert got == [("1.1-1", 601), ("1.1-2", 300), ("1.1-3", 900), ("1.1-4", 10), ("表1", len(long)), ("1.2-1", 801)]


def test_merge_matches_sequential_model(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for d in range(200):
        chunks = []
        for s in range(rng.randint(1, 9)):
            n = rng.choice([10, 49, 50, 80])
            chunks.append({
                "doc_id": d, "seq": s + 1, "clause": f"c{s}", "type": rng.choice(["clause", "clause", "clause", "table"]),
                "section": rng.choice([None, "s", "s", "t"]), "chapter": rng.choice([None, "k", "l"]), "text": "y" * n, "char_count": n, "is_mandatory": False, "page_end": s,
            })
        rows += chunks
        want[d] = merge(chunks, STANDARDS.min_chunk)
    df = spark.createDataFrame(rows, "doc_id int, seq int, clause string, type string, section string, chapter string, text string, char_count int, is_mandatory boolean, page_end int")
    got: dict[int, list] = {}
    for r in chunking.merge_short(df).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.clause, r.chapter, r.text, r.char_count))
    assert got == want


def test_parse_title(spark):
    names = ["GB:T50034-2024《采光标准》_x.pdf", "GBT+21741-2021《小区》.pdf", "建标 109—2008《学校》.pdf", "GB50180-2018 《规划》", "no title.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(chunking.parse_title(F.col("n")).alias("t"))
    got = [tuple(r.t) for r in df.collect()]
    assert got == [
        ("GB/T 50034-2024", "采光标准"), ("GB/T 21741-2021", "小区"), ("建标 109-2008", "学校"), ("GB 50180-2018", "规划"), (None, None),
    ]


def test_wide_blanks_and_digits(spark):
    docs = spark.createDataFrame([("d", "１　总则内容\n2.1　一般规定\n2.1.１ 条文内容\n表　2.1.1　指标\n式（２.1.2）\n附　录 Ａ 说明\n")], "doc_id string, text string")
    got = chunking.line_kinds(chunking.lines_of(docs)).orderBy("line_no").collect()
    assert [r.kind for r in got] == ["chapter", "section", "clause", "table", "formula", "appendix"]
    assert [r.label for r in got][2:5] == ["2.1.1", "表2.1.1", "式2.1.2"]
    article = chunking.line_kinds(lines(spark, [("第　一　章　总则", 16, False), ("第　２　条　内容", 10, False), ("第 3 条例", 10, False)]), article=True)
    assert [r.kind for r in article.orderBy("line_no").collect()] == ["chapter", "body", "body"]


def test_a_merged_chunk_has_the_chapter_of_its_second_part(spark):
    rows = [("第一章 总则", 16, False), ("第一条 短。", 10, False), ("第二章 设计", 16, False), ("第二条 也短。", 10, False)]
    got = chunking.chunk_lines(lines(spark, rows), F.lit("c"), article=True).collect()
    assert [(r.clause, r.chapter) for r in got] == [("第一条+第二条", "第二章 设计")]


def test_only_documents_with_few_chunks_change_mode(spark):
    few = [("第一条 " + "内容" * 40, 10, False), ("第二条 " + "内容" * 40, 10, False)]
    many = [(f"1.1.{i} " + "条文内容" * 20, 10, False) for i in range(1, 13)] + [(f"第{i}条 " + "内容" * 40, 10, False) for i in range(1, 30)]
    both = lines(spark, few, "few").unionByName(lines(spark, many, "many"))
    got = {(r.doc_id, r.mode): r.n for r in chunking.chunk_documents(both, F.col("doc_id")).groupBy("doc_id", "mode").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {("few", "article"), ("many", "decimal")} and got[("few", "article")] == 2
