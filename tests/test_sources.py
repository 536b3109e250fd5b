import json
import uuid

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from clauselake import schemas
from clauselake.operators import chunking
from clauselake.sources import corpus


def chunk(i, **changes):
    base = {
        "chunk_id": f"GB 1#{i}", "spec_code": "GB/T 1-2020", "spec_name": "名", "chapter": None, "section": None, "clause": str(i),
        "type": "clause", "text": f"文{i}", "page_start": 1, "page_end": 1, "is_mandatory": True, "domain": "规划", "source_pdf": "a.pdf", "char_count": 2,
    }
    return {**base, **changes}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([chunk(1), chunk(2, text=""), chunk(3, ocr_fixed_v1=True, extra=1)], ensure_ascii=False, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"chunks": [chunk(4), chunk(5, spec_name=None)]}, ensure_ascii=False))
    (tmp_path / "broken.json").write_text('[{"chunk_id": "x", ')
    (tmp_path / "_report.json").write_text(json.dumps([chunk(9)]))
    (tmp_path / "notes.txt").write_text("no")
    return str(tmp_path)


def test_chunk_scan_and_projection(spark, folder):
    rows = corpus.read_chunks(spark, folder)
    assert sorted(r.clause for r in rows.collect()) == ["1", "3", "4", "5"]
    assert [r.ocr_fixed_v1 for r in rows.filter("clause = '3'").collect()] == [True]
    seen = Observation("projection")
    kept = corpus.project_chunks(rows, seen)
    assert sorted(r.clause for r in kept.collect()) == ["1", "3", "4"]
    assert kept.columns == schemas.names(schemas.CHUNK)
    assert seen.get == {"n_read": 4, "n_skipped": 1}


def test_chunk_sink_modes(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    chunks = corpus.project_chunks(corpus.read_chunks(spark, folder))
    corpus.write_chunks(chunks, out)
    corpus.write_chunks(chunks.filter("clause = '1'"), out)
    back = spark.read.json(out)
    assert back.count() == 4 and {r.spec_slug for r in back.collect()} == {"GBT_1-2020"}
    corpus.write_chunks(chunks, out, mode="overwrite")
    assert spark.read.json(out).count() == 3


def test_ids(spark):
    names = ["GB 50180-2018#5.0.3", "", "建标#一"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(corpus.point_id(F.col("n")).alias("id"))
    assert [r.id for r in df.collect()] == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]


def test_batches_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "t")
    corpus.write_batch(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), path, 0)
    for _ in range(2):
        corpus.write_batch(spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int"), path, 1)
    assert sorted(map(tuple, corpus.read_current(spark, path, "k").collect())) == [("a", 1), ("b", 2), ("c", 2)]


def test_eval_set(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text('id,scenario,difficulty,spec_domain,query,expected_spec,expected_clause,expected_answer_summary,key_elements,trap_type,also_accept\n'
                    'Q1,s,easy,规划,"多行\n""问""题",GB 1,007,x,a;b,,GB 2|3\n')
    r = corpus.read_eval_set(spark, str(path), ["also_accept"]).collect()[0]
    assert (r.query, r.expected_clause, r.also_accept) == ('多行\n"问"题', "007", "GB 2|3")


def test_result_files(spark, tmp_path):
    (tmp_path / "r1.json").write_text(json.dumps({
        "config": {"csv": "/x/y/eval.csv", "use_multi_query": True, "timestamp": "20260603_120448", "elapsed_s": 4}, "overall": {"n": 7, "hit5_strict": 0.5},
        "rows": [],
    }, indent=1))
    (tmp_path / "r2.json").write_text("{}")
    rows = {r.csv: r for r in corpus.read_results(spark, str(tmp_path)).collect()}
    r = rows["eval.csv"]
    assert (r.mq, r.rk, r.ck, r.pf, r.n_eval, r.hit5_strict, str(r.run_at)) == (True, False, 20, "text_only", 7, 0.5, "2026-06-03 12:04:48")
    assert rows["unknown"].n_eval == 0 and r.mtime is not None


def test_domains_excludes_and_overrides(spark):
    names = [" GB50442-2008《x》.pdf", "建标 109—2008《y》.pdf", "JGJ39-2016《托儿所、幼儿园建筑设计规范》_可搜索.pdf", "other.pdf", "《公共美术馆建设标准》_可搜索.pdf"]
    files = spark.createDataFrame([(n,) for n in names], "file string")
    got = {r.file: (r.domain, r.status) for r in corpus.resolve_domain(files, "file").collect()}
    assert got == {names[0]: ("规划", "ok"), names[1]: ("建筑", "ok"), names[3]: (None, "no_domain"), names[4]: ("建筑", "ok")}
    parsed = files.select("file", chunking.parse_title(F.col("file")).alias("t")).select("file", "t.code", "t.name")
    titled = {r.file: (r.code, r.status) for r in corpus.override_titles(parsed, "file").collect()}
    assert titled[names[4]] == ("公共美术馆建设标准", "ok") and titled["other.pdf"] == (None, "error") and titled[names[1]] == ("建标 109-2008", "ok")


def test_shared_folder_is_the_cluster_one(spark):
    assert corpus.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
