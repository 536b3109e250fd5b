"""The pipeline against a plain version of its stages, and the registered queries at the smallest scale."""

import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from clauselake.llm import mixing
from clauselake.llm.queries import vocabulary
from tests.llm.test_copies import brute_components, plain
from tools.check import canon

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = [d for d in docs if any(c.isalpha() for c in d["text"] or "")]
    first = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        first.setdefault(plain(d["text"]), d)
    reps = brute_components([(d["doc_id"], d["text"]) for d in first.values()], 5, 80)
    docs = [d for d in first.values() if reps[d["doc_id"]][1] == d["doc_id"]]
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["source"]) for d in docs], "doc_id long, text string, source string")
    copies = {r.doc_id: r.taken // r.size for r in mixing.mix(frame).collect() if r.size}
    library = Tokenizer.from_file(vocabulary())
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: n for i, n in copies.items() if n})
    texts = {d["doc_id"]: d["text"] for d in docs}
    for r in got[:200]:
        assert r.text == texts[r.doc_id] and r.ids == library.encode(r.text, add_special_tokens=False).ids


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["known_language", "exact_copies", "near_copies", "mixed_sources", "token_ids"]
    names = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if re.match(r"op\d+_", n)])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*sorted(df.columns)).collect())
    assert got == sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall())
