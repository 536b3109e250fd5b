"""An index grown by segments must equal one built anew, at every version that readers can see."""

import os
import random

import pytest

from clauselake.operators import lexical
from clauselake.sources.segments import SegmentedIndex

DOCS = "doc_id long, text string"
WORDS = "pipe wall exit stair door 高层建筑 防火 smoke valve tank".split()


def same(spark, got, current):
    """Postings, statistics, facts and search results of the index are those of a fresh one."""
    docs = spark.createDataFrame(sorted(current.items()), DOCS)
    want = lexical.build_index(docs)
    assert sorted(got.postings.select("doc_id", "dl", "term", "tf").collect()) == sorted(
        want.postings.select("doc_id", "dl", "term", "tf").collect())
    a, b = got.corpus.first(), want.corpus.first()
    assert (a.n_docs, a.n_postings) == (b.n_docs, b.n_postings) and a.avgdl == (b.avgdl if b.n_docs else None)
    weights = {r.term: (r.df, r.idf) for r in want.terms.collect()}
    found = {r.term: (r.df, r.idf) for r in got.terms.collect()}
    assert found.keys() == weights.keys()
    assert all(found[t][0] == weights[t][0] and found[t][1] == pytest.approx(weights[t][1]) for t in weights)
    assert sorted(got.facts.select("doc_id", "key", "head").collect()) == sorted(want.facts.select("doc_id", "key", "head").collect())


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names}


def test_batches_with_revisions_equal_a_fresh_build(spark, tmp_path):
    rng = random.Random(5)
    index, current = SegmentedIndex(spark, f"{tmp_path}/index"), {}

    def text():
        return " ".join(rng.choices(WORDS, k=rng.randrange(0, 9)))

    batches = [{i: text() for i in range(12)}, {i: text() for i in (3, 4, 20, 21)}, {i: text() for i in (3, 5, 30)}]
    for n, rows in enumerate(batches):
        rows = rows | ({0: current[0]} if n else {})  # sent again as it was
        gone = [7] if n == 1 else []
        before = files(tmp_path)
        index.append(spark.createDataFrame(list(rows.items()), DOCS), n, deleted=spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        current = {k: v for k, v in (current | rows).items() if k not in gone}
        assert before <= files(tmp_path)  # earlier files stay as they are
        same(spark, index.read(), current)
    segment = index.manifest()["segments"][-1]
    sent = spark.read.parquet(f"{tmp_path}/index/docs/segment={segment}")
    assert {r.doc_id for r in sent.collect()} <= {3, 5, 30}  # only what the batch changed
    old = index.read(1)
    assert index.compact() == 4 and len(index.manifest()["segments"]) == 1
    same(spark, index.read(), current)
    same(spark, old, batches[0])
    index.append(spark.createDataFrame([(7, "valve"), (3, "exit")], DOCS), 9)
    same(spark, index.read(), current | {7: "valve", 3: "exit"})
    top = lexical.bm25_top(index.read(), spark.createDataFrame([(1, "valve")], "query_id long, text string"), 50).collect()
    assert 7 in {r.doc_id for r in top}


def test_a_failed_batch_stays_invisible(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, f"{tmp_path}/index")
    index.append(spark.createDataFrame([(1, "pipe wall"), (2, "exit")], DOCS), 0)
    more = spark.createDataFrame([(2, "stair"), (3, "door")], DOCS)
    write = SegmentedIndex._write

    def broken(self, rows, segment, table):
        if table == "terms":
            raise OSError("lost")
        write(self, rows, segment, table)

    with monkeypatch.context() as m:
        m.setattr(SegmentedIndex, "_write", broken)
        with pytest.raises(OSError):
            index.append(more, 1)
    assert index.version() == 1
    same(spark, index.read(), {1: "pipe wall", 2: "exit"})
    assert index.append(more, 1) == 2 and index.append(more, 1) == 2  # a replay changes nothing
    same(spark, index.read(), {1: "pipe wall", 2: "stair", 3: "door"})


def test_the_second_of_two_writers_fails(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/index")
    base = index.manifest()
    index._commit(base, [], [0])
    with pytest.raises(Exception, match="[Ee]xists"):
        index._commit(base, [], [1])
    assert index.manifest()["batches"] == [0]


def test_odd_rows(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/index")
    assert index.read().corpus.first().n_docs == 0 and index.version() == 0
    index.append(spark.createDataFrame([], DOCS), 0)
    index.append(spark.createDataFrame([(None, "pipe"), (1, None), (2, "wall"), (2, "wall")], DOCS), 1)
    same(spark, index.read(), {1: "", 2: "wall"})
    index.append(spark.createDataFrame([(2, "wall")], DOCS), 2, deleted=spark.createDataFrame([(1,), (2,), (None,)], "doc_id long"))
    assert index.read().corpus.first().n_docs == 0 and index.read().terms.count() == 0


def test_batches_of_a_stream(spark, tmp_path):
    index = SegmentedIndex(spark, f"{tmp_path}/index")
    for rows in ([(1, "pipe"), (2, "wall exit")], [(2, "door")]):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(index.append).option("checkpointLocation", f"{tmp_path}/state").trigger(
            availableNow=True).start().awaitTermination()
    same(spark, index.read(), {1: "pipe", 2: "door"})
