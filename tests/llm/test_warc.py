import base64
import hashlib
import io
import random
from collections import defaultdict

import pytest

from clauselake.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice('abc')}.example.org/p{rng.randrange(9)}?q={i % 3}", rng.choice(["<p>a</p>", "<p>é</p>", "", f"<i>{i}</i>", "x" * 3000])) for i in range(120)]
    rows += [(500, None, "<p>a</p>"), (501, "http://[bad", None), (502, "https://www.Example.org:8443/\r\nX: y", "é\r\n\r\nb"), (None, "http://a.example.org/", "<p>é</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


@pytest.mark.parametrize("archive_bytes,range_captures", [(warc.ARCHIVE_BYTES, warc.RANGE_CAPTURES), (2000, 10)])
def test_history_holds_every_page(spark, pages, tmp_path, archive_bytes, range_captures):
    rows = pages.collect()
    best = defaultdict(lambda: -1)
    for r in rows:
        best[r.html or ""] = max(best[r.html or ""], -1 if r.page_id is None else r.page_id)
    listed = warc.write_archives(pages, str(tmp_path / "a"), archive_bytes)
    runs = warc.sorted_runs(listed, str(tmp_path / "a"))
    got = warc.merged_history(runs, len(rows), range_captures).collect()
    keys = [(r.url_key, r.timestamp, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    found = {r.page_id: r for r in got}
    for r in rows:
        payload, c = (r.html or "").encode(), found[r.page_id]
        assert c.payload_bytes == len(payload)
        assert c.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = best[r.html or ""] in (r.page_id, -1)
        assert (c.record_type, c.refers_to) == (("response", None) if first else ("revisit", best[r.html or ""]))


def test_small_payloads_are_all_responses(pages):
    kinds = {(r.html or "", r.record_type) for r in warc.decided(pages, least_bytes=8).collect()}
    assert ("", "revisit") not in kinds and ("<p>a</p>", "revisit") in kinds


def test_empty_table(spark, pages):
    assert warc.capture_history(spark, pages.limit(0)).collect() == []


def test_repeated_rows(spark):
    df = spark.createDataFrame([(4, "u", "x"), (4, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.capture_history(spark, df).collect())
    assert got == [(2, "revisit", 4), (4, "response", 0), (4, "response", 0)]


def test_broken_archives_are_noticed():
    data = warc.record(1, "http://a/", b"abc", warc.payload_digest(b"abc"), "response", None)
    assert [c["page_id"] for c in warc.captures(io.BytesIO(data * 2))] == [1, 1]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.captures(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError, match="does not fit"):
        list(warc.captures(io.BytesIO(warc.record(1, None, b"abc", warc.payload_digest(b"abd"), "response", None))))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(40) for _ in range(rng.choice([0, 1, 5, 30]))) for _ in range(k)]
    assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("http://www.Example.org/A/?x=1") == "org,example)/a?x=1"
    assert warc.url_key("https://example.org:8443") == "org,example:8443)/"
    assert warc.url_key(None) == "-"
