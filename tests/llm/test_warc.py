"""Archives: round trip, revisits, and the merged index against a plain sort."""

import base64
import io
import random
from hashlib import sha1

import pytest
from pyarrow import fs

from carelens.llm.warc import (LoserTree, _member, _order, archive_folder, capture, captures, members, merged_index, record,
                               url_key, warc_index, write_archives)

SCHEMA = "page_id long, url string, html string, digest string, id long, refers long"


def plain(rows):
    """page_id -> (bytes, digest, type, refers_to) for rows with distinct ids."""
    least = {}
    for k, _, t in rows:
        least[t or ""] = min(k, least.get(t or "", k))
    return {k: (len((t or "").encode()), base64.b32encode(sha1((t or "").encode()).digest()).decode(),
                "response" if least[t or ""] == k else "revisit", None if least[t or ""] == k else least[t or ""])
            for k, _, t in rows}


def rows_of(n):
    rng = random.Random(n)
    texts = [f"<p>{i} é</p>\r\n\r\nWARC/1.1\r\n" for i in range(20)] + ["", None, "x" * 200_000]
    urls = ["http://Hot.example.org/a?b=2&a=1#f", None, "https://www.x.com:8080/ü b", "not a url", "http://[bad/", "",
            "http://x.com/\r\nWARC-Type: response"]
    return [(i * 3 - 5, rng.choice(urls + [urls[0]] * 8 + [f"http://s{i % 7}.net/{i}"]), rng.choice(texts + [texts[2]] * 9))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, u, t, "d", 1, 2) for k, u, t in rows], SCHEMA).repartition(5)


def test_pages_come_back(spark):
    rows = rows_of(300)
    got = warc_index(frame(spark, rows), file_bytes=2000).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == plain(rows)
    assert all(r.valid for r in got) and len(got) == len(rows)
    assert len({r.archive for r in got}) > 5


def test_index_is_globally_ordered(spark):
    rows = rows_of(400)
    folder = archive_folder(spark)
    runs = captures(write_archives(frame(spark, rows), folder, file_bytes=3000), folder)
    for archive in {r.archive for r in runs.select("archive").collect()}:
        run = [r for r in runs.filter(runs.archive == archive).orderBy("seq").collect()]
        assert [_order(r.asDict()) for r in run] == sorted(_order(r.asDict()) for r in run)
        if len(run) > 20:
            break
    got = sorted(merged_index(runs, per_range=40).collect(), key=lambda r: r.rank)
    assert [r.rank for r in got] == list(range(1, len(rows) + 1))
    assert [_order(r.asDict()) for r in got] == sorted(_order(r.asDict()) for r in runs.collect())
    # a record is read alone by its place and length
    r = next(r for r in got if r.record_type == "response" and r.payload_bytes > 10)
    store, base = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{base}/{r.archive}") as f:
        f.seek(r.place)
        (_, _, data), = members(io.BytesIO(f.read(r.length)))
    assert capture(data)["payload_digest"] == r.payload_digest


def test_odd_pages(spark):
    rows = [(1, "u", "same"), (1, "u", "same"), (None, "u", "same"), (2, "u", "same"), (None, None, None)]
    got = warc_index(frame(spark, rows)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (0, "response", None), (0, "response", None), (1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc_index(frame(spark, [])).collect() == []
    small = warc_index(frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3).collect()
    assert {r.page_id: r.record_type for r in small} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_records_are_checked():
    good = record(5, "http://a.b/c", b"text", base64.b32encode(sha1(b"text").digest()).decode(), None)
    assert capture(good)["valid"] and not capture(good.replace(b"\ntext", b"\ntest"))["valid"]
    with pytest.raises(ValueError):
        capture(good[:-4])
    with pytest.raises(ValueError):
        list(members(io.BytesIO(_member(good)[:-9])))
    assert url_key("HTTP://www.A.Example.com:80/X?b=1&a=2#z") == "com,example,a)/x?a=2&b=1"
