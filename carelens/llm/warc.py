"""WARC archives of pages, and their capture index by external merging.

Writing: every page becomes a WARC/1.1 record, a gzip member of its own, in
archives of about ``file_bytes`` under the shared folder. The smallest page id of
the pages with equal payloads is written as ``response``, the others as ``revisit``
records, which hold the response's headers but not the payload again (payloads
under ``least`` bytes are always responses). Which page that is comes from an
aggregate over the digests; only digests that occur more than once are joined
back, so the pages are dealt out by nothing but the size of their texts.

Reading: archives are read record by record; every response's payload is hashed
again and held against its digest. An archive's captures, sorted by URL key,
time, id and place, are a run of the index. The runs' rows are dealt by ranges
of that order; a range restores its pieces of the runs and merges them with a
loser tree, one replay of a path per capture. The ranges follow each other, so
the merged index is globally ordered: each URL's captures stand together in the
order of time. The place is part of the order, so a URL with a third of all
captures is cut into ranges like any other.

Tasks write files under names of their own; the table of archives that Spark
commits names those that count, so repeated and lost tasks leave no trace in the
result. Files are opened with ``pyarrow.fs`` by the URI of the shared folder.

Edge cases: a null html is an empty payload; a null url has no target and the key
''; a page without id is always a response, and no other refers to it; rows that
repeat a page id are captures of their own (with equal payloads under the
smallest id all are responses); control characters and blanks in a url are
percent-encoded; a payload of any length is one record; extra columns are
ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from hashlib import sha1
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelens.llm.store import buckets_for, shared_folder, stored
from carelens.llm.text import slices

#: Fixed format of the record ids and the time of page 0; page n is captured n seconds later.
ID = "<urn:carelens:page:{}>"
START = datetime(2020, 1, 1, tzinfo=timezone.utc)
CHUNK = 1 << 16
CAPTURE = ("url_key string, stamp string, page_id long, payload_digest string, payload_bytes long, record_type string, "
           "refers_to long, valid boolean, archive string, place long, length long")
ORDER = ["url_key", "stamp", "page_id", "archive", "place"]


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Sort-friendly form: host parts reversed, no scheme, port or fragment, lower case, query arguments sorted."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = u.hostname or ""
    except ValueError:
        return url.lower()
    host = re.sub(r"^www\d*\.", "", host)
    query = "&".join(sorted(u.query.lower().split("&"))) if u.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (u.path.lower() or "/") + ("?" + query if query else "")


def _target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One uncompressed WARC record; a revisit if it refers to another page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers is not None else http + payload
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if refers is None else "revisit"),
             "WARC-Date: " + (START + timedelta(seconds=page or 0)).strftime("%Y-%m-%dT%H:%M:%SZ"),
             "WARC-Payload-Digest: sha1:" + digest, "Content-Type: application/http; msgtype=response"]
    if page is not None:
        lines.append("WARC-Record-ID: " + ID.format(page))
    if url is not None:
        lines.append("WARC-Target-URI: " + _target(url))
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  "WARC-Refers-To: " + ID.format(refers)]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, file_bytes: int):
    """Archives of a task's pages; a row (archive, records) for each."""
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        name, out, size, records = None, None, 0, 0
        for batch in batches:
            for part in slices(batch, "html"):
                for r in part.to_pylist():
                    if out is None:
                        name, size, records = uuid.uuid4().hex + ".warc.gz", 0, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    payload = (r["html"] or "").encode()
                    data = _member(record(r["page_id"], r["url"], payload, bare_digest(payload), r["refers"]))
                    out.write(data)
                    size, records = size + len(data), records + 1
                    if size >= file_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pylist([{"archive": name, "records": records}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": records}])
    return run


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(place, length, data) of each gzip member of a stream."""
    place, z, data, used = 0, zlib.decompressobj(31), [], 0
    chunk = stream.read(CHUNK)
    while chunk:
        data.append(z.decompress(chunk))
        used += len(chunk) - len(z.unused_data)
        if z.eof:
            yield place, used, b"".join(data)
            chunk = z.unused_data
            place, z, data, used = place + used, zlib.decompressobj(31), [], 0
            chunk = chunk or stream.read(CHUNK)
        else:
            chunk = stream.read(CHUNK)
    if used:
        raise ValueError(f"cut off record at {place}")


def _page(urn: str | None) -> int | None:
    m = re.search(r":page:(-?\d+)>$", urn or "")
    return int(m.group(1)) if m else None


def capture(data: bytes) -> dict:
    """Index fields of a record."""
    head, _, body = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    field = dict(x.split(": ", 1) for x in lines)
    length = int(field["Content-Length"])
    if first != "WARC/1.1" or body[length:] != b"\r\n\r\n":
        raise ValueError("not a WARC/1.1 record")
    http, _, payload = body[:length].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = field["WARC-Type"] == "response"
    return {"url_key": url_key(field.get("WARC-Target-URI", "")), "stamp": re.sub("[^0-9]", "", field["WARC-Date"]),
            "page_id": _page(field.get("WARC-Record-ID")), "payload_digest": digest, "payload_bytes": size,
            "record_type": field["WARC-Type"], "refers_to": _page(field.get("WARC-Refers-To")),
            "valid": not whole or (len(payload) == size and bare_digest(payload) == digest)}


_RUN = pa.schema([("url_key", pa.string()), ("stamp", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()),
                  ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                  ("valid", pa.bool_()), ("archive", pa.string()), ("place", pa.int64()), ("length", pa.int64()),
                  ("seq", pa.int64())])


def _order(r: dict) -> tuple:
    return (r["url_key"], r["stamp"], r["page_id"] is not None, r["page_id"] or 0, r["archive"], r["place"])


def _read(folder: str):
    """The sorted run of each archive."""
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows = [capture(data) | {"archive": name, "place": place, "length": length}
                            for place, length, data in members(stream)]
                rows.sort(key=_order)
                for i, r in enumerate(rows):
                    r["seq"] = i
                for lo in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist(rows[lo:lo + 4096], _RUN)
    return run


class LoserTree:
    """k-way merge: an inner node keeps the run that lost there, the last winner is the next item.
    Taking it replays only the path from its leaf to the top."""

    def __init__(self, runs: list[list]):
        self.runs, self.at, self.k = runs, [0] * len(runs), max(len(runs), 1)
        self.loser = [-1] * self.k
        for i in reversed(range(len(runs))):
            self._replay(i)

    def _before(self, a: int, b: int) -> bool:
        """Run a's next item stands before run b's; -1 stands before all, a run that is used up after all."""
        if a < 0 or b < 0:
            return a < 0
        if self.at[a] == len(self.runs[a]):
            return False
        return self.at[b] == len(self.runs[b]) or self.runs[a][self.at[a]] < self.runs[b][self.at[b]]

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self._before(self.loser[node], i):
                i, self.loser[node] = self.loser[node], i
            node //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.runs and self.at[self.loser[0]] < len(self.runs[self.loser[0]]):
            i = self.loser[0]
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._replay(i)


def _merge(batches):
    """Merge the pieces of the runs in a range: rows in order, with the place inside the range."""
    table = pa.Table.from_batches(list(batches), _RUN)
    if not table.num_rows:
        return
    run = table.column("archive").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.lexsort((table.column("seq").to_numpy(), run))
    edges = [0, *(np.flatnonzero(np.diff(run[order])) + 1).tolist(), len(order)]
    keys = [_order(r) for r in table.select([*ORDER]).to_pylist()]
    runs = [[(keys[i], i) for i in order[a:b].tolist()] for a, b in zip(edges, edges[1:])]
    taken = pa.array([i for _, i in LoserTree(runs)])
    out = table.take(taken).drop_columns(["seq"]).append_column("at", pa.array(np.arange(len(taken))))
    yield from out.to_batches(max_chunksize=4096)


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 32 << 20, least: int = 0) -> DataFrame:
    """Write the pages' archives under ``folder``; returns the stored table (archive, records)."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # equal payloads by SHA-1, the digest that the records carry
    size, digest = F.octet_length("html"), F.unhex(F.sha1(F.col("html").cast("binary")))
    first = (pages.filter(size >= least).groupBy(digest.alias("digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
             .filter("c > 1").select("digest", "first"))
    repeats = stored(pages.filter(size >= least).select("page_id", digest.alias("digest")).join(first, "digest")
                     .filter("page_id <> first").select("page_id", "digest", "first").distinct())
    marked = pages.join(repeats.select(F.col("page_id").alias("id"), "digest", F.col("first").alias("refers")),
                        (F.col("page_id") == F.col("id")) & (digest == F.col("digest")), "left")
    kept = marked.select("page_id", "url", "html", "refers")
    return stored(kept.mapInArrow(_write(folder, file_bytes), "archive string, records long"))


def captures(archives: DataFrame, folder: str) -> DataFrame:
    """The runs of a table of archives: a row per record with ``seq``, its place in its archive's sorted run."""
    tasks = min(max(1, archives.count()), 32 * buckets_for(archives.sparkSession, 0, 1))
    return stored(archives.select("archive").repartition(tasks).mapInArrow(_read(folder), CAPTURE + ", seq long"))


def merged_index(runs: DataFrame, per_range: int = 50_000) -> DataFrame:
    """The runs merged into one order (CAPTURE and ``rank``, from 1); stored, one file per range."""
    ranges = buckets_for(runs.sparkSession, runs.count(), per_range)
    order = [F.col(c).asc_nulls_first() for c in ORDER]
    merged = stored(runs.repartitionByRange(ranges, *order).mapInArrow(_merge, CAPTURE + ", at long")
                    .withColumn("range", F.spark_partition_id()))
    sizes = merged.groupBy("range").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    return merged.join(sizes, "range").withColumn("rank", F.col("start") + F.col("at") + 1).drop("range", "at", "start")


def archive_folder(spark) -> str:
    """A new folder for archives under the shared one, as a URI."""
    path = os.path.join(shared_folder(spark), "archives", uuid.uuid4().hex)
    path = path if "://" in path or path.startswith("file:") else "file://" + path
    store, base = fs.FileSystem.from_uri(path)
    store.create_dir(base)
    return path


def warc_index(pages: DataFrame, file_bytes: int = 32 << 20, least: int = 0) -> DataFrame:
    """Archives of the pages, written and read back: the merged capture index."""
    folder = archive_folder(pages.sparkSession)
    return merged_index(captures(write_archives(pages, folder, file_bytes, least), folder))
