"""Substring dedup by difference-cover anchors.

A 50-word passage that occurs in two documents at offsets i and j holds, for
some shift below the period, a position that lies in the cover in both texts.
So it is enough to hash anchors (20 words) at cover positions modulo 31: any
equal passage shares an aligned anchor.

1. Anchors of every text, combined per slice, meet by hash; each learns the
   first document (smallest id) that has it.
2. Anchors of a document whose partner lies on one diagonal chain up: what they
   span equals the partner's text. Around the chains, where a match may extend
   left or right of its anchors, the 50-word windows themselves are compared by
   96-bit hashes in one more exchange.
3. Words covered by a window that a smaller id also has are dropped.

Only anchors and the windows around shared anchors are shuffled, never pairs. A
passage in very many documents enters an exchange once per slice of texts, the
other occurrences in the slice are resolved where they are.

Edge cases: a null or empty text has no words; documents under 50 words keep
all; a null doc_id is nobody's earlier document and its text is left whole;
rows that repeat a doc_id are judged each on its own text, never against each
other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelens.llm.text import Words, base_columns, mix, rolling, signed, slices

WINDOW = 50
PERIOD = 31
#: A perfect difference cover modulo 31: every difference occurs. Fixed values.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True

#: ``hash`` and ``src_*`` are set only on rows that were resolved inside their slice.
ANCHOR_SCHEMA = "k long, doc_id long, pos int, hash long, src_doc long, src_pos int, shared boolean"
#: ``hi`` is set only on resolved ranges; ``th`` tells apart rows that repeat a doc_id.
WINDOW_SCHEMA = "k long, k2 int, doc_id long, th int, lo int, hi int"


def _anchors(words: Words):
    """Word indices and hashes of the cover anchors of texts of 50 words or more."""
    h = rolling(words.hashes(11), ANCHOR, 11)
    i = np.flatnonzero(_IN_COVER[words.pos % PERIOD][:len(h)])
    fits = (words.pos[i] + ANCHOR <= words.n[words.row[i]]) & (words.n[words.row[i]] >= WINDOW)
    i = i[fits]
    return i, h[i]


def _emit_anchors(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            i, h = _anchors(w)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            doc, row, pos = ids[w.row[i]], w.row[i], w.pos[i]
            order = np.lexsort((pos, row, doc, h))
            h, doc, row, pos = h[order], doc[order], row[order], pos[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, doc, row, pos = h[once], doc[once], row[once], pos[once]
            head = np.ones(len(h), bool)
            head[1:] = h[1:] != h[:-1]
            lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(h) else np.zeros(0, int)
            alone = np.bincount(lead, minlength=len(h))[lead] == 1 if len(h) else head
            key = np.where(head, h, mix(h ^ mix(doc.view(np.uint64))))
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(key)), pa.array(doc), pa.array(pos.astype(np.int32)),
                pa.array(signed(h), mask=head), pa.array(doc[lead], mask=head),
                pa.array(pos[lead].astype(np.int32), mask=head), pa.array(~alone)],
                names=["k", "doc_id", "pos", "hash", "src_doc", "src_pos", "shared"])


def _spread(size: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Boolean array, true inside any of the half-open ranges."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d)[:size] > 0


def _runs(flag: np.ndarray, row: np.ndarray):
    """[lo, hi) of the runs of true entries that stay inside one row."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on
    cut = np.flatnonzero((np.diff(on) > 1) | (np.diff(row[on]) != 0)) + 1
    return on[np.concatenate([[0], cut])], on[np.concatenate([cut - 1, [len(on) - 1]])] + 1


def _emit_windows(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            th = part.column("th").to_numpy(zero_copy_only=False)
            lists = part.column("links")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            known = flat.field("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            src, src_pos = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("src_doc", "src_pos"))
            i, h = _anchors(w)
            salt = mix(np.arange(len(w.n), dtype=np.uint64))
            have, want = known ^ salt[owner], h ^ salt[w.row[i]]
            order = np.argsort(have)
            have = have[order]
            at = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
            hit = have[at] == want if len(have) else np.zeros(len(want), bool)
            i, at = i[hit], order[at[hit]]
            size = len(w.start)
            row, pos, partner, diagonal = w.row[i], w.pos[i], src[at], w.pos[i] - src_pos[at]
            # chains: anchors of one document that lie on one diagonal of an earlier one
            c = np.flatnonzero(partner < ids[row])
            c = c[np.lexsort((i[c], diagonal[c], partner[c], row[c]))]
            solid = np.zeros(size, bool)
            done = np.zeros(size, bool)
            if len(c):
                new = np.ones(len(c), bool)
                new[1:] = ((row[c][1:] != row[c][:-1]) | (partner[c][1:] != partner[c][:-1])
                           | (diagonal[c][1:] != diagonal[c][:-1]) | (np.diff(i[c]) > ANCHOR))
                a = np.flatnonzero(new)
                lo, hi = i[c][a], i[c][np.append(a[1:], len(c)) - 1] + ANCHOR
                long = hi - lo >= WINDOW
                solid = _spread(size, lo[long], hi[long])
                done = _spread(size, lo[long], hi[long] - WINDOW + 1)
            near = _spread(size, np.maximum(i - (WINDOW - ANCHOR), w.first[row]), i + 1)
            fits = w.pos + WINDOW <= w.n[w.row]
            at = np.flatnonzero(near & fits & ~done)
            h1, h2 = rolling(w.hashes(21), WINDOW, 21), rolling(w.hashes(31), WINDOW, 31)
            h1, h2 = h1[at], h2[at]
            row = w.row[at]
            doc = ids[row]
            order = np.lexsort((doc, h2, h1))
            at, h1, h2, doc, row = at[order], h1[order], h2[order], doc[order], row[order]
            head = np.ones(len(at), bool)
            head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(at) else np.zeros(0, int)
            later = doc[lead] < doc
            solid |= _spread(size, at[later], at[later] + WINDOW)
            lo, hi = _runs(solid, w.row)
            sel = np.flatnonzero(~later)  # the smallest id stands for the later ones of the slice
            at, h1, h2, row = at[sel], h1[sel], h2[sel], row[sel]
            r = w.row[lo]
            base = w.first[r]
            n1, n2 = len(at), len(lo)
            k = np.concatenate([h1, mix(ids[r].view(np.uint64) ^ mix(lo.astype(np.uint64)))])
            ranged = np.concatenate([np.ones(n1, bool), np.zeros(n2, bool)])
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(k)),
                pa.array(np.concatenate([(h2 >> np.uint64(32)).astype(np.uint32).view(np.int32),
                                         np.zeros(n2, np.int32)])),
                pa.array(np.concatenate([ids[row], ids[r]])), pa.array(np.concatenate([th[row], th[r]])),
                pa.array(np.concatenate([w.pos[at], lo - base]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(n1, int), hi - base]).astype(np.int32), mask=ranged)],
                names=["k", "k2", "doc_id", "th", "lo", "hi"])


def _cut(batches):
    for batch in batches:
        texts, spans, own = batch.column("text"), batch.column("spans"), batch.column("th").to_numpy()
        n, removed, kept, sha = [], [], [], []
        for t, s, th in zip(texts, spans, own):
            words = (t.as_py() or "").encode().split()
            n.append(len(words))
            if s.is_valid:
                gone = np.zeros(len(words) + 1, np.int64)
                lo = np.asarray(s.values.field("lo"))
                hi = np.asarray(s.values.field("hi"))
                mine = np.asarray(s.values.field("th")) == th
                np.add.at(gone, lo[mine], 1)
                np.add.at(gone, hi[mine], -1)
                stay = np.cumsum(gone)[:-1] == 0
                words = [x for x, k in zip(words, stay.tolist()) if k]
            removed.append(n[-1] - len(words))
            out = b" ".join(words)
            kept.append(out)
            sha.append(hashlib.sha256(out).hexdigest())
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha, pa.string())],
            names=["doc_id", "n_words", "n_removed", "text", "kept_sha256"])


def cover_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text, kept_sha256): every document with the
    words of repeated 50-word windows taken out; ``text`` is what is left."""
    docs = base_columns(docs, "doc_id", "text").withColumn("th", F.hash("text"))
    named = docs.filter(F.col("doc_id").isNotNull())
    order = Window.partitionBy("k").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    links = (named.select("doc_id", "text").mapInArrow(_emit_anchors, ANCHOR_SCHEMA)
             .withColumn("head", F.first(F.struct("doc_id", "pos")).over(order))
             .withColumn("next", F.lead("doc_id").over(Window.partitionBy("k").orderBy("doc_id", "pos")))
             .filter(F.col("shared") | F.col("hash").isNotNull() | (F.col("head.doc_id") < F.col("doc_id"))
                     | F.col("next").isNotNull())
             .groupBy("doc_id")
             .agg(F.collect_list(F.struct(
                 F.coalesce("hash", "k").alias("hash"), F.coalesce("src_doc", "head.doc_id").alias("src_doc"),
                 F.coalesce("src_pos", "head.pos").alias("src_pos"))).alias("links")))
    windows = (named.join(links, "doc_id")
               .select("doc_id", "th", "text", "links").mapInArrow(_emit_windows, WINDOW_SCHEMA))
    order = Window.partitionBy("k", "k2").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    spans = (windows.withColumn("head", F.first("doc_id").over(order))
             .filter(F.col("hi").isNotNull() | (F.col("head") < F.col("doc_id")))
             .groupBy("doc_id")
             .agg(F.collect_list(F.struct("th", "lo", F.coalesce("hi", F.col("lo") + WINDOW).alias("hi")))
                  .alias("spans")))
    out = "doc_id long, n_words long, n_removed long, text string, kept_sha256 string"
    whole = docs.filter(F.col("doc_id").isNull()).withColumn(
        "spans", F.lit(None).cast("array<struct<th:int,lo:int,hi:int>>"))
    # both joins deal the texts out by doc_id alone, so Spark shuffles them once
    return (named.join(spans, "doc_id", "left").select("doc_id", "th", "text", "spans")
            .unionByName(whole.select("doc_id", "th", "text", "spans")).mapInArrow(_cut, out))
