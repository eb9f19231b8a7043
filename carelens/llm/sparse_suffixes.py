"""Repeated passages by a sparse suffix array.

Suffixes are kept only where a minimiser selects them: of every 35 consecutive
16-word sequences the one with the smallest hash. A passage of 50 words holds
one such window whole, so both its occurrences keep the same suffix.

1. Suffixes whose first 16 words occur once are dropped (one exchange of hashes).
2. The others get their neighbouring words, 34 to the right and 34 to the left,
   and are sorted by them within equal beginnings, once to the right and once to
   the left. Neighbours of other documents in either order are compared and the
   match is extended left and right word by word; together they must reach 50.
3. Near neighbours need not include the earliest holder of a passage. So each
   window of 50 words around a suffix that no earlier document's match covers is
   exchanged by its hash, unless the sort shows that no other document shares its
   longer side; the smallest document of a window is the source of the others. A
   window's first holder is never covered, so none of its holders is lost.
4. The matches of a document that lie on one diagonal of the same earlier
   document are joined up to the whole passage.

Sorted suffixes are streamed: a task holds a batch and three rows before it,
whatever the size of a group or the number of repeats inside a document.

Edge cases: null or empty texts and texts under 50 words have no passages; a
null doc_id is left out; repeats inside one document (or among rows that repeat
a doc_id) are not reported; extra columns are ignored. Neighbouring words are
compared by 32-bit hashes.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carelens.llm.store import stored
from carelens.llm.text import Words, base_columns, mix, rolling, signed, slices

LENGTH = 50
GRAM = 16
SPAN = LENGTH - GRAM + 1
REACH = LENGTH - GRAM

SUFFIX_SCHEMA = "gram long, doc_id long, many boolean"
CONTEXT_SCHEMA = "gram long, doc_id long, pos int, ahead binary, behind binary"
MATCH_SCHEMA = "doc_id long, lo int, hi int, src_doc long, src_lo int, key long"


def _minimisers(w: Words, h: np.ndarray):
    """Word indices and hashes of the selected 16-word sequences."""
    g = rolling(h, GRAM, 81)
    if len(g) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # sliding minimum by doubling: the smallest of SPAN consecutive hashes
    low, width = g, 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[:len(g) - SPAN + 1], low[SPAN - width:SPAN - width + len(g) - SPAN + 1])
    start = np.arange(len(low))
    start = start[w.pos[start] + LENGTH <= w.n[w.row[start]]]
    order = np.argsort(g, kind="stable")  # leftmost equal hash inside each window
    chosen = np.zeros(len(g), bool)
    chosen[_first_at_or_after(g, order, low[start], start)] = True
    i = np.flatnonzero(chosen)
    return i, g[i]


def _first_at_or_after(g, order, value, start):
    """Index of the first entry from ``start`` on that equals ``value``."""
    sorted_g = g[order]
    # equal hashes stand in index order: search the pair (hash, index)
    group = np.searchsorted(sorted_g, value, side="left")
    key_group = np.searchsorted(sorted_g, sorted_g, side="left")
    scale = np.int64(len(g) + 1)
    keys = key_group * scale + order
    return order[np.searchsorted(keys, group * scale + start, side="left")]


def _emit_suffixes(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            i, g = _minimisers(w, w.hashes(82))
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)[w.row[i]]
            order = np.lexsort((doc, g))
            g, doc = g[order], doc[order]
            # a sequence that meets another document in this slice needs no other proof
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(g)) - 1
            many = (doc[first] != doc[last])[group] if len(g) else np.zeros(0, bool)
            # one row for a document, however often it repeats a sequence
            once = new.copy()
            once[1:] |= doc[1:] != doc[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(g[once])), pa.array(doc[once]), pa.array(many[once])],
                names=["gram", "doc_id", "many"])


def _emit_contexts(batches):
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"))
            h = w.hashes(82)
            word = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            lists = part.column("kept")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            salt = mix(np.arange(len(w.n), dtype=np.uint64))
            have = np.sort(flat ^ salt[np.repeat(np.arange(len(n)), n)])
            i, g = _minimisers(w, h)
            want = g ^ salt[w.row[i]]
            p = np.minimum(np.searchsorted(have, want), max(len(have) - 1, 0))
            hit = have[p] == want if len(have) else np.zeros(len(i), bool)
            i, g = i[hit], g[hit]
            step = np.arange(REACH)
            to = (w.first + w.n)[w.row[i]][:, None]
            right = i[:, None] + GRAM + step[None, :]
            left = i[:, None] - 1 - step[None, :]
            size = max(len(word) - 1, 0)
            ahead = np.where(right < to, word[np.minimum(right, size)], 0) if len(i) else np.zeros((0, REACH), np.uint32)
            behind = np.where(left >= w.first[w.row[i]][:, None], word[np.maximum(left, 0)], 0) if len(i) else ahead
            offsets = pa.py_buffer(np.arange(0, (len(i) + 1) * 4 * REACH, 4 * REACH, dtype=np.int32))
            pack = lambda a: pa.Array.from_buffers(
                pa.binary(), len(i), [None, offsets, pa.py_buffer(np.ascontiguousarray(a, np.uint32))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(g)), pa.array(ids[w.row[i]]), pa.array(w.pos[i].astype(np.int32)), pack(ahead),
                 pack(behind)], names=["gram", "doc_id", "pos", "ahead", "behind"])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of word rows (0 is no word)."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _prefixes(words: np.ndarray, seed: int, low: int, high: int) -> dict:
    """Hashes of the first ``low`` .. ``high`` words of each row."""
    h, out = np.full(len(words), seed, np.uint64), {}
    for k in range(high + 1):
        if k >= low:
            out[k] = h
        if k < high:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return out


def _windows(words: dict, gram, rows, near, done, column: str):
    """(row, words to the left, key) of the windows of LENGTH words around the
    sorted suffixes ``rows`` that another document may hold (``near``: words that
    the nearest one shares in the sort order) and no match found covers. Half of a
    window or more lies on the sorted side."""
    yield np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    half = REACH // 2
    low = half if column == "ahead" else half + 1
    rows = rows[near[rows] >= low]
    other = "behind" if column == "ahead" else "ahead"
    for at in range(0, len(rows), 20_000):
        i = rows[at:at + 20_000]
        a, b = words[column][i], words[other][i]
        this, that = _prefixes(a, 1, low, REACH), _prefixes(b, 2, 0, REACH - low)
        for k in range(low, REACH + 1):
            left = REACH - k if column == "ahead" else k
            on = (near[i] >= k) & ((done[i] >> np.uint64(left)) & np.uint64(1) == 0)
            if k < REACH:
                on &= b[:, REACH - k - 1] != 0
            key = mix(gram[i[on]].view(np.uint64) + np.uint64(left)) ^ this[k][on]
            yield i[on], np.full(int(on.sum()), left), mix(mix(key) ^ that[REACH - k][on])


def _neighbours(batches, column: str = "ahead"):
    """Compare each sorted suffix with the two nearest of other documents on both
    sides; the later document of a match gets it. The windows that no match with an
    earlier document covers go out with a key, to be compared as a whole."""
    carry, old = None, 0
    names = ["doc_id", "lo", "hi", "src_doc", "src_lo", "key"]
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if carry is None else [carry, batch]).combine_chunks()
        gram, doc, pos = (t.column(c).to_numpy() for c in ("gram", "doc_id", "pos"))
        words = {c: np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint32).reshape(len(gram), REACH)
                 for c in ("ahead", "behind")}
        run = np.ones(len(gram), bool)
        run[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(run)[np.cumsum(run) - 1]
        found = []
        before = start - 1
        # words shared with the nearest other document; the last run's next one is not known
        ends = np.append(np.flatnonzero(run)[1:], len(gram)) - 1
        after = (ends + 1)[np.cumsum(run) - 1]
        near = np.where(after < len(gram), 0, (words[column] != 0).sum(axis=1))
        done = np.zeros(len(gram), np.uint64)
        for other in (before, after):
            i = np.flatnonzero((other >= 0) & (other < len(gram)))
            i = i[gram[other[i]] == gram[i]]
            near[i] = np.maximum(near[i], _common(words[column][i], words[column][other[i]]))
        for _ in range(2):
            i = np.flatnonzero((before >= 0) & (gram[np.maximum(before, 0)] == gram))
            j = before[i]
            left = _common(words["behind"][i], words["behind"][j])
            total = left + GRAM + _common(words["ahead"][i], words["ahead"][j])
            for a, b in ((i, j), (j, i)):
                ok = (total >= LENGTH) & (doc[b] < doc[a])
                found.append((a[ok], b[ok], left[ok], total[ok] - left[ok]))
                # windows with max(0, REACH - right) .. left words to the left are settled
                low = np.maximum(REACH + GRAM - found[-1][3], 0).astype(np.uint64)
                bits = ((np.uint64(2) << left[ok].astype(np.uint64)) - np.uint64(1)) >> low << low
                np.bitwise_or.at(done, a[ok], bits)
            before = np.where(before >= 0, start[np.maximum(before, 0)] - 1, -1)
        # rows that later ones may still meet: the last of each of the last three runs
        carry = t.take(pa.array(ends[-3:])).combine_chunks().to_batches()[0]
        open_ = list(_windows(words, gram, np.arange(old, len(gram)), near, done, column))
        old = carry.num_rows
        a, b, left, right = (np.concatenate(x) for x in zip(*found))
        # of each suffix the longest match, and those that reach further on a side
        order = np.lexsort((-left - right, a))
        a, b, left, right = a[order], b[order], left[order], right[order]
        head = np.ones(len(a), bool)
        head[1:] = a[1:] != a[:-1]
        lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(a) else np.zeros(0, int)
        use = head | (left > left[lead]) | (right > right[lead])
        a, b, left, right = a[use], b[use], left[use], right[use]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[a]), pa.array((pos[a] - left).astype(np.int32)), pa.array((pos[a] + right).astype(np.int32)),
             pa.array(doc[b]), pa.array((pos[b] - left).astype(np.int32)), pa.nulls(len(a), pa.int64())], names=names)
        i, left, key = (np.concatenate(x) for x in zip(*open_))
        lo = (pos[i] - left).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[i]), pa.array(lo), pa.array(lo + np.int32(LENGTH)), pa.nulls(len(i), pa.int64()),
             pa.nulls(len(i), pa.int32()), pa.array(signed(key))], names=names)


def _joined(batches):
    """Join the matches of a document that overlap on one diagonal."""
    for batch in batches:
        lists = batch.column("found")
        flat = lists.flatten()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        lo, hi, src, src_lo = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
                               for c in ("lo", "hi", "src_doc", "src_lo"))
        diagonal = lo - src_lo
        order = np.lexsort((hi, lo, diagonal, src, owner))
        owner, lo, hi, src, diagonal = (x[order] for x in (owner, lo, hi, src, diagonal))
        same = np.zeros(len(lo), bool)
        same[1:] = (owner[1:] == owner[:-1]) & (src[1:] == src[:-1]) & (diagonal[1:] == diagonal[:-1])
        # running end inside each diagonal
        step = hi.max(initial=0) + 1
        reach = np.maximum.accumulate(hi + np.cumsum(~same) * step) - np.cumsum(~same) * step
        new = ~same
        new[1:] |= lo[1:] > reach[:-1]
        a = np.flatnonzero(new)
        end = np.maximum.reduceat(hi, a) if len(a) else hi
        ids = batch.column("doc_id").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[owner[a]]), pa.array(lo[a]), pa.array(end - lo[a]), pa.array(src[a]),
             pa.array(lo[a] - diagonal[a])], names=["doc_id", "start", "n_words", "src_doc_id", "src_start"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, src_doc_id, src_start): passages of 50 words or
    more of a document that an earlier document (smaller id) holds too."""
    docs = base_columns(docs, "doc_id", "text").filter(F.col("doc_id").isNotNull())
    suffixes = docs.mapInArrow(_emit_suffixes, SUFFIX_SCHEMA)
    order = Window.partitionBy("gram").orderBy("doc_id")
    kept = (suffixes.withColumn("p", F.lag("doc_id").over(order)).withColumn("q", F.lead("doc_id").over(order))
            .filter("many OR p IS NOT NULL OR q IS NOT NULL")
            .groupBy("doc_id").agg(F.collect_set("gram").alias("kept")))
    contexts = (docs.join(kept, "doc_id").select("doc_id", "text", "kept").mapInArrow(_emit_contexts, CONTEXT_SCHEMA)
                .repartition("gram"))
    found = None
    for column in ("ahead", "behind"):
        part = contexts.sortWithinPartitions("gram", column, "doc_id", "pos").mapInArrow(
            partial(_neighbours, column=column), MATCH_SCHEMA)
        found = part if found is None else found.unionByName(part)
    found = stored(found)
    windows = found.filter("key IS NOT NULL").select("key", "doc_id", "lo", "hi")
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "lo")).alias("s"), F.max("doc_id").alias("last")).filter("s.doc_id < last")
    late = windows.join(first, "key").filter("doc_id > s.doc_id").select(
        "doc_id", "lo", "hi", F.col("s.doc_id").alias("src_doc"), F.col("s.lo").alias("src_lo"))
    found = found.filter("key IS NULL").drop("key").unionByName(late)
    return (found.groupBy("doc_id").agg(F.collect_set(F.struct("lo", "hi", "src_doc", "src_lo")).alias("found"))
            .mapInArrow(_joined, "doc_id long, start long, n_words long, src_doc_id long, src_start long"))
