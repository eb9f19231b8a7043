"""Near-duplicate documents by BagMinHash over multisets of 5-word shingles.

Signature: every shingle owns Poisson processes over its weight axis, one for
each dyadic stretch (0, 1], (1, 2], (2, 4], ... A point has a position, a
signature slot and a weight level; it counts in a document whose weight reaches
that level. A slot keeps its smallest position, so two documents agree in a slot
with probability equal to their weighted Jaccard similarity. Points come in
increasing order, and a process ends as soon as it passes the largest slot of
its document, so most shingles of a long text cost one point.

Candidates: exact copies are merged first (128-bit hash of the text). The slots
are banded; inside a bucket every text is compared with the smallest id. Texts of
buckets that still hold several components (a template, a common passage) are
placed anew, by their rarest shingles (``components.prefix_groups``): any two of them
that are similar enough meet there, the others hardly ever. In such a group a few members
are compared with all of other components, one a round, then all pairs that are
left in different components. Each candidate pair is verified exactly on the
multisets. Components of the verified links are the classes.

Edge cases: texts without a word are never duplicates; texts under five words
are one shingle; a null doc_id is left out of classes and keeps its own row
(class null); rows that repeat a doc_id count as that document's copies; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.components import components, linked, prefix_groups
from carelens.llm.store import discard, stored
from carelens.llm.text import Words, base_columns, mix, rolling, signed, slices

SHINGLE = 5
SIGNATURE_SCHEMA = "doc_id long, a long, b long, size long, bands array<long>"


def shingles(w: Words):
    """(row, hash, weight) of the distinct shingles of each text."""
    h = w.hashes(61)
    r = rolling(h, SHINGLE, 61)
    at = np.flatnonzero(w.pos[:len(r)] + SHINGLE <= w.n[w.row[:len(r)]])
    row, key = w.row[at], r[at]
    short = np.flatnonzero((w.n > 0) & (w.n < SHINGLE))
    extra = np.zeros(len(short), np.uint64)
    for j in range(SHINGLE - 1):
        on = w.n[short] > j
        extra[on] = mix(extra[on] * np.uint64(31) + h[w.first[short[on]] + j])
    row, key = np.concatenate([row, short]), np.concatenate([key, extra])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return row[at], key[at], np.diff(np.append(at, len(row)))


def bag_minhash(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """Signature of each row: the smallest process position of every slot."""
    out = np.full((rows, slots), np.inf)
    top = np.ceil(np.log2(np.maximum(weight, 1))).astype(int)
    part = [(row, key, weight, np.zeros(len(row), int))]
    for k in range(1, int(top.max(initial=0)) + 1):
        on = top >= k
        part.append((row[on], key[on], weight[on], np.full(int(on.sum()), k)))
    row, key, weight, k = (np.concatenate(x) for x in zip(*part))
    low = np.where(k == 0, 0.0, 2.0 ** (k - 1))
    width = np.where(k == 0, 1.0, low)
    state = mix(key ^ mix(k.astype(np.uint64) + np.uint64(77)))
    x = np.zeros(len(row))
    while len(row):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        x = x - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / (width * slots)
        other = mix(state ^ np.uint64(0xD1B54A32D192ED03))
        slot = (other >> np.uint64(32)).astype(np.int64) % slots
        level = low + np.floor((other & np.uint64(0xFFFFFFFF)).astype(float) * 2.0 ** -32 * width)
        hit = level < weight
        np.minimum.at(out, (row[hit], slot[hit]), x[hit])
        go = x < out.max(axis=1)[row]
        row, state, x, weight, low, width = row[go], state[go], x[go], weight[go], low[go], width[go]
    return out


def _signatures(bands, width):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"), lower=True)
                row, key, weight = shingles(w)
                sig = bag_minhash(row, key, weight, len(w.n), bands * width)
                size = np.bincount(row, weight, len(w.n)).astype(np.int64)
                bits = sig.view(np.uint64).reshape(len(w.n), bands, width)
                h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(w.n), bands)).copy()
                for j in range(width):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, j])
                offsets = np.arange(0, (len(w.n) + 1) * bands, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("a"), part.column("b"), pa.array(size),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(h).reshape(-1)))],
                    names=["doc_id", "a", "b", "size", "bands"])
    return run


def _tokens(batches):
    """(node, size, token) of each element of a text's multiset: the copies of a shingle are elements of their own."""
    for batch in batches:
        for part in slices(batch):
            w = Words(part.column("text"), lower=True)
            row, key, weight = shingles(w)
            size = np.bincount(row, weight, len(w.n)).astype(np.int64)
            copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            row, key = np.repeat(row, weight), np.repeat(key, weight)
            token = signed(mix(key + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            ids = part.column("doc_id").to_numpy()
            for lo in range(0, len(row), 100_000):
                r = row[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(size[r]), pa.array(token[lo:lo + 100_000])],
                                                 names=["node", "size", "token"])


def _similar(threshold):
    """Keep the pairs whose multisets overlap enough."""
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                n = part.num_rows
                both = pa.concat_arrays([part.column("text"), part.column("text2")])
                row, key, weight = shingles(Words(both, lower=True))
                order = np.lexsort((row, key, row % n))
                r, k, c = row[order], key[order], weight[order]
                twin = np.flatnonzero((k[1:] == k[:-1]) & (r[1:] == r[:-1] + n))
                common = np.bincount(r[twin], np.minimum(c[twin], c[twin + 1]), n)
                total = np.bincount(row % n, weight, n)
                keep[lo:lo + n] = common >= threshold * (total - common) - 1e-9
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], names=["u", "v"])
    return run


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    pairs = pairs.join(texts.withColumnRenamed("doc_id", "u"), "u")
    pairs = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text2")), "v")
    return pairs.select("u", "v", "text", "text2").mapInArrow(_similar(threshold), "u long, v long")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 16, width: int = 4) -> DataFrame:
    """(doc_id, class_id, copy_of): class_id is the smallest doc_id of the
    document's class, copy_of the smallest doc_id with exactly its text."""
    docs = base_columns(docs, "doc_id", "text")
    hashed = docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"),
                         F.coalesce("text", F.lit("")).alias("text"))
    signed_docs = stored(hashed.filter("doc_id IS NOT NULL").mapInArrow(_signatures(bands, width), SIGNATURE_SCHEMA))
    copies = signed_docs.filter("size > 0").groupBy("a", "b").agg(
        F.min("doc_id").alias("rep"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands"))
    buckets = stored(copies.select("rep", "size", F.explode("bands").alias("bucket"))
                     .join(copies.select(F.explode("bands").alias("bucket")).groupBy("bucket").count()
                           .filter("count > 1").select("bucket"), "bucket"))
    texts = stored(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
                   .dropDuplicates(["doc_id"]))
    # every member with the bucket's smallest id
    first = buckets.groupBy("bucket").agg(F.min("rep").alias("v"))
    pairs = buckets.join(first, "bucket").select(F.col("rep").alias("u"), "v").filter("u <> v").distinct()
    pairs = stored(pairs)
    links = stored(_verified(pairs, texts, threshold))
    # the texts of buckets that still hold several components meet by their rarest shingles
    from_links = components(links)
    placed = buckets.select("bucket", F.col("rep").alias("node")).join(from_links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
    crowded = placed.join(split, "bucket", "left_semi").select(F.col("node").alias("doc_id")).distinct()
    tokens = stored(texts.join(crowded, "doc_id", "left_semi").mapInArrow(_tokens, "node long, size long, token long"))
    groups = stored(prefix_groups(tokens, threshold))
    discard(tokens)
    roots = linked(groups, lambda more: _verified(more, texts, threshold), pairs, from_links, threshold)
    reps = copies.select("a", "b", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "a", "b", "rep", F.coalesce("root", "rep").alias("root"))
    named = signed_docs.filter("size > 0").join(reps, ["a", "b"]).groupBy("doc_id").agg(
        F.min("root").alias("class_id"), F.min("rep").alias("copy_of"))
    return docs.select("doc_id").join(named, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"))


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All columns of one row of each class: the smallest doc_id's; rows without doc_id stay."""
    classes = near_duplicates(docs, threshold)
    stay = classes.filter("doc_id = class_id").select("doc_id").distinct()
    return (docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .unionByName(docs.filter("doc_id IS NULL")).select(*docs.columns))
