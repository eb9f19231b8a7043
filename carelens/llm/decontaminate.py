"""Benchmark decontamination: short items found inside long documents.

Containment search by MinHash with size partitions. Items (their sets of 5-word
shingles) are partitioned by size, the limit doubling from class to class. For a
class of at most U shingles every document is seen as windows of 2U shingles
that advance by U, so wherever the item stands, one window holds it whole and
the Jaccard similarity between item and window stays above 0.19 at the wanted
containment of 0.8. ``functions`` one-value bands then miss it with probability
0.81 ** functions (4e-5). Minima are taken once over blocks of 8 shingles and
pooled for the larger classes. Every candidate is verified exactly: the share of
the item's distinct shingles that the whole document holds.

Items are a stated query set against all documents, in blocks of ``block``
items, so the index that is broadcast has a fixed bound; a larger benchmark
makes more passes. Nothing is shuffled.

Texts are compared in lower case with ASCII punctuation as blank. Edge cases:
null or empty items and documents never match; an item under five words is a
single shingle of all its words; repeated items and documents give a row per
pair; extra columns pass through ``decontaminate`` unchanged and are ignored by
``contained_items``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.text import Words, mix, rolling, slices

SHINGLE = 5
UNIT = 8
FEW = 4


def _constants(functions: int):
    rng = np.random.default_rng(17)
    return (rng.integers(0, 2**64, functions, dtype=np.uint64),
            rng.integers(0, 2**64, functions, dtype=np.uint64) | np.uint64(1))


def _distinct(row, key):
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _grams(w: Words, h: np.ndarray, k: int):
    r = rolling(h, k, 70 + k)
    at = np.flatnonzero(w.pos[:len(r)] + k <= w.n[w.row[:len(r)]])
    return at, r[at]


def item_index(ids: list, texts: list, functions: int) -> dict:
    """The search index of one block of items."""
    w = Words(pa.array([t or "" for t in texts], pa.large_string()), fold=True)
    h = w.hashes(71)
    row, key, k_of = [], [], np.minimum(w.n, SHINGLE)
    for k in range(1, SHINGLE + 1):
        at, g = _grams(w, h, k)
        on = k_of[w.row[at]] == k
        row.append(w.row[at][on])
        key.append(g[on])
    row, key = _distinct(np.concatenate(row), np.concatenate(key))
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    size = np.diff(first)
    classes: dict[int, list] = {}
    xor, mul = _constants(functions)
    for i in np.flatnonzero((size >= FEW) & (w.n >= SHINGLE)):
        unit = UNIT
        while unit < size[i]:
            unit *= 2
        classes.setdefault(unit, []).append(i)
    bands = {}
    for unit, items in classes.items():
        for f in range(functions):
            v = np.array([((key[first[i]:first[i + 1]] ^ xor[f]) * mul[f]).min() for i in items], np.uint64)
            order = np.argsort(v)
            bands[unit, f] = (v[order], np.array(items)[order])
    short = {k: np.flatnonzero((w.n == k)) for k in range(1, SHINGLE)}
    few = (size < FEW) & (w.n >= SHINGLE)
    return {"ids": ids, "key": key, "first": first, "size": size, "bands": bands,
            "units": sorted(classes), "functions": functions,
            "short": {k: (key[first[i]], i) for k, i in short.items() if len(i)}
            | ({SHINGLE: (key[few[row]], row[few[row]])} if few.any() else {})}


def _expand(values, items, found):
    """All (position in ``found``, item) with an equal value; values are sorted."""
    lo, hi = np.searchsorted(values, found, "left"), np.searchsorted(values, found, "right")
    n = hi - lo
    at = np.repeat(np.arange(len(found)), n)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, items[np.repeat(lo, n) + inside]


def _search(index: dict, col: pa.Array, threshold: float):
    """(row, item, shared shingles) of the items held by the texts of a slice."""
    w = Words(col, fold=True)
    h = w.hashes(71)
    at, key = _grams(w, h, SHINGLE)
    row, pos = w.row[at], w.pos[at]
    rows, items = [], []
    if len(at) and index["units"]:
        xor, mul = _constants(index["functions"])
        new = np.ones(len(at), bool)
        new[1:] = (row[1:] != row[:-1]) | (pos[1:] // UNIT != pos[:-1] // UNIT)
        cut = np.flatnonzero(new)
        brow, bnum = row[cut], pos[cut] // UNIT
        pools = {}
        for unit in index["units"]:
            g = bnum // (unit // UNIT)
            new = np.ones(len(cut), bool)
            new[1:] = (brow[1:] != brow[:-1]) | (g[1:] != g[:-1])
            p = np.flatnonzero(new)
            pools[unit] = (p, brow[p], np.append(brow[p][1:] == brow[p][:-1], False))
        for f in range(index["functions"]):
            low = np.minimum.reduceat((key ^ xor[f]) * mul[f], cut)
            for unit in index["units"]:
                p, prow, joined = pools[unit]
                v = np.minimum.reduceat(low, p)
                v[:-1] = np.where(joined[:-1], np.minimum(v[:-1], v[1:]), v[:-1])
                values, members = index["bands"][unit, f]
                near = np.minimum(np.searchsorted(values, v), len(values) - 1)
                hit = np.flatnonzero(values[near] == v)
                if len(hit):
                    a, b = _expand(values, members, v[hit])
                    rows.append(prow[hit][a])
                    items.append(b)
    for k, (values, members) in index["short"].items():
        a2, g = (at, key) if k == SHINGLE else _grams(w, h, k)
        order = np.argsort(values)
        a, b = _expand(values[order], members[order], g)
        rows.append(w.row[a2][a])
        items.append(b)
    none = np.zeros(0, np.int64)
    if not rows:
        return none, none, none
    pair = np.unique(np.column_stack([np.concatenate(rows), np.concatenate(items)]), axis=0)
    row_c, item_c = pair[:, 0], pair[:, 1]
    # exact: shingles of the item that the whole document holds
    salt = mix(np.arange(len(w.n), dtype=np.uint64) + np.uint64(5))
    held = [key[np.isin(row, row_c)] ^ salt[row[np.isin(row, row_c)]]]
    for k in index["short"].keys() - {SHINGLE}:
        a2, g = _grams(w, h, k)
        on = np.isin(w.row[a2], row_c)
        held.append(g[on] ^ salt[w.row[a2][on]])
    held = np.unique(np.concatenate(held))
    n = index["size"][item_c]
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    want = index["key"][index["first"][item_c][owner] + inside] ^ salt[row_c[owner]]
    p = np.minimum(np.searchsorted(held, want), max(len(held) - 1, 0))
    shared = np.bincount(owner, held[p] == want if len(held) else np.zeros(len(want)), len(n)).astype(np.int64)
    good = shared >= threshold * n - 1e-9
    return row_c[good], item_c[good], shared[good]


def _blocks(items: DataFrame, block: int, functions: int):
    """Indexes of the benchmark, a bounded block of items at a time."""
    items = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    parts = max(1, -(-items.count() // block))
    for i in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()
        if rows:
            rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
            yield item_index([r["item_id"] for r in rows], [r["text"] for r in rows], functions)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, functions: int = 48,
                    block: int = 20_000) -> DataFrame:
    """(item_id, doc_id, shared, n_shingles, containment): one row per item found in a document."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = (f"item_id {dict(items.dtypes)['item_id']}, doc_id {dict(docs.dtypes)['doc_id']}, "
              "shared long, n_shingles long, containment double")

    def search(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                for part in slices(batch):
                    row, item, n = _search(index, part.column("text"), threshold)
                    size = index["size"][item]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([index["ids"][i] for i in item], target), part.column("doc_id").take(pa.array(row)),
                         pa.array(n), pa.array(size), pa.array(n / np.maximum(size, 1))],
                        names=["item_id", "doc_id", "shared", "n_shingles", "containment"])
        return run
    target = {"bigint": pa.int64(), "int": pa.int32()}.get(dict(items.dtypes)["item_id"], pa.string())
    out = None
    for index in _blocks(items, block, functions):
        found = docs.mapInArrow(search(spark.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, functions: int = 48,
                  block: int = 20_000) -> DataFrame:
    """The documents (all columns) that hold no benchmark item."""
    spark = docs.sparkSession

    def clean(shared):
        def run(batches):
            for batch in batches:
                for part in slices(batch):
                    row, _, _ = _search(shared.value, part.column("text"), threshold)
                    keep = np.ones(part.num_rows, bool)
                    keep[row] = False
                    yield part.filter(pa.array(keep))
        return run
    for index in _blocks(items, block, functions):
        docs = docs.mapInArrow(clean(spark.sparkContext.broadcast(index)), docs.schema)
    return docs
