"""Cases in which a shortened candidate search loses results."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa

from carelens.llm.bag_minhash import near_duplicates
from carelens.llm.decontaminate import contained_items
from carelens.llm.fuzzy_lines import dedup_lines
from carelens.llm.sparse_suffixes import REACH, _neighbours, repeated_passages
from carelens.llm.suffix_tree_lm import suffix_tree_lm
from tests.llm import brute


def plain_suffix_tree(rows, depth=6, gain=2.0):
    """doc_id -> log10 probability, with every suffix of 1 .. depth words counted."""
    texts = [(d, brute.lower(t) + [None]) for d, t in rows]
    learn = [t for d, t in texts if d is None or crc32(str(d).encode()) % 10]
    count = Counter(x for t in learn for x in t)
    n = sum(count.values())
    unknown = (sum(c == 1 for w, c in count.items() if w is not None) + 0.5) / (n + 1) if n else 1.0
    follow = defaultdict(Counter)
    for t in learn:
        for i in range(1, len(t)):
            for k in range(1, min(depth, i) + 1):
                follow[tuple(t[i - k:i])][t[i]] += 1
    sums = {s: (sum(f.values()), len(f)) for s, f in follow.items()}

    def p(s, x, out=0):
        if not s:
            return (1 - unknown) * count[x] / n if count[x] else unknown
        total, types = sums[s]
        return (follow[s][x] - out + types * p(s[1:], x, out)) / (total - out + types)

    tree = set()
    for s, f in follow.items():
        if sums[s][0] >= 2 and sum(c * math.log(p(s, x, 1) / p(s[1:], x, 1)) for x, c in f.items()) > gain:
            tree |= {s[j:] for j in range(len(s))}
    score = Counter()
    for d, t in texts:
        for i, x in enumerate(t):
            k = max((k for k in range(1, min(depth, i) + 1) if tuple(t[i - k:i]) in tree), default=0)
            score[d] += math.log10(p(tuple(t[i - k:i]), x))
    return score, tree


def test_language_model_counts_contexts_of_common_words(make, corpus):
    rng = random.Random(2)
    verse = "the cat sat on the mat and the dog sat on the log by the cat and the dog".split()
    rows = corpus + [(5000 + i, " ".join(verse[rng.randrange(9):rng.randrange(9, 19)] * 2)) for i in range(60)]
    rows += [(None, "the cat sat"), (5003, "on the mat")]
    want, tree = plain_suffix_tree(rows)
    assert {len(s) for s in tree} >= {1, 2, 3}
    for rare in (1e-6, 0.01):
        got = {r.doc_id: r.score for r in suffix_tree_lm(make(rows), rare=rare).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[d] - want[d]) < 1e-6 * max(1, abs(want[d])) for d in want)


def test_fuzzy_lines_of_one_template(make):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    shared, lines = "q" + text(81), []
    for _ in range(150):
        own = text(9) + "z"
        lines += [shared + own + text(7) + "x" for _ in range(2)]
    rng.shuffle(lines)
    rows = [(i + 1, "\n".join(lines[i * 10:i * 10 + 10])) for i in range(30)]
    got = {r.doc_id: r for r in dedup_lines(make(rows)).collect()}
    want = brute.lines_removed(rows)
    assert sum(map(len, want.values())) == 150
    for d, t in rows:
        assert got[d].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(d, []))


def test_near_duplicates_of_one_template(make):
    rng = random.Random(9)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, texts = word(176), []
    for _ in range(120):
        own = word(10)
        texts += [" ".join(shared + own + word(19)) for _ in range(2)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: r.class_id for r in near_duplicates(make(rows)).collect()}
    want = brute.near_classes(rows)
    assert len(set(want.values())) == 120
    assert got == want


def test_repeats_of_one_document_over_batches():
    words = np.arange(1, REACH + 1, dtype=np.uint32).tobytes()

    def batch(docs, pos):
        n = len(docs)
        return pa.RecordBatch.from_arrays(
            [pa.array([7] * n), pa.array(docs), pa.array(pos, pa.int32()), pa.array([words] * n), pa.array([words] * n)],
            names=["gram", "doc_id", "pos", "ahead", "behind"])
    found = list(_neighbours([batch([1] + [2] * 6000, [50, *range(6000)]), batch([2] * 5000, list(range(6000, 11000))),
                              batch([2] * 10 + [3], [*range(11000, 11010), 9])]))
    hit = {(d, lo + REACH) for b in found for d, lo in zip(b.column("doc_id").to_pylist(), b.column("lo").to_pylist())
           if b.column("src_doc").null_count == 0}
    assert hit == {(2, i) for i in range(11010)} | {(3, 9)}


def test_passages_of_many_documents(make):
    rng = random.Random(6)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for size in (50, 53, 60):
        passage = word(size)
        rows += [word(rng.randrange(30, 60)) + passage + word(rng.randrange(30, 60)) for _ in range(300)]
    long_, ids = word(90), rng.sample(range(1, 2000), 960)
    rows += [word(40) + long_[a:a + 58] + word(40) for a in (0, 5, 10, 15, 20, 25) * 10]
    rows = [(d, " ".join(t)) for d, t in zip(ids, rows)]
    texts = {d: brute.words(t) for d, t in rows}
    cover = {}
    for r in repeated_passages(make(rows)).collect():
        a = texts[r.doc_id][r.start:r.start + r.n_words]
        assert a == texts[r.src_doc_id][r.src_start:r.src_start + r.n_words] and r.src_doc_id < r.doc_id
        cover.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    want = {d: v[1] for d, v in brute.windows_removed(rows).items() if v[1]}
    assert {d: len(v) for d, v in cover.items()} == want


def test_items_of_one_shingle(spark, make):
    rng = random.Random(8)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [word(300) for _ in range(150)]
    items = [(i * 10 + j, " ".join(t[j * 28 + 3:j * 28 + 8 + i % 3])) for i, t in enumerate(texts) for j in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts, 1)]
    got = {(r.item_id, r.doc_id) for r in contained_items(
        make(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i // 10 + 1) for i, _ in items}
