"""Merkle manifest against a plain version."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from carelens.llm.merkle import merkle_manifest, merkle_versions


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    fields = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"] if text is None else text]
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proof(tree, i):
    """[(left, right)] of node i up to the top."""
    out = []
    for level in tree[:-1]:
        run = i // 8 * 8
        out.append((level[run:i], level[i + 1:run + 8]))
        i //= 8
    return out


def plain(rows):
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([leaf(r) for r in order if r["lang"] == g]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(x for x in order if x["lang"] == g):
            path = proof(trees[g], i) + proof(top, k)
            node = leaf(r)
            if r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*[x for p in path for s in p for x in s]),
                        node, node == top[-1][0]))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, h string"


def table(rows):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1, "y") for r in rows]


def rows_of(rng, n):
    texts = ["Plain Text", "no capitals", "", None, "ÉÜ Straße ABC", "x" * 5000 + "Y"]
    return [{"doc_id": rng.choice([None, i, i, i, i, i, 5]), "text": rng.choice(texts), "lang": rng.choice(["en", "en", "en", "de", "", None, "é"]),
             "source": rng.choice(["s1", None]), "n_chars": rng.choice([None, i])} for i in range(n)]


def key(t):
    return tuple((x is not None, x if x is not None else 0) for x in t)


@pytest.mark.parametrize("block_levels, n", [(4, 700), (1, 700), (2, 1), (1, 9), (4, 0)])
def test_manifest_equals_plain_version(spark, block_levels, n):
    rows = rows_of(random.Random(n), n)
    if n == 700:  # many groups, so that the upper tree has several rounds too
        rows += [{"doc_id": i, "text": "T", "lang": f"l{i % 90}", "source": "s", "n_chars": 1} for i in range(200)]
        rows += [rows[5], rows[5]]
    got = [tuple(r) for r in merkle_manifest(spark.createDataFrame(table(rows), SCHEMA), levels=block_levels).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    if n == 700:
        assert 0 < sum(not r[6] for r in got) < len(got)


def test_version_copies_only_the_path(spark):
    rows = [{"doc_id": i, "text": "Aa", "lang": "en", "source": "s", "n_chars": 2} for i in range(100)]
    from pyspark.sql import functions as F
    got = merkle_versions(spark.createDataFrame(table(rows), SCHEMA), {"text": F.lit("aa")}, F.col("doc_id") < 3).collect()
    assert all((r.copied is None) == (r.doc_id >= 3) for r in got)
    assert {len(r.copied) for r in got if r.copied} == {3}  # 100 -> 13 -> 2 -> 1 nodes
    roots = {r.doc_id: r.copied[-1] for r in got if r.copied}
    assert len(set(roots.values())) == 3 and not set(roots.values()) & {r.root for r in got}
