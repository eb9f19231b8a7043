"""Duplicate operators against plain versions, and their odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from carelens.llm.bag_minhash import bag_minhash, drop_near_duplicates, near_duplicates
from carelens.llm.components import components
from carelens.llm.cover_dedup import COVER, PERIOD, cover_dedup
from carelens.llm.decontaminate import contained_items, decontaminate
from carelens.llm.fuzzy_lines import dedup_lines
from carelens.llm.sparse_suffixes import repeated_passages
from tests.llm import brute


def odd(rows):
    """The corpus with a repeated row, a row without doc_id and a copy of it."""
    return rows + [rows[5], (None, rows[6][1]), (None, None)]


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_cover_dedup(make, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.text) for r in cover_dedup(make(corpus)).collect()}
    want = brute.windows_removed(corpus)
    assert {k: v[:3] for k, v in got.items()} == want
    assert sum(v[1] for v in want.values()) > 300
    texts = dict(corpus)
    assert all(got[d][3] == " ".join(texts[d].split()) for d, v in want.items() if not v[1] and texts[d] and "\x0b" not in texts[d])


def test_cover_dedup_odd_rows(make, corpus):
    got = cover_dedup(make(odd(corpus))).collect()
    want = brute.windows_removed(corpus)
    assert len(got) == len(corpus) + 3
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
    assert cover_dedup(make([])).count() == 0


def test_repeated_passages(make, corpus):
    got = repeated_passages(make(odd(corpus))).collect()
    texts = {d: brute.words(t) for d, t in corpus}
    cover = {}
    for r in got:
        a = texts[r.doc_id][r.start:r.start + r.n_words]
        assert a == texts[r.src_doc_id][r.src_start:r.src_start + r.n_words] and r.src_doc_id < r.doc_id
        assert len(a) == r.n_words >= 50
        cover.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    want = {d: v[1] for d, v in brute.windows_removed(corpus).items() if v[1]}
    assert {d: len(v) for d, v in cover.items()} == want
    assert repeated_passages(make([])).count() == 0


def test_near_duplicates(make, corpus):
    got = {r.doc_id: r.class_id for r in near_duplicates(make(corpus)).collect()}
    assert got == brute.near_classes(corpus)
    assert len(set(got.values())) < len(got)


def test_near_duplicates_odd_rows(make, corpus):
    docs = make(odd(corpus))
    got = near_duplicates(docs)
    assert got.count() == len(corpus) + 3 and got.filter("doc_id IS NULL AND class_id IS NULL").count() == 2
    stay = drop_near_duplicates(docs)
    assert stay.columns == docs.columns
    assert sorted(r.doc_id for r in stay.filter("doc_id IS NOT NULL").collect()) == sorted(
        set(brute.near_classes(corpus).values()))
    assert near_duplicates(make([])).count() == 0


def test_signatures_estimate_weighted_jaccard():
    import numpy as np
    key = np.arange(300, dtype=np.uint64)
    a, b = np.full(300, 6), np.full(300, 3)
    row = np.repeat([0, 1], 300)
    sig = bag_minhash(row, np.concatenate([key, key]), np.concatenate([a, b]), 2, 2048)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05
    assert np.isfinite(sig).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (7, 7), (100, 50), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fuzzy_lines(make, corpus):
    docs = make(corpus)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    want = brute.lines_removed(corpus)
    texts = dict(corpus)
    assert len(got) == len(corpus) and want
    for d, r in got.items():
        gone = want.get(d, [])
        assert r.n_removed == len(gone)
        left = None if texts[d] is None else "\n".join(x for i, x in enumerate(texts[d].split("\n")) if i not in gone)
        assert r.text == left


def test_fuzzy_lines_odd_rows(make, corpus):
    got = dedup_lines(make(odd(corpus)))
    assert got.count() == len(corpus) + 3
    assert got.filter("doc_id IS NULL AND n_removed > 0").count() == 0
    assert dedup_lines(make([])).count() == 0


@pytest.fixture(scope="session")
def items(spark, corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 40]
    rows = [(i, " ".join(t.split()[7:7 + 12 * (i + 1)]).upper()) for i, t in enumerate(texts[:8])]
    rows += [(90, "one more"), (91, ""), (92, None), (93, "not in any of them at all, really"), (94, rows[0][1])]
    return rows


def test_contained_items(spark, make, corpus, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contained(corpus, items)
    for block in (20_000, 3):
        got = {(r.item_id, r.doc_id): r.containment for r in contained_items(make(corpus), bench, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert want
    docs = make(odd(corpus))
    kept = decontaminate(docs, bench, block=3)
    assert kept.schema.names == docs.schema.names
    left = {r.doc_id for r in kept.collect()}
    assert left - {None} == {d for d, _ in corpus} - {d for _, d in want}
    assert contained_items(make([]), bench).count() == 0
    assert contained_items(docs, bench.filter(F.lit(False))).count() == 0


def test_lines_beyond_ascii_with_clashing_names(spark):
    rng = random.Random(1)
    letters = "abcdefghij äöüéß日本語テスト𝒳"
    base = ["".join(rng.choice(letters) for _ in range(60)) for _ in range(30)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(6):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                x[rng.randrange(60)] = rng.choice(letters)
            lines.append("".join(x))
        rows.append((i + 1, "\n".join(lines)))
    want = brute.lines_removed(rows)
    assert sum(map(len, want.values())) > 50
    docs = spark.createDataFrame([(d, t, 5, "x", 7) for d, t in rows], "doc_id long, text string, n_lines int, removed string, __id long")
    got = dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "removed", "__id", "n_lines", "n_removed"]
    texts = dict(rows)
    for r in got.collect():
        gone = want.get(r.doc_id, [])
        assert r.text == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in gone)
        assert (r.n_lines, r.n_removed, r.removed) == (6, len(gone), "x")


def test_very_long_text_of_repeated_lines(spark):
    text = "\n".join(f"line {i % 977} of a text" for i in range(80_000))
    (r,) = dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_lines, r.n_lines - r.n_removed) == (80_000, len(r.text.split("\n"))) and r.n_removed >= 79_023


def test_components_of_stars_are_written_once(spark, monkeypatch):
    import carelens.llm.components as module
    tables = []
    monkeypatch.setattr(module, "stored", lambda df: tables.append(df) or df)
    got = {r.node: r.root for r in components(spark.createDataFrame([(5, 1), (1, 6), (9, 8)], "u long, v long")).collect()}
    assert got == {5: 1, 6: 1, 1: 1, 9: 8, 8: 8} and len(tables) == 1


def test_prefix_groups_have_a_row_per_shared_element(spark):
    from carelens.llm.components import prefix_groups
    sets = {n: [*range(100), 1000 + n] for n in range(4)}
    rows = [(n, len(s), t) for n, s in sets.items() for t in s]
    got = prefix_groups(spark.createDataFrame(rows, "node long, size long, token long"), 0.8).collect()
    # place 0 is the element of its own, places 1 to 20 are the only ones that can be the first in common
    assert sorted((r.node, r.place) for r in got) == [(n, p) for n in range(4) for p in range(1, 21)]


def test_lines_of_compared_buckets_are_not_placed_anew(make, monkeypatch):
    import carelens.llm.fuzzy_lines as module
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = []
    for i in range(40):  # three lines with most shingles in common, but fewer than it takes
        common = " ".join(word() for _ in range(20))
        rows += [(3 * i + j, f"{common} {word()} {word()} {word()}") for j in range(3)]
    placed = []
    whole = module.prefix_groups
    monkeypatch.setattr(module, "prefix_groups", lambda tokens, *rest: placed.append(tokens.count()) or whole(tokens, *rest))
    got = dedup_lines(make(rows)).collect()
    assert placed == [0]
    assert sorted(r.doc_id for r in got if r.n_removed) == sorted(brute.lines_removed(rows))


def test_short_lines_share_a_band(make):
    # sets of 4 to 6 shingles that differ in one of them, and long lines of few different shingles
    rows = [(i, "abcdefghijklm"[:11 + i % 3] + ("" if i < 3 else "\n" + "ab" * (40 + i))) for i in range(9)]
    rows += [(20, "qrstuvwxyzab"), (21, "xqrstuvwxyzab"), (22, "qrstuvwxyza"), (23, "z" * 300), (24, "z" * 301)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(make(rows)).collect()}
    assert got == {d: len(brute.lines_removed(rows).get(d, [])) for d, _ in rows}


def test_pairs_of_small_buckets_are_compared_without_tokens(make, monkeypatch):
    import carelens.llm.fuzzy_lines as module
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = []
    for i in range(20):  # six lines with most shingles in common, of which the last two are near
        common, near = " ".join(word() for _ in range(20)), f"{word()} {word()} {word()}"
        rows += [(6 * i + j, f"{common} " + (near + "x" * j if j > 3 else f"{word()} {word()} {word()}")) for j in range(6)]
    placed = []
    whole = module.prefix_groups
    monkeypatch.setattr(module, "prefix_groups", lambda tokens, *rest: placed.append(tokens.count()) or whole(tokens, *rest))
    want = brute.lines_removed(rows)
    assert len(want) == 20
    assert sorted(r.doc_id for r in dedup_lines(make(rows)).collect() if r.n_removed) == sorted(want)
    assert placed == [0]
    lines = module._lines(make(rows)).groupBy("a").agg(F.first("form").alias("form"))
    for small in (0, 64):  # whichever way they are compared
        assert module.line_groups(lines, small=small).count() == 40
    assert placed[0] == 0 < placed[1] and placed[2] == 0
