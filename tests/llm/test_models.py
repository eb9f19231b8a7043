"""Scoring operators: exact parts against plain versions, models on held-out rows."""

import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from carelens.llm.crf_lang import crf_language, fit_crf, share_of, _emissions, _posteriors
from carelens.llm.line_rules import line_rules
from carelens.llm.suffix_tree_lm import suffix_tree_lm
from carelens.llm.text import Words, rolling
from carelens.llm.zstd_toxicity import _codecs, _scores, drop_toxic, fit_zstd, windows, zstd_toxicity
from tests.llm import brute


def held(doc, m, r):
    return crc32(str(doc).encode()) % m == r


def test_words_and_rolling():
    import pyarrow as pa
    texts = ["a bb  a bb", None, "", "\x0bé\n" + "q" * 100, "bb a"]
    w = Words(pa.array(texts))
    assert w.n.tolist() == [4, 0, 0, 2, 2]
    h = w.hashes()
    assert h[0] == h[2] == h[7] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 4
    for k in (1, 2, 3, 7):
        r = rolling(h, k)
        assert len(r) == 8 - k + 1
        same = {tuple(h[i:i + k].tolist()) for i in range(len(r))}
        assert len(set(r.tolist())) == len(same)


def test_language_model_base(make, corpus):
    rows = corpus + [(None, "ban cor")]
    got = {r.doc_id: r for r in suffix_tree_lm(make(rows)).collect()}
    count = Counter()
    for d, t in rows:
        if d is None or not held(d, 10, 0):
            count.update(brute.lower(t))
            count[None] += 1
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for d, t in rows:
        tokens = brute.lower(t) + [None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
        assert r.held_out == (d is not None and held(d, 10, 0))
    assert suffix_tree_lm(make([])).count() == 0


def test_language_model_beats_base_on_held_out(spark, sf):
    rows = suffix_tree_lm(spark.read.parquet(f"{sf}/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_language_model_uses_contexts(make):
    phrase = " ".join(f"w{i}" for i in range(40))
    rows = [(i, phrase) for i in range(1, 40)] + [(1000 + i, f"v{i} u{i} t{i}") for i in range(3000)]
    got = {r.doc_id: r for r in suffix_tree_lm(make(rows), rare=0.02).collect()}
    seen = next(got[i] for i in range(1, 40) if held(i, 10, 0))
    assert seen.score / seen.n_tokens > -0.2 > seen.base_score / seen.n_tokens


def test_language_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = crf_language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_language_odd_rows(make, corpus):
    got = {r.doc_id: r for r in crf_language(make(corpus + [(None, "ban"), (9998, "12 ! 34")])).collect()}
    texts = dict(corpus)
    for d, r in got.items():
        und = d == 9998 or (d in texts and not any(c.isalpha() for c in texts[d] or ""))
        assert (r.lang_pred == "und") == und
    assert crf_language(make([])).count() == 0
    assert {r.lang_pred for r in crf_language(make([(2, "a b"), (4, "c")])).collect()} == {"und"}  # no lang known


def test_language_sample_holds_at_any_size():
    for count in (1_000_000, 2_000_000_000, 50_000_000_000):
        assert abs(share_of(count, 1500) / 2**63 * count - 1500) < 0.01
    assert share_of(1500, 1500) == share_of(1, 1500) == 2**63 - 1


def test_language_takes_any_id_and_repeated_rows(spark):
    rows = [(f"d{i}", "ab ba abba ab" if i % 2 else "xy yx xyxy yx", "a" if i % 2 else "b") for i in range(60)]
    got = crf_language(spark.createDataFrame(rows + rows[:1] * 50, "doc_id string, text string, lang string")).collect()
    want = {d: lang for d, _, lang in rows}
    assert len(got) == 110 and all(r.lang_pred == want[r.doc_id] for r in got)


def test_posteriors_match_plain_forward_backward():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    n = np.array([700, 0, 3, 256, 1])
    first = np.cumsum(n) - n
    e = rng.normal(size=(n.sum(), 3)).astype(np.float32)
    move = rng.normal(size=(3, 3)).astype(np.float32)
    got = _posteriors(e, first, n, move)
    for r, (f, k) in enumerate(zip(first, n)):
        alpha, beta, a = np.zeros((k, 3)), np.ones((k, 3)), np.exp(move.astype(float))
        x = np.exp(e[f:f + k].astype(float))
        v = np.full(3, 1 / 3)
        for t in range(k):
            v = (v @ a) * x[t]
            v /= v.sum()
            alpha[t] = v
        for t in range(k - 2, -1, -1):
            beta[t] = a @ (x[t + 1] * beta[t + 1])
            beta[t] /= beta[t].sum()
        p = alpha * beta
        want = (p / p.sum(1, keepdims=True)).sum(0) if k else np.zeros(3)
        assert np.allclose(got[r], want, rtol=1e-3, atol=1e-3)
    model = fit_crf([("a", "ab ab ba"), ("b", "xy yx xx")] * 10, ["a", "b"])
    w = Words(pa.array(["ab xy ab"]))
    assert _emissions(w, model).argmax(1).tolist() == [0, 1, 0]


@pytest.fixture(scope="session")
def toxic_rows(corpus):
    plain = [t for _, t in corpus if t and 10 < len(t.split()) < 400]
    rows = []
    for i in range(300):
        t = plain[i % len(plain)].split()
        bad = i % 3 == 0
        if bad:
            for j in range(3, len(t), 12):
                t[j] = ("nastyword", "vileterm", "foulthing")[(i + j) % 3]
        rows.append((i + 1, " ".join(t), int(bad)))
    return rows


def test_toxicity(spark, make, toxic_rows):
    docs = make([(d, t) for d, t, _ in toxic_rows] + [(900, None), (901, ""), (None, "ban")])
    labels = spark.createDataFrame([(d, 1, y) for d, _, y in toxic_rows] + [(900, 1, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in zstd_toxicity(docs, labels).collect()}
    truth = {d: y for d, _, y in toxic_rows}
    out = [d for d in truth if held(d, 3, 1)]
    assert len(got) == len(toxic_rows) + 3 and all(got[d].held_out for d in out)
    assert np.mean([got[d].predicted == truth[d] for d in out]) > 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    stay = drop_toxic(docs, labels)
    assert stay.columns == docs.columns
    assert {r.doc_id for r in stay.collect()} == {d for d, r in got.items() if not r.predicted}
    assert {r.score for r in zstd_toxicity(docs, labels.filter("toxic = 0")).collect()} == {0.0}
    assert zstd_toxicity(make([]), labels).count() == 0


def test_toxic_dictionary_is_trained_on_toxic_text(toxic_rows):
    m = fit_zstd([(y, t) for _, t, y in toxic_rows])
    bad = {w[i:i + 6] for w in (b"nastyword", b"vileterm", b"foulthing") for i in range(len(w) - 5)}
    assert m["toxic"].endswith(m["ordinary"])
    own = m["toxic"][:-len(m["ordinary"])]
    assert any(x in own for x in bad) and not any(x in m["ordinary"] for x in bad)


def test_toxicity_score_is_the_plain_one(toxic_rows):
    import zstandard
    m = fit_zstd([(y, t) for _, t, y in toxic_rows])
    p = zstandard.ZstdCompressionParameters.from_level(3, min_match=5, strategy=zstandard.STRATEGY_LAZY,
                                                       write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(dictionary, window):
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=raw, compression_params=p).compress(window))
    texts = [t for _, t, _ in toxic_rows[:12]] + ["", None]
    for text, got in zip(texts, _scores(m, texts, _codecs(m))):
        d = [size(m["ordinary"], w) - size(m["toxic"], w) for w in windows(text)]
        x = [min(max(d), 12), sum(min(max(v, -4), 12) for v in d) / len(d),
             *(sum(v >= n for v in d) / len(d) for n in range(2, 7)), math.log(1 + len(d))]
        z = m["beta"][0] + sum(b * (v - mu) / sd for b, v, mu, sd in zip(m["beta"][1:], x, m["mean"], m["sd"]))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_learns_from_few_and_repeated_rows(spark, make):
    rows = [(i, f"plain words number {i} and more of them") for i in range(1, 40)] + [(1, "plain words again")] * 50
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1, 40)], "doc_id long, toxic int")
    got = zstd_toxicity(make(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_line_rules(make, corpus):
    junk = [(5001, "a# b$ c% d& e* f# g$ h% i& j* k#"), (5002, "Home | About | Contact | Help | News | Map"),
            (5003, "A fine line of prose that says a thing, and ends well.\n" + "HOME! BUY! NOW! " * 20),
            (5004, "A fine line of prose that says some more things here, and ends well.\nWe use cookies.")]
    rows = corpus + junk + [corpus[0], (None, None)]
    got = line_rules(make(rows)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = brute.base_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    kept = {r.doc_id: r for r in got}
    assert [kept[i].kept for i in (5001, 5002, 5003, 5004)] == [False, False, False, True]
    assert kept[5004].n_lines_removed == 1 and kept[5004].text.endswith("ends well.")
    assert line_rules(make([])).count() == 0
