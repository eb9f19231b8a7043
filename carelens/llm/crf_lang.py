"""Language of code-switched text by a linear-chain conditional random field.

Every word gets a distribution over languages by forward-backward; a document
gets the language with the largest mean share and that share as its score.

Features of a word are the 2- to 4-byte n-grams of its lower-cased bytes between
boundary marks (those that hold a mark are its affixes) and, if it is in the
lexicon, the word itself, all hashed into a weight table of fixed size.
Transition weights between languages are learned with them. The classifier is
fitted on a bounded, hash-chosen sample (``train_segments`` per language, each
``segment_chars`` long; a document's language is taken as its words' label, and
segments are strung together in pairs so that switches are seen). Prediction
covers every word of every text; long texts are cut into blocks whose transfer
matrices are multiplied up, which is exact, so memory is bounded by a slice.

Edge cases: a null text, or one without any letter, gives ``und`` with score 0;
with no learnable row every text gives ``und``; ties go to the language first in
order; rows that repeat a doc_id are judged each for itself and learned from once per language; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.text import Words, mix, slices

BITS = 18
BLOCK = 256
ORDERS = (2, 3, 4)


def _features(w: Words, at: np.ndarray):
    """(feature index, word number) pairs of the words at the given indices."""
    n = w.end[at] - w.start[at]
    size = n + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(at)), size)
    buf = np.empty(int(size.sum()), np.uint64)
    inner = np.arange(len(buf)) - first[word]
    body = (inner > 0) & (inner <= n[word])
    buf[body] = w.raw[(w.start[at][word] + inner - 1)[body]]
    buf[first], buf[first + size - 1] = 2, 3
    idx, owner = [], []
    for k in ORDERS:
        m = len(buf) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + buf[j:j + m]
        ok = inner[:m] + k <= size[word[:m]]
        idx.append(mix(h[ok]) >> np.uint64(64 - BITS))
        owner.append(word[:m][ok])
    return np.concatenate(idx).astype(np.int64), np.concatenate(owner)


def _emissions(w: Words, model: dict) -> np.ndarray:
    """Score of every word for every language (distinct words are scored once)."""
    h = w.hashes(41)
    u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    idx, owner = _features(w, at)
    out = np.zeros((len(u), model["weights"].shape[1]), np.float32)
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(owner, model["weights"][idx, k], len(u))
    lex = model["lexicon"]
    if len(lex):
        p = np.minimum(np.searchsorted(lex, u), len(lex) - 1)
        known = lex[p] == u
        out[known] += model["lexicon_weights"][p[known]]
    return out[inverse]


def _posteriors(e: np.ndarray, first: np.ndarray, n: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Sum over each row's words of the posterior language shares."""
    k = e.shape[1]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    a = np.exp(move - move.max())
    rows = np.flatnonzero(n > 0)
    blocks = (n[rows] + BLOCK - 1) // BLOCK
    owner = np.repeat(np.arange(len(rows)), blocks)
    number = np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]
    start = first[rows][owner] + number * BLOCK
    length = np.minimum(BLOCK, n[rows][owner] - number * BLOCK)
    order = np.argsort(-length, kind="stable")
    owner, number, start, length = owner[order], number[order], start[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
    steps = int(length[0]) if len(length) else 0
    forward = np.empty((len(e), k, k), np.float32)
    f = np.broadcast_to(np.eye(k, dtype=np.float32), (len(owner), k, k))
    transfer = np.empty((len(owner), k, k), np.float32)
    for t in range(steps):
        c = active[t]
        f = (f[:c].reshape(-1, k) @ a).reshape(c, k, k) * e[start[:c] + t][:, None, :]
        f /= f.max(axis=(1, 2), keepdims=True)
        forward[start[:c] + t] = f
        transfer[:c] = f
    into = np.full((len(owner), k), 1 / k, np.float32)
    after = np.ones((len(owner), k), np.float32)
    by = np.lexsort((number, owner))
    head = np.searchsorted(owner[by], np.arange(len(rows)))
    most = int(blocks.max()) if len(blocks) else 0
    for j in range(1, most):
        r = np.flatnonzero(blocks > j)
        here, before = by[head[r] + j], by[head[r] + j - 1]
        v = np.einsum("nk,nkl->nl", into[before], transfer[before])
        into[here] = v / v.max(axis=1, keepdims=True)
    for j in range(most - 2, -1, -1):
        r = np.flatnonzero(blocks > j + 1)
        here, later = by[head[r] + j], by[head[r] + j + 1]
        v = np.einsum("nkl,nl->nk", transfer[later], after[later])
        after[here] = v / v.max(axis=1, keepdims=True)
    total = np.zeros((len(owner), k))
    g = after.copy()
    for t in range(steps - 1, -1, -1):
        c = active[t]
        p = np.einsum("nk,nkl->nl", into[:c], forward[start[:c] + t]) * g[:c]
        total[:c] += p / p.sum(axis=1, keepdims=True)
        g[:c] = (e[start[:c] + t] * g[:c]) @ a.T
        g[:c] /= g[:c].max(axis=1, keepdims=True)
    out = np.zeros((len(n), k))
    np.add.at(out, rows[owner], total)
    return out


def fit_crf(segments: list[tuple[str, str]], langs: list[str], epochs: int = 6, steps: int = 150,
            rate: float = 0.3, decay: float = 1e-4, batch: int = 48, min_lexicon: int = 3) -> dict:
    """Fit weights and transitions on (language, segment) pairs by AdaGrad on the
    CRF's log-likelihood, ``epochs`` times over them and at least so many steps.
    The segments are a bounded sample."""
    k = len(langs)
    rng = np.random.default_rng(7)
    label = np.array([langs.index(x) for x, _ in segments])
    w = Words(pc.utf8_lower(pa.array([t for _, t in segments], pa.large_string())))
    h = w.hashes(41)
    u, at, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    idx, owner = _features(w, at)
    feat_first = np.searchsorted(owner, np.arange(len(u) + 1))
    lexical = np.flatnonzero(count >= min_lexicon)
    weights, lex = np.zeros((1 << BITS, k)), np.zeros((len(u), k))
    move = np.zeros((k, k))
    g_w, g_l, g_m = np.full(weights.shape, 1e-6), np.full(lex.shape, 1e-6), np.full(move.shape, 1e-6)
    in_lex = np.zeros(len(u), bool)
    in_lex[lexical] = True
    for _ in range(max(epochs, -(-steps * 2 * batch // max(len(label), 1)))):
        perm = rng.permutation(len(label))
        for lo in range(0, len(perm) - 1, 2 * batch):
            pick = perm[lo:lo + 2 * batch]
            pick = pick[:len(pick) // 2 * 2].reshape(-1, 2)
            n = w.n[pick].sum(axis=1)
            t_max = int(n.max()) if len(n) else 0
            if not t_max:
                continue
            tok = np.zeros((len(pick), t_max), np.int64)
            gold = np.full((len(pick), t_max), -1)
            for r, (p, q) in enumerate(pick):
                tok[r, :n[r]] = np.concatenate([inverse[w.first[p]:w.first[p] + w.n[p]],
                                                inverse[w.first[q]:w.first[q] + w.n[q]]])
                gold[r, :w.n[p]], gold[r, w.n[p]:n[r]] = label[p], label[q]
            words = np.unique(tok[gold >= 0])
            spans = [np.arange(feat_first[x], feat_first[x + 1]) for x in words]
            f = idx[np.concatenate(spans)]
            fo = np.repeat(np.arange(len(words)), [len(s) for s in spans])
            em = np.stack([np.bincount(fo, weights[f, c], len(words)) for c in range(k)], 1)
            em += lex[words] * in_lex[words][:, None]
            e = np.exp(np.clip(em, -30, 30))[np.searchsorted(words, tok)]
            a = np.exp(move)
            on = gold >= 0
            alpha, scale = np.ones((len(pick), t_max, k)), None
            v = np.full((len(pick), k), 1 / k)
            for t in range(t_max):
                v = (v @ a) * e[:, t]
                v /= v.sum(1, keepdims=True)
                alpha[:, t] = v
            beta = np.ones((len(pick), k))
            post = np.zeros_like(alpha)
            grad_m = np.zeros((k, k))
            last = np.arange(t_max)[None, :] == (n - 1)[:, None]
            for t in range(t_max - 1, -1, -1):
                beta = np.where(last[:, t][:, None], 1.0, beta)
                p = alpha[:, t] * beta
                post[:, t] = p / p.sum(1, keepdims=True)
                step = e[:, t] * beta
                if t:
                    pair = alpha[:, t - 1][:, :, None] * a[None] * step[:, None, :]
                    pair /= pair.sum((1, 2), keepdims=True)
                    grad_m -= (pair * on[:, t][:, None, None]).sum(0)
                beta = step @ a.T
                beta /= beta.max(1, keepdims=True)
            both = on[:, 1:]
            np.add.at(grad_m, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            diff = (np.eye(k)[np.maximum(gold, 0)] - post)[on]
            where = np.searchsorted(words, tok[on])
            dword = np.stack([np.bincount(where, diff[:, c], len(words)) for c in range(k)], 1) / len(pick)
            for c in range(k):
                grad = np.bincount(f, dword[fo, c], 1 << BITS)
                hot = np.flatnonzero(grad)
                g_w[hot, c] += grad[hot] ** 2
                weights[hot, c] += rate * (grad[hot] / np.sqrt(g_w[hot, c]) - decay * weights[hot, c])
            g_l[words] += dword ** 2
            lex[words] += rate * (dword / np.sqrt(g_l[words]) - decay * lex[words])
            grad_m /= len(pick)
            g_m += grad_m ** 2
            move += rate * grad_m / np.sqrt(g_m)
    keep = lexical[np.argsort(u[lexical])]
    return {"langs": langs, "weights": weights.astype(np.float32), "move": move.astype(np.float32),
            "lexicon": u[keep], "lexicon_weights": lex[keep].astype(np.float32)}


def _predict(model):
    def run(batches):
        m = model.value
        names = np.array([*m["langs"], "und"], object)
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                if text.null_count:
                    text = pc.fill_null(text, "")
                letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                pick = np.full(len(text), len(m["langs"]))
                score = np.zeros(len(text))
                w = Words(pc.utf8_lower(text))
                if m["langs"] and len(w.start):
                    share = _posteriors(_emissions(w, m), w.first, w.n, m["move"])
                    share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
                    pick = np.where(letters, share.argmax(1), len(m["langs"]))
                    score = np.where(letters, np.clip(share.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[pick], pa.string()),
                     pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def share_of(count: int, wanted: int) -> int:
    """Largest of the 63-bit hashes so that about ``wanted`` of ``count`` rows are not above it."""
    return (1 << 63) - 1 if count <= wanted else (wanted << 63) // count


def crf_language(docs: DataFrame, train_segments: int = 1500, segment_chars: int = 300) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; rows whose
    crc32(doc_id) mod 4 is 2 are held out from learning."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    docs = docs.withColumn("held_out", F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    learn = docs.filter(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    model = {"langs": []}
    if langs:
        place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 1)
        share = F.create_map(*[F.lit(x) for c in langs for x in (c, share_of(counts[c], train_segments))])
        at = 1 + F.pmod(F.xxhash64("doc_id", F.lit(5)),
                        F.greatest(F.char_length("text") - segment_chars, F.lit(1)).cast("long"))
        rows = (learn.filter(place <= share[F.col("lang")].cast("long"))
                .select("lang", "doc_id", F.substring("text", at.cast("int"), F.lit(segment_chars)).alias("t"))
                .groupBy("lang", "doc_id").agg(F.min("t").alias("t")).collect())  # a repeated id counts once
        model = fit_crf(sorted((r["lang"], r["t"]) for r in rows), langs)
    return (docs.select("doc_id", "held_out", "text")
            .mapInArrow(_predict(spark.sparkContext.broadcast(model)),
                        f"doc_id {kind}, held_out boolean, lang_pred string, score double"))
