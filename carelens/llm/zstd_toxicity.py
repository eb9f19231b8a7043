"""Toxicity by compression distance under two trained zstandard dictionaries.

A window of words that is toxic compresses shorter with a dictionary trained on
toxic text than with one trained on ordinary text. The ordinary dictionary is
trained on windows of ordinary documents. The toxic one is trained on windows of
toxic documents and stands before the ordinary one, so that ordinary content
costs the same under either and only what is typical of toxic text saves bytes.

A toxic document is ordinary in most of its windows, so the windows to train on
are chosen in rounds, starting from those that the ordinary dictionary compresses
worst. In each round the toxic documents are cut in two parts; the dictionary of
one part measures the windows of the other, and a window stays if its saving is
``contrast`` times as common there as in ordinary documents (a window never
judges itself). Of a trained toxic dictionary the stretches stay that clearly
more toxic than ordinary documents hold (``typical``), as zstandard's training
values what is frequent, whether it is typical or not.

The savings of a document's windows are summed up (largest, mean, shares of
windows from 2 to 6 bytes on) and calibrated to a probability by logistic
regression on training documents that did not go into the dictionaries, classes
weighing the same; of the rounds the one with the smallest loss there is taken.
``threshold`` turns the probability into a decision.

Fitting uses a bounded sample: the first ``train_docs`` labelled documents per
class in the order of a 64-bit hash of the id, ``train_chars`` characters of
each, at every size of the input. Scoring covers every window of every text.

Edge cases: a null or empty text scores like a text without any saving; where
either class has fewer than two documents to learn from every score is 0; too few
windows for zstandard's training are taken as a dictionary as they are; labels
that are null or not 0/1 are ignored, of several labels of one document the
largest counts; rows that repeat a doc_id are scored each for itself, the
smallest of their texts is learned from; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.text import slices

WINDOW = 24
GRAM = 6
_SPLIT = re.compile(rb"[^a-z0-9\x80-\xff]+")


def windows(text: str | None) -> list[bytes]:
    w = [x for x in _SPLIT.split((text or "").lower().encode()) if x]
    return [b" " + b" ".join(w[i:i + WINDOW]) + b" " for i in range(0, max(1, len(w)), WINDOW)]


def train(parts: list[bytes], size: int, segment: int) -> bytes:
    """zstandard's dictionary of these windows; of too few for training, their text."""
    try:
        size = max(1024, min(size, sum(map(len, parts)) // 3))
        return zstandard.train_dictionary(size, parts, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


def _codec(d: bytes):
    p = zstandard.ZstdCompressionParameters.from_level(
        3, min_match=5, strategy=zstandard.STRATEGY_LAZY, write_content_size=False,
        write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
        compression_params=p)


def _lengths(codec, parts: list[bytes]) -> np.ndarray:
    return np.array([len(codec.compress(w)) for w in parts], float)


def _distance(texts: list[list[bytes]], codecs, plain: list | None = None) -> np.ndarray:
    """Features of each text, given as its windows; ``plain``: their lengths under
    the ordinary dictionary, where they are known."""
    toxic, ordinary = codecs
    out = np.zeros((len(texts), 8))
    for r, parts in enumerate(texts):
        d = (_lengths(ordinary, parts) if plain is None else plain[r]) - _lengths(toxic, parts)
        out[r] = (min(d.max(), 12.0), np.clip(d, -4, 12).mean(), *((d >= n).mean() for n in range(2, 7)),
                  np.log1p(len(d)))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-1) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        w = weight * p * (1 - p)
        b += np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(len(b)),
                             x.T @ (weight * (y - p)) - ridge * b)
    return b


def _grams(text: bytes) -> np.ndarray:
    """The six bytes from each position on, as numbers."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    n = max(len(x) - GRAM + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = out << np.uint64(8) | x[i:i + n]
    return out


def _docs_with(grams: np.ndarray, docs: list[list[bytes]]) -> np.ndarray:
    """Number of documents that hold each of the (sorted) grams."""
    out = np.zeros(len(grams), np.int64)
    for parts in docs:
        g = np.unique(_grams(b"".join(parts)))
        at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
        out[at[grams[at] == g]] += 1
    return out


def typical(dictionary: bytes, toxic: list[list[bytes]], plain: list[list[bytes]], ratio: float) -> bytes:
    """The stretches of a trained dictionary that toxic documents hold clearly more often."""
    g = _grams(dictionary)
    if not len(g):
        return b""
    u = np.unique(g)
    a, b = _docs_with(u, toxic), _docs_with(u, plain)
    good = (a >= 3) & ((a - 1.5 * np.sqrt(a)) / max(len(toxic), 1) > ratio * (b + 0.5) / max(len(plain), 1))
    keep = np.zeros(len(dictionary) + 1, bool)
    for i in np.flatnonzero(good[np.searchsorted(u, g)]):
        keep[i:i + GRAM] = True
    edge = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=0))
    return b"\n".join(dict.fromkeys(dictionary[i:j] for i, j in zip(edge[::2], edge[1::2])))


def _pair(part: list[bytes], base: bytes, size: int, segment: int, toxic, plain, ratio: float) -> dict:
    """Both dictionaries; the toxic one is trained on the windows of ``part``."""
    return {"toxic": typical(train(part, size, segment), toxic, plain, ratio) + b"\n" + base, "ordinary": base}


def _calibrated(m: dict, texts, plain, z: np.ndarray) -> tuple[float, dict]:
    """Logistic regression on the distances, classes weighing the same, and its loss."""
    share = z.mean()
    weight = np.where(z == 1, 0.5 / share, 0.5 / (1 - share))
    x = _distance(texts, _codecs(m), plain)
    m = m | {"mean": x.mean(0), "sd": x.std(0) + 1e-9}
    x = (x - m["mean"]) / m["sd"]
    m["beta"] = _logistic(x, z, weight)
    p = 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ m["beta"], -30, 30)))
    return -(weight * np.log(np.where(z == 1, p, 1 - p) + 1e-12)).sum(), m


def _chosen(saved: np.ndarray, usual: np.ndarray, contrast: float) -> np.ndarray:
    """Windows from the least saving on that is ``contrast`` times as common as in ordinary text."""
    for least in range(1, 12):
        if (saved >= least).mean() > contrast * ((usual >= least).mean() + 0.5 / max(len(usual), 1)):
            return saved >= least
    return saved >= 4


def fit_zstd(rows: list[tuple[int, str]], rounds: int = 3, size: int = 4_000, ratio: float = 3.0,
             base_size: int = 60_000, segment: int = 12, contrast: float = 12.0) -> dict | None:
    """Dictionaries and calibration from (label, text) rows. One half of the rows
    makes the dictionaries, the other the calibration."""
    y = np.array([a for a, _ in rows], int)
    half = np.zeros(len(rows), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    if not all(0 < y[x].sum() < x.sum() for x in (half, ~half)):
        return None
    parts = [windows(t) for _, t in rows]
    toxic = [p for p, label, h in zip(parts, y, half) if h and label]
    plain = [p for p, label, h in zip(parts, y, half) if h and not label]
    texts, z = [p for p, h in zip(parts, half) if not h], y[~half]
    base = train([w for p in plain[::2] for w in p], base_size, segment=32)
    usual = [w for p in plain[1::2] for w in p]
    of_part = [[w for p in toxic[i::2] for w in p] for i in (0, 1)]
    codec = _codec(base)
    before, usual_before = [_lengths(codec, part) for part in of_part], _lengths(codec, usual)
    texts_before = [_lengths(codec, p) for p in texts]
    picked = []
    for part, cost in zip(of_part, before):
        cost = cost / np.array([len(w) for w in part])
        picked.append([part[i] for i in np.flatnonzero(cost >= np.median(cost))] if part else [])
    best = None
    for _ in range(rounds):
        m = _pair(picked[0] + picked[1], base, size, segment, toxic, plain, ratio)
        loss, m = _calibrated(m, texts, texts_before, z)
        if best is None or loss < best[0]:
            best = (loss, m)
        now = list(picked)
        for i in (0, 1):  # one part's dictionary measures the other's windows
            part = of_part[1 - i]
            if not picked[i] or not part:
                continue
            codec, _ = _codecs(_pair(picked[i], base, size, segment, toxic[i::2], plain, ratio))
            saved = before[1 - i] - _lengths(codec, part)
            new = [part[j] for j in np.flatnonzero(_chosen(saved, usual_before - _lengths(codec, usual), contrast))]
            if len(new) > 10:
                now[1 - i] = new
        picked = now
    return best[1]


def _scores(m: dict | None, texts: list, codecs) -> np.ndarray:
    if m is None:
        return np.zeros(len(texts))
    x = _distance([windows(t) for t in texts], codecs)
    z = np.column_stack([np.ones(len(x)), (x - m["mean"]) / m["sd"]]) @ m["beta"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _codecs(m: dict | None):
    return (_codec(m["toxic"]), _codec(m["ordinary"])) if m else None


def _fitted(docs: DataFrame, labels: DataFrame, train_docs: int, train_chars: int):
    """The model, broadcast, from the documents whose labels may be learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold != 1))
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    place = F.xxhash64("doc_id", F.lit(9))
    picked = None
    for label in (0, 1):  # the first by hash: the same bound at every size of the labels
        first = known.filter(F.col("toxic") == label).orderBy(place, "doc_id").limit(train_docs)
        picked = first if picked is None else picked.unionByName(first)
    rows = (docs.select("doc_id", F.substring(F.col("text").cast("string"), 1, train_chars).alias("text"))
            .filter(F.col("text").isNotNull()).join(F.broadcast(picked), "doc_id")  # 2 * train_docs rows
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
            .select("toxic", "text", F.xxhash64("doc_id", F.lit(13)).alias("o")).collect())
    model = fit_zstd([(r["toxic"], r["text"]) for r in sorted(rows, key=lambda r: (r["o"], r["text"]))])
    return docs.sparkSession.sparkContext.broadcast(model)


def zstd_toxicity(docs: DataFrame, labels: DataFrame, train_docs: int = 1500, train_chars: int = 20_000,
                  threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; labels of rows
    whose crc32(doc_id) mod 3 is 1 are held out from learning."""
    shared = _fitted(docs, labels, train_docs, train_chars)

    def run(batches):
        codecs = _codecs(shared.value)
        for part in (p for batch in batches for p in slices(batch)):
            score = _scores(shared.value, part.column("text").to_pylist(), codecs)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score),
                 pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_docs: int = 1500, train_chars: int = 20_000,
               threshold: float = 0.7) -> DataFrame:
    """The documents (all columns) that score below the threshold."""
    shared = _fitted(docs, labels, train_docs, train_chars)

    def run(batches):
        codecs = _codecs(shared.value)
        for part in (p for batch in batches for p in slices(batch)):
            score = _scores(shared.value, part.column("text").to_pylist(), codecs)
            yield part.filter(pa.array(score < threshold))
    return docs.mapInArrow(run, docs.schema)
