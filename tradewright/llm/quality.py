"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words, their character 3- to 5-grams and its word pairs, all hashed into one table;
a softmax layer on that average gives the label. Table and layer are trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import held_out, labelled_sample, per_row, slices

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
PAIR = np.uint64(0x9E3779B97F4A7C15)  # an odd 64-bit multiplier


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * PAIR
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word position, bucket) of every word itself and of the character n-grams of `<word>`."""
    marked = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    own = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)
    parts = [(np.arange(len(words)), _mix(own))]
    for n in GRAMS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for j in range(n):
                h = h * np.uint64(1000003) + codes[j:len(codes) - n + 1 + j]
            inside = owner[: len(h)] == owner[n - 1:]
            parts.append((owner[: len(h)][inside], _mix(h[inside])))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def tokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, the texts' words as positions among them, and the number of words per text."""
    seen: dict[str, int] = {}
    flat: list[int] = []
    sizes = []
    for text in texts:
        split = text.split()
        flat.extend([seen.setdefault(w, len(seen)) for w in split])
        sizes.append(len(split))
    return list(seen), np.array(flat, np.int64), np.array(sizes, np.int64)


def pair_features(words: list[str], flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each pair of neighbouring words. All pairs of a word with itself share one bucket."""
    own = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64) if words else np.zeros(0, np.uint64)
    same = owner[:-1] == owner[1:]
    a, b = flat[:-1][same], flat[1:][same]
    return owner[:-1][same], np.where(a == b, 0, _mix(own[a] * PAIR + own[b] + np.uint64(1)))


def featurise(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of all its features."""
    words, flat, sizes = tokens(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at, bucket = word_features(words)
    order = np.argsort(at, kind="stable")
    bucket, ends = bucket[order], np.searchsorted(at[order], np.arange(len(words) + 1))
    pair_at, pair_bucket = pair_features(words, flat, owner)
    word_ends, pair_ends = np.concatenate([[0], np.cumsum(sizes)]), np.searchsorted(pair_at, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        ids, counts = np.unique(flat[word_ends[i]:word_ends[i + 1]], return_counts=True)
        own = [bucket[ends[w]:ends[w + 1]] for w in ids]
        every = np.concatenate([*own, pair_bucket[pair_ends[i]:pair_ends[i + 1]]]) if len(ids) else np.zeros(0, np.int64)
        weight = np.concatenate([np.repeat(counts, [len(x) for x in own]), np.ones(pair_ends[i + 1] - pair_ends[i])]) if len(ids) else np.zeros(0)
        distinct, back = np.unique(every, return_inverse=True)
        share = np.bincount(back, weight, len(distinct))
        yield distinct, share / max(1.0, share.sum())


def train(texts: list[str], labels: np.ndarray, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """The score of each bucket (its vector times the layer's weights for label 1 less those for 0) and the layer's bias.

    The layer is linear in the average, so a document's logit is the average of its buckets' scores plus the bias.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / width, 1 / width, (BUCKETS, width)).astype(np.float32)
    layer, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    rows = [r for piece in slices([len(t) for t in texts], 1 << 20) for r in featurise(texts[piece])]
    rows = [(i.astype(np.int32), w.astype(np.float32)) for i, w in rows]
    step, steps = 0, epochs * max(1, len(rows))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, share = rows[k]
            speed, step = rate * (1 - step / steps), step + 1
            vectors = table[ids]
            average = share @ vectors
            logits = average @ layer + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[labels[k]] -= 1
            back = layer @ error
            layer -= speed * np.outer(average, error)
            bias -= 0.02 * speed * error
            # the average's gradient, spread over the buckets by share; scaled so that long texts move their buckets too
            table[ids] = vectors - speed * np.sqrt(share)[:, None] * back
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scorer(weights: np.ndarray, bias: float):
    def score(raw: list[bytes]) -> dict[str, np.ndarray]:
        out = np.empty(len(raw))
        for piece in slices([len(x) for x in raw], 1 << 22):
            texts = [x.decode("utf-8", "replace") for x in raw[piece]]
            words, flat, sizes = tokens(texts)
            owner, n = np.repeat(np.arange(len(texts)), sizes), len(texts)
            at, bucket = word_features(words)
            value, many = np.bincount(at, weights[bucket], len(words)), np.bincount(at, minlength=len(words))
            pair_at, pair_bucket = pair_features(words, flat, owner)
            total = np.bincount(owner, value[flat], n) + np.bincount(pair_at, weights[pair_bucket], n)
            count = np.bincount(owner, many[flat], n) + np.bincount(pair_at, minlength=n)
            out[piece] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -700, 700)))
        return {"score": out}

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> DataFrame:
    """doc_id, held_out, score (likelihood of quality 1) and predicted (score >= 0.5) for every row of docs.

    Learns from at most sample / 2 rows of either label that are not held out, chosen by a hash of their id over all labels; only texts are
    inputs.
    Whole texts are scored; NULL and empty texts, and texts of white space, get the layer's bias alone. With no usable label every score
    is 0.5. NULL ids and repeated rows are scored as they come; other columns are ignored.
    """
    rows = labelled_sample(docs, labels, "quality", sample).select("text", "y").toArrow()
    model = train(rows.column("text").to_pylist(), rows.column("y").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = per_row(docs.select("doc_id", "text"), "text", lambda: scorer(*shared.value), {"score": pa.float64()}, "score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
