"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal.

Every coordinate has its own learning rate; the L1 term keeps coordinates at zero until the evidence for them outweighs it, so the
model is a short list of (bucket, weight) that can be broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import held_out, labelled_sample, per_row, sweep, whole_row

BITS = 22
WORD = re.compile(r"\w+")
ODD = np.uint64(0x9E3779B97F4A7C15)  # an odd 64-bit multiplier
# offsets of the words of a feature: words, pairs, triples, and pairs that skip one or two words
SHAPES = ((0,), (0, 1), (0, 1, 2), (0, 2), (0, 3))


class Hasher:
    """Buckets of a text's features; remembers the hashes of a bounded number of words."""

    def __init__(self, remembered: int = 300_000):
        self.known: dict[str, int] = {}
        self.most = remembered

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.known
        if len(known) > self.most:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        h = np.array([known[w] for w in words], np.uint64)
        parts = []
        for kind, shape in enumerate(SHAPES):
            n = len(h) - shape[-1]
            if n > 0:
                x = np.full(n, kind + 1, np.uint64)
                for at in shape:
                    x = (x ^ h[at:at + n]) * ODD
                    x ^= x >> np.uint64(29)
                parts.append(x >> np.uint64(64 - BITS))
        return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def train(rows: list[np.ndarray] | Unpacked, labels: np.ndarray, epochs: int = 4, alpha: float = 3.0, beta: float = 1.0, l1: float = 0.001, l2: float = 0.0,
          rare: int = 3, seed: int = 9) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets, weights, bias) of the non-zero weights; a feature's value is 1 if the text has it. The bias is not pulled to zero.

    l1 is the penalty per training text, and at least 1 in all. Buckets that fewer than `rare` of the training texts have are left out.
    """
    l1 = max(1.0, l1 * len(rows))
    texts = np.zeros(1 << BITS, np.int32)
    for ids in rows:
        texts[ids] += 1
    kept = np.flatnonzero(texts >= rare)  # only these take memory while learning
    texts[kept] = np.arange(rare, len(kept) + rare, dtype=np.int32)
    rows = [found[found >= rare] - rare for found in (texts[ids] for ids in rows)]
    del texts
    z, n = np.zeros(len(kept), np.float32), np.zeros(len(kept), np.float32)
    bias_z = bias_n = 0.0
    rng = np.random.default_rng(seed)

    def weight(zi, ni):
        return np.where(np.abs(zi) <= l1, 0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids = rows[k]
            zi, ni = z[ids], n[ids]
            w = weight(zi, ni)
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            more = ni + g * g
            z[ids] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[ids] = more
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return kept[at], w[at].astype(np.float32), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000):
    """Learns from at most sample / 2 rows of either label that are not held out, chosen by a hash of their id over all labels.

    The tasks hash the texts; the driver gets each text's sorted buckets, as compressed differences.
    """
    chosen = labelled_sample(docs, labels, "toxic", sample).select("text", "y")
    rows = chosen.mapInArrow(hashed, "buckets binary, y int").toArrow()
    labelled, packed = rows.column("y").to_numpy(), rows.column("buckets")
    del rows
    model = train(Unpacked(packed), labelled)
    del packed
    sweep(docs.sparkSession)
    return model


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(buckets, y) of rows (text, y)."""
    import zstandard

    hasher, press = Hasher(), zstandard.ZstdCompressor(level=1)
    for batch in batches:
        made = []
        for text in batch.column("text").to_pylist():
            gaps = np.diff(np.unique(hasher(text)).astype(np.int32), prepend=np.int32(0))
            made.append(press.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column("y")], names=["buckets", "y"])


class Unpacked:
    """The buckets of each row of a column that `hashed` has made, unpacked as they are read."""

    def __init__(self, packed: pa.ChunkedArray):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self) -> Iterator[np.ndarray]:
        import zstandard

        for data in self.packed:
            gaps = np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), np.uint8).reshape(4, -1)
            yield np.cumsum(np.ascontiguousarray(gaps.T).view(np.int32).ravel(), dtype=np.int32)


def scorer(buckets: np.ndarray, weights: np.ndarray, bias: float):
    dense = np.zeros(1 << BITS, np.float32)
    dense[buckets] = weights
    hasher = Hasher()

    def logit(raw: bytes) -> float:
        ids = hasher(raw.decode("utf-8", "replace"))
        hit = ids[dense[ids] != 0]
        return float(dense[np.unique(hit)].sum()) + bias

    def score(raw: list[bytes]) -> dict[str, np.ndarray]:
        return {"score": 1 / (1 + np.exp(-np.clip([logit(x) for x in raw], -700, 700)))}

    return score


def score(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """docs with a column score, the likelihood of toxic 1, in place of `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    return per_row(docs, "text", lambda: scorer(*shared.value), {"score": pa.float64()}, "score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """doc_id, held_out, score (likelihood of toxic 1) and predicted (score >= 0.7) for every row of docs.

    Only texts are inputs, and whole texts are scored. NULL and empty texts, and texts without words, get the bias alone. With no
    usable label every score is 0.5. NULL ids and repeated rows are scored as they come; other columns are ignored.
    """
    scored = score(docs.select("doc_id", "text"), labels, sample)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> DataFrame:
    """The rows of docs that score below 0.7, with all their columns."""
    whole, columns = whole_row(docs)
    packed = docs.select("text", whole)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    scored = per_row(packed, "text", lambda: scorer(*shared.value), {"score": pa.float64()}, "score double")
    return scored.where("score < 0.7").select(*columns.values())
