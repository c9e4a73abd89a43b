"""Quality classifier: attention-based multiple-instance learning over passages.

A text is cut into passages of a fixed number of words. Each passage gets a vector of shares and is encoded by a
layer; gated attention (a tanh branch times a sigmoid branch) weighs the passages, and the weighted sum decides. All
weights, those of the attention too, are learned from document labels alone.

Edge cases: null and empty texts are one passage without words. Unlabelled documents and null labels are scored, not
learned from; of several labels the smallest counts, of several texts of an id the one whose vectors come first. Without
labels of both kinds the score is the share of good labels (0.5 without labels). Repeated rows are scored one by one; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymart.llm.common import slices, utf8

#: Words in a passage.
PASSAGE = 64
#: Labelled documents to learn from, at most, chosen by the hash of their id.
MAX_LABELLED = 12_000
THRESHOLD = 0.7
HIDDEN, ATTENTION = 16, 8

_CLASSES = [b"#*$%&|<>", b"!?", b".,;:", b"0123456789", b"|", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(0x80, 0xC0))]


def passage_vectors(text: bytes, size: int = PASSAGE) -> np.ndarray:
    """A row of shares for each passage."""
    words = text.split()
    total, kinds = len(words), len(set(words))
    out = []
    for at in range(0, max(len(words), 1), size):
        part = words[at : at + size]
        n = max(len(part), 1)
        joined = b" ".join(part)
        length = len(joined)
        counts = [length - len(joined.translate(None, c)) for c in _CLASSES]
        upper, lower = counts[5], counts[6]
        out.append(
            (
                counts[0] / n, counts[1] / n, counts[2] / n, counts[3] / n, counts[4] / n,
                upper / max(upper + lower, 1), (length - counts[7] - len(part) + 1) / n / 8, len(set(part)) / n,
                len(set(zip(part, part[1:]))) / max(len(part) - 1, 1), len(part) / size, np.log1p(total) / 8, kinds / max(total, 1),
            )
        )
    return np.array(out, np.float32)


FEATURES = 12


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder, gated attention and output over bags of passage vectors."""

    def __init__(self, seed: int = 0, base_rate: float | None = None):
        r = np.random.default_rng(seed)
        self.p = {
            "w": r.normal(0, 0.4, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
            "v": r.normal(0, 0.4, (HIDDEN, ATTENTION)), "u": r.normal(0, 0.4, (HIDDEN, ATTENTION)), "a": r.normal(0, 0.4, ATTENTION),
            "c": r.normal(0, 0.4, HIDDEN), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.base_rate = base_rate

    def _forward(self, x: np.ndarray, begin: np.ndarray):
        """``begin``: the first passage of each document."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _squash(h @ p["u"])
        e = (t * g) @ p["a"]
        size = np.diff(np.append(begin, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), size))
        weight = e / np.repeat(np.add.reduceat(e, begin), size)
        z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
        return x, h, t, g, weight, size, z, z @ p["c"] + p["d"]

    def score(self, x: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if self.base_rate is not None:
            return np.full(len(begin), self.base_rate)
        return _squash(self._forward(x, begin)[-1])

    def step(self, x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted logistic loss."""
        p = self.p
        x, h, t, g, a, size, z, out = self._forward(x, begin)
        slope = (_squash(out) - y) * weight / weight.sum()
        dz = slope[:, None] * p["c"]
        at = np.repeat(np.arange(len(begin)), size)
        da = (dz[at] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, begin)[at])
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = a[:, None] * dz[at] + dt @ p["v"].T + dg @ p["u"].T
        dx = dh * (1 - h * h)
        return {
            "w": x.T @ dx, "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de,
            "c": z.T @ slope, "d": np.array([slope.sum()]),
        }


def learn(bags: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 128, seed: int = 0) -> Attention:
    if not len(y) or y.min() == y.max():
        return Attention(seed, base_rate=float(y.mean()) if len(y) else 0.5)
    model = Attention(seed)
    everything = np.concatenate(bags)
    model.mean, model.scale = everything.mean(0), everything.std(0) + 1e-3
    weight = np.where(y == 1, 1.0, min(4.0, (y == 1).sum() / (y == 0).sum()))
    random = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    n = 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x = np.concatenate([bags[k] for k in pick])
            begin = np.concatenate([[0], np.cumsum([len(bags[k]) for k in pick])[:-1]])
            n += 1
            for k, g in model.step(x, begin, y[pick], weight[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                model.p[k] -= 0.01 * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Attention:
    """Learn from at most ``max_labelled`` labelled documents; only their passage vectors reach the driver."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labelled)
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors = [passage_vectors(t).tobytes() for t in utf8(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(vectors, pa.binary())], ["doc_id", "quality", "bag"]
            )

    # The labels are at most max_labelled pairs of numbers.
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    kinds = {c: known.schema[c].dataType.simpleString() for c in ("doc_id", "quality")}
    rows = (
        known.select("doc_id", "quality", "text")
        .mapInArrow(measure, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, bag binary")
        .groupBy("doc_id", "quality")
        .agg(F.min("bag").alias("bag"))  # of repeated ids always the same text
        .toPandas()
        .sort_values("doc_id")
    )
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows["bag"]]
    return learn(bags, rows["quality"].to_numpy(float))


def score(docs: DataFrame, model: Attention, *keep: str) -> DataFrame:
    """doc_id, the columns named, and score (0 to 1, higher is better) of every document."""
    keep = tuple(dict.fromkeys(["doc_id", *keep]))
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            bags = [passage_vectors(t) for t in utf8(batch)]
            begin = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
            made = model.score(np.concatenate(bags), begin)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.float64())], [*keep, "score"])

    return kept.mapInArrow(run, schema + ", score double")
