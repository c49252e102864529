"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded from its
bytes, gated attention (Ilse et al., 2018) weighs the passages, and the document's
score comes from the weighted mean of their encodings. Only documents have
labels; where quality shows within a document is learned.

It is fitted on whole labelled documents, the first by a hash of the id: at most
`sample` of them, and no more than fit into `passages` passages together, which
bounds what the driver holds (about 1.5 kB a passage). Rows that agree in id and
text count once. Scoring reads every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.bytes_ import PASSAGE_DIMS, PASSAGE_WORDS, PIECE, flat, passage_rows, pieces
from weft.llm.common import crc_of, cut, word_count

SAMPLE = 6000
PASSAGES = 100_000
HIDDEN, GATE = 32, 16
THRESHOLD = 0.7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """p(label 1) of a bag; parameters: encoder, two gates, attention and output."""

    def __init__(self, dims: int = PASSAGE_DIMS, hidden: int = HIDDEN, gate: int = GATE, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.mean, self.scale = np.zeros(dims, np.float32), np.ones(dims, np.float32)
        self.p = {"E": draw(dims, hidden), "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.zeros(1, np.float32)}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings and attention logits of passages."""
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["E"] + p["e"])
        return h, (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]

    def pool(self, h: np.ndarray, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of bags of consecutive passages."""
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, at), sizes))
        a /= np.repeat(np.add.reduceat(a, at), sizes)
        z = np.add.reduceat(h * a[:, None], at, axis=0)
        return _sigmoid(z @ self.p["c"] + self.p["b"])

    def _gradient(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        s = (t * g) @ p["w"]
        at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, at), sizes))
        a /= np.repeat(np.add.reduceat(a, at), sizes)
        z = np.add.reduceat(h * a[:, None], at, axis=0)
        d = (_sigmoid(z @ p["c"] + p["b"]) - y) / len(y)
        dz = np.repeat(d, sizes)[:, None] * p["c"]
        da = (dz * h).sum(axis=1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, at), sizes))
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = dz * a[:, None] + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - h * h)
        return {"E": x.T @ du, "e": du.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.003, decay: float = 1e-4, seed: int = 7) -> AttentionModel:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 0.02)
        at, rng = np.concatenate(([0], np.cumsum(sizes))), np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), batch):
                own, t = order[lo : lo + batch], t + 1
                rows = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
                for k, g in self._gradient(x[rows], sizes[own], y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    step = rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = (self.p[k] * (1 - rate * decay) - step).astype(np.float32)
        return self


def _long_rows(data: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
    """Passages of one long text, a piece of it at a time; a piece ends a passage and a word."""
    for at in range(lo, hi, PIECE):
        yield passage_rows(data, np.array([at, min(hi, at + PIECE)]))[0]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> AttentionModel | None:
    """Learns from labels(id, label) of docs, a single document at least; None if none has a label."""
    chosen = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.xxhash64(id_col, F.lit(9)).alias("k"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t")]
    size = F.greatest(F.lit(1), F.ceil(word_count(text) / PASSAGE_WORDS)).alias("n")
    # At most `sample` rows of numbers: the first documents, and how many passages they have up to each.
    first = cut(docs.select(*key, size).join(chosen, "id").groupBy("k", "id", "t", "y").agg(F.max("n").alias("n")).orderBy("k", "id", "t").limit(sample))
    upto = first.withColumn("upto", F.sum("n").over(Window.orderBy("k", "id", "t"))).where((F.col("upto") <= passages) | (F.col("upto") == F.col("n")))
    rows = docs.select(*key, F.col(text_col).cast("binary").alias("text")).join(F.broadcast(upto.select("id", "t", "y")), ["id", "t"])
    rows = rows.groupBy("id", "t", "y").agg(F.first("text").alias("text")).select("id", "y", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(2))
            for i in range(b.num_rows):
                x = np.concatenate(list(_long_rows(data, int(offsets[i]), int(offsets[i + 1]))) or [passage_rows(data, offsets[[i, i]])[0]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([x.astype(np.float16).tobytes()], pa.binary())], ["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(((i, x, y) for i, y, x in zip(*(c.to_pylist() for c in rows.mapInArrow(encode, f"id {kind}, y double, x binary").toArrow().columns), strict=True)), key=lambda r: r[:2])
    if not got:
        return None
    bags = [np.frombuffer(x, np.float16).reshape(-1, PASSAGE_DIMS) for _, x, _ in got]
    y = np.array([r[2] for r in got], np.float32)
    return AttentionModel().fit(np.concatenate(bags).astype(np.float32), np.array([len(x) for x in bags]), y)


def score(docs: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), n_passages. Without a model, 0.5.

    Null and empty texts are one empty passage and get a score like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(1))
            p, n = np.full(b.num_rows, 0.5), np.ones(b.num_rows, np.int64)
            for lo, hi in pieces(offsets):
                if offsets[hi] - offsets[lo] > PIECE:
                    parts = [(model.encode(x) if model else None, len(x)) for x in _long_rows(data, int(offsets[lo]), int(offsets[hi]))]
                    n[lo] = sum(k for _, k in parts)
                    if model:
                        h, s = (np.concatenate([q[0][j] for q in parts]) for j in (0, 1))
                        p[lo] = model.pool(h, s, n[lo : lo + 1])[0]
                    continue
                x, n[lo:hi] = passage_rows(data, offsets[lo : hi + 1])
                if model:
                    p[lo:hi] = model.pool(*model.encode(x), n[lo:hi])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(n)], ["id", "score", "n_passages"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, score double, n_passages long").withColumnRenamed("id", id_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """score() by a model of the labels whose crc32(id) mod folds is not held_out.

    Adds held_out and predicted (1 from threshold on). Rows that repeat an id are
    scored alike, a repeated label counts once; an empty table gives no rows.
    """
    out = F.pmod(crc_of(id_col), F.lit(folds)) == held_out
    model = fit(docs.where(~out), labels.where(~out), id_col, text_col, label_col, sample)
    return score(docs, model, id_col, text_col).select(id_col, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_passages")
