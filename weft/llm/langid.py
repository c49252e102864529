"""Language ID by error-correcting output codes over letter n-grams.

Every learned language has a codeword; a logistic classifier of hashed n-grams
predicts each bit. Decoding sums the logistic loss of the bits against every
codeword, weighing a bit by how well it did on that language in training, and
takes the codeword with the least loss. A document is flagged as ambiguous if the
two best codewords' losses, in sums over bits, are closer than for all but a share
AMBIGUOUS of the training rows that are told right.

The classifiers are fitted on at most about `sample` documents, an equal number
for each language, chosen by a hash of the id; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.bytes_ import flat, gram_rows, pieces
from weft.llm.common import crc_of, unit_hash

SAMPLE = 3000
DIMS = 4096
AMBIGUOUS = 0.001
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    trust: np.ndarray  # languages x bits, each row sums to 1
    weights: np.ndarray  # dims x bits
    bias: np.ndarray
    least: float = 0.0  # a smaller gap is ambiguous

    def score(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its probability and the gap to the second, for each row."""
        if not self.code.shape[1]:
            return np.zeros(len(rows), np.int64), np.ones(len(rows)), np.full(len(rows), np.inf)
        margin = rows @ self.weights + self.bias
        loss = np.stack([np.logaddexp(0, -margin * c) @ t for c, t in zip(self.code, self.trust, strict=True)], axis=1)
        over = (loss - loss.min(axis=1, keepdims=True)) * self.code.shape[1]
        near = np.exp(-over)
        return loss.argmin(axis=1), near.max(axis=1) / near.sum(axis=1), np.partition(over, 1, axis=1)[:, 1]


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of -1 and 1: all splits in two up to six languages, else random far ones."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    rng, best, far = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        gap = ((bits - code @ code.T) / 2 + bits * np.eye(n)).min()
        if gap > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, gap
    return best


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression for each column of y (-1 or 1), by Adam on all rows."""
    w = np.zeros((x.shape[1] + 1, y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    share = (y > 0).mean(axis=0)
    balance = np.where(y > 0, 0.5 / np.maximum(share, 1e-3), 0.5 / np.maximum(1 - share, 1e-3)).astype(np.float32)
    for t in range(1, steps + 1):
        z = y * (x @ w[:-1] + w[-1])
        g = -balance * y / (1 + np.exp(np.clip(z, -30, 30))) / len(x)
        grad = np.vstack([x.T @ g + decay * w[:-1], g.sum(axis=0, keepdims=True)]).astype(np.float32)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], w[-1]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, dims: int = DIMS, ambiguous: float = AMBIGUOUS) -> LanguageModel:
    """Learns from rows with a language; null ones are left out."""
    rows = labelled.where(F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row per language
    languages = sorted(counts)
    code = codewords(len(languages))
    if not code.shape[1]:
        return LanguageModel(languages, code, code, np.zeros((256 + dims, 0)), np.zeros(0))
    quota = sample / len(languages)
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, quota / n))])
    picked = rows.where(unit_hash(F.col(id_col), F.lit(3)) < rate[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat(b.column(1))
            for lo, hi in pieces(offsets):
                x = gram_rows(data, offsets[lo : hi + 1], dims).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = picked.mapInArrow(encode, "lang string, x binary").toArrow()
    of = np.searchsorted(languages, got["lang"].to_pylist())
    # Order of arrival must not show in the weights' last digits.
    packed = got["x"].to_pylist()
    order = sorted(range(len(packed)), key=lambda i: (of[i], packed[i]))
    x = np.frombuffer(b"".join(packed[i] for i in order), np.float16).reshape(len(order), -1).astype(np.float32)
    of = of[order]
    y = code[of].astype(np.float32)
    w, bias = _logistic(x, y)
    right = ((x @ w + bias) * y > 0).astype(np.float64)
    trust = np.stack([right[of == k].mean(axis=0) if (of == k).any() else np.ones(code.shape[1]) for k in range(len(languages))])
    trust = np.maximum(trust, 1e-6)
    model = LanguageModel(languages, code, trust / trust.sum(axis=1, keepdims=True), w, bias)
    best, _, gap = model.score(x)
    told = gap[best == of]
    model.least = float(np.quantile(told, ambiguous)) if len(told) else 0.0
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, extra: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, lang_pred, score, ambiguous, and the columns `extra` of docs.

    Null texts and texts without a letter are `und` with score 0 and not ambiguous;
    so is everything if no language was learned. Whole texts are read, long ones in
    pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for b in batches:
            data, offsets = flat(b.column(1))
            best, p, gap = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows), np.zeros(b.num_rows)
            for lo, hi in pieces(offsets) if model.languages else ():
                best[lo:hi], p[lo:hi], gap[lo:hi] = model.score(gram_rows(data, offsets[lo : hi + 1], dims))
            known = b.column(2).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            best, p = np.where(known, best, len(names) - 1), np.where(known, p, 0.0)
            said = [pa.array(names[best], pa.string()), pa.array(p), pa.array(known & (gap < model.least))]
            yield pa.RecordBatch.from_arrays([b.column(0), *said, *b.columns[3:]], schema=out)

    more = [c for c in extra if c not in (id_col, "lang_pred", "score", "ambiguous")]
    kinds = {c: docs.schema[c].dataType for c in (id_col, *more)}
    schema = T.StructType([T.StructField("id", kinds[id_col]), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), *[T.StructField(c, kinds[c]) for c in more]])
    out = to_arrow_schema(schema)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters"), *more
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """predict() by a model of the rows whose crc32(id) mod folds is not held_out.

    Adds held_out. Repeated rows are scored alike; an empty table gives no rows.
    """
    out = F.pmod(crc_of(id_col), F.lit(folds)) == held_out
    model = fit(docs.where(~out), id_col, text_col, lang_col, sample)
    return predict(docs, model, id_col, text_col).withColumn("held_out", out)
