"""Quality rules: counting rules, and a calibrated n-gram model trained on labelled rows.

The model is a logistic regression over hashed n-grams: words and pairs of words, and
stretches of 3 and 5 bytes. Each family's frequencies sum to one, so a text's length says
nothing. It is fitted on a bounded sample of labelled documents, its scores are calibrated
(Platt) on the part of the sample it was not fitted on, and every text is scored in Arrow
batches against a fixed probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridraft.llm.common import add_columns, map_batches, table

#: Fixed limits: words a text needs, and the percentage of words in repeated windows it may have.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Fixed threshold: calibrated probability of good quality from which a text is kept.
KEEP_FROM = 0.5
#: Labelled documents the model is fitted on at most; those with the smallest hash of their id.
TRAINING_ROWS = 2000
BUCKETS_BITS = 15
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def count_rules(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    data = text.encode()
    words = data.split()  # bytes: exactly the six ASCII white spaces
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, covered = Counter(windows), bytearray(len(words))
        for i, window in enumerate(windows):
            if counts[window] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return (
        len(words),
        len(text) - (len(data) - len(data.translate(None, SPACES))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_FACTOR = 0x9E3779B97F4A7C15
_POWERS = np.array([pow(_FACTOR, i + 1, 1 << 64) for i in range(64)], np.uint64)


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    """Upper bits of a mixed hash; families have buckets of their own."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_FACTOR)
    return (h >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64) + (family << BUCKETS_BITS)


def hashed(text: str) -> list[np.ndarray]:
    """Bucket numbers of all n-grams of a whole text, by family."""
    data = np.frombuffer(text.encode(), np.uint8)
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return []
    # The place of each byte within its word (what lies before the first word is white space).
    inside = np.arange(len(data)) - np.repeat(
        np.append(0, starts), np.diff(np.concatenate(([0], starts, [len(data)])))
    )
    value = (data.astype(np.uint64) + np.uint64(1)) * _POWERS[inside & 63]
    value[space] = 0
    word = np.add.reduceat(value, starts)
    families = [_bucket(word, 0)]
    if len(word) > 1:
        families.append(_bucket(word[:-1] * np.uint64(0x100000001B3) + word[1:], 1))
    byte = data.astype(np.uint64)
    for family, n in ((2, 3), (3, 5)):
        if len(data) >= n:
            h = np.zeros(len(data) - n + 1, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + byte[i : i + len(h)]
            families.append(_bucket(h, family))
    return families


@dataclass
class Model:
    """Weights by bucket; ``slope`` and ``shift`` calibrate the score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, families: list[np.ndarray]) -> float:
        return self.bias + sum(float(self.weights[x].mean()) for x in families)

    def probability(self, text: str) -> float:
        z = self.slope * self.score(hashed(text)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: What is used where labels of both kinds are missing: every text passes.
PASS_ALL = Model(np.zeros(4 << BUCKETS_BITS, np.float32), 40.0)


def _sparse(families: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their frequencies within their family."""
    index, value = [], []
    for x in families:
        found, n = np.unique(x, return_counts=True)
        index.append(found)
        value.append(n / len(x))
    return np.concatenate(index or [[]]).astype(np.int32), np.concatenate(value or [[]]).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 120) -> Model:
    """Logistic regression by Adam on all rows at once; every fourth row is left for calibration."""
    held = np.arange(len(rows)) % 4 == 3
    if len(set(labels[~held])) < 2:
        return PASS_ALL
    train = [r for r, h in zip(rows, held) if not h]
    y = labels[~held].astype(np.float64)
    index = np.concatenate([i for i, _ in train])
    value = np.concatenate([v for _, v in train])
    owner = np.repeat(np.arange(len(train), dtype=np.int32), [len(i) for i, _ in train])
    size = 4 << BUCKETS_BITS
    w, bias = np.zeros(size), float(np.log(y.mean() / (1 - y.mean())))
    # Both labels weigh the same; a small ridge keeps rare buckets near 0.
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = bias + np.bincount(owner, value * w[index], len(train))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.bincount(index, value * error[owner], size) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        g = float(error.sum())
        mb, vb = 0.9 * mb + 0.1 * g, 0.99 * vb + 0.01 * g * g
        bias -= 0.1 * (mb / (1 - 0.9**step)) / (vb**0.5 / (1 - 0.99**step) ** 0.5 + 1e-7)
    model = Model(w.astype(np.float32), bias)
    scores = np.array([bias + float((w[i] * x).sum()) for (i, x), h in zip(rows, held) if h])
    return calibrated(model, scores, labels[held])


def calibrated(model: Model, scores: np.ndarray, labels: np.ndarray) -> Model:
    """Platt scaling with his smoothed targets, by Newton steps."""
    good = labels > 0
    if not good.any() or good.all():
        return model
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    centre, spread = scores.mean(), scores.std() or 1.0
    x = np.column_stack([(scores - centre) / spread, np.ones(len(scores))])
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * beta)
        beta -= np.clip(step, -2, 2)
    return Model(model.weights, model.bias, float(beta[0] / spread), float(beta[1] - beta[0] * centre / spread))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``rows`` labelled documents: a bounded sample, which one task may hold.

    Labels that are null or contradict one another for an id count as bad quality if one of
    them is 0, and not at all if none is known.
    """
    known = labels.where(F.col(doc_id).isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy(F.col(doc_id).alias("__id")).agg(F.min("quality").alias("__label"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    texts = texts.join(F.broadcast(sample), "__id").select("__id", "__label", "__text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_sparse(hashed(x or "")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int64()),
                 pa.array([i.tobytes() for i, _ in found], pa.binary()),
                 pa.array([v.tobytes() for _, v in found], pa.binary())],
                ["id", "label", "index", "value"],
            )

    kinds = [texts.schema["__id"].dataType, T.LongType(), T.BinaryType(), T.BinaryType()]
    found = map_batches(texts, features, list(zip(["id", "label", "index", "value"], kinds)))
    fields = [("weights", T.BinaryType()), *((n, T.DoubleType()) for n in ("bias", "slope", "shift"))]
    model = map_batches(found.repartition(1), _fitted, fields).first()
    if model is None:
        return PASS_ALL
    return Model(np.frombuffer(model["weights"], np.float32), model["bias"], model["slope"], model["shift"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's (id, label, buckets, frequencies) -> the model, as one row."""
    rows = sorted(row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4))))
    if rows:
        sparse = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for _, _, i, v in rows]
        model = fit(sparse, np.array([r[1] for r in rows], np.int64))
        columns = [pa.array([model.weights.tobytes()], pa.binary())]
        columns += [pa.array([x], pa.float64()) for x in (model.bias, model.slope, model.shift)]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "bias", "slope", "shift"])


def quality_rules(
    docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None, keep_from: float = KEEP_FROM
) -> DataFrame:
    """One row per document: ``columns`` (default: the id), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, probability and kept.

    Counts come from whole texts; a null or empty text has no words and fails. Added names
    replace carried ones. Equal texts get equal verdicts. No rows give no rows.
    """

    def rules(texts: list[str]):
        counts = [count_rules(t) for t in texts]
        failed = [base_failed(c[0], c[4]) for c in counts]
        chance = [float(model.probability(t)) for t in texts]
        kept = [not f and p >= keep_from for f, p in zip(failed, chance)]
        return *(list(c) for c in zip(*counts)), failed, chance, kept

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [(n, T.LongType(), pa.int64()) for n in names]
    added += [
        ("base_failed", T.BooleanType(), pa.bool_()),
        ("probability", T.DoubleType(), pa.float64()),
        ("kept", T.BooleanType(), pa.bool_()),
    ]
    carried = [c for c in columns or ["doc_id"] if c not in {n for n, _, _ in added}]
    # The text is read under a name of its own, as a carried column may be called like it.
    rows = docs.select(*carried, F.col(text).alias("__text"))
    return add_columns(rows, "__text", added, rules, keep_text=False)


def op3_quality_rules(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality_rules(docs, train(docs, table(spark, folder, "labels")))
