"""Quality by ordinal regression: one set of hashed-text weights, ordered thresholds.

P(grade <= k) = sigmoid(threshold_k - weights . features). Grades of labelled documents:
0 toxic, 1 of low quality, 2 good. Features of a text are presences: its distinct words (lower
case, outer punctuation off) hashed into a fixed space, and shapes: which share of its
tokens ends in symbols, is upper case, holds digits, or repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.frames import as_bytes, memory, pieces
from gridloom.session import ship

#: Hashed word features; the shape features follow them.
SPACE = 1 << 18
SHAPES, STEPS = 5, 8
#: Labelled rows to fit on, chosen by a hash of the id; texts that a word feature must be in.
TRAIN_ROWS, MIN_TEXTS = 8_000, 3
ROUNDS, PENALTY = 300, 1.0
CACHE_ENTRIES = 500_000
GRADES = 3
_EDGE = b" \t\r\n.,;:!?\"'()[]{}<>|*#$%&@=+~^_-/\\`"


def token_traits(token: bytes) -> tuple[int, int]:
    """Word feature (-1: none) and shape bits of a token."""
    word = token.strip(_EDGE).lower()
    ends = len(token) - len(token.rstrip(b"!*#$%&@=+~^_|?")) >= 2
    letters = token.strip(_EDGE)
    bits = ends | (len(letters) > 1 and letters.isupper()) << 1 | any(48 <= c < 58 for c in token) << 2 | (not word) << 3
    return (xxhash.xxh32_intdigest(word) & (SPACE - 1) if word else -1), bits


class Features:
    """Feature numbers of texts; remembers tokens."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.word, self.bits = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int8)

    def learn(self, tokens: list[bytes]) -> None:
        for token in tokens:
            at = self.place[token] = len(self.place)
            if at == len(self.word):
                self.word, self.bits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.word, self.bits))
            self.word[at], self.bits[at] = token_traits(token)

    def of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        with memory("quality", self.clear):
            return self._of(texts)

    def _of(self, texts: list[bytes | None]) -> list[np.ndarray]:
        split = [(t or b"").split() for t in texts]
        if len(self.place) > CACHE_ENTRIES:
            self.clear()
        self.learn([t for t in set().union(*split) if t not in self.place])
        out = []
        for tokens in split:
            at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
            words = np.unique(self.word[at])
            words = words[words >= 0]
            bits = self.bits[at]
            n = max(1, len(tokens))
            shares = [np.count_nonzero(bits & (1 << b)) / n for b in range(4)] + [1 - len(words) / n]
            steps = [SPACE + b * STEPS + min(STEPS - 1, int(np.ceil(s * 20)) if s < 0.2 else 4 + int(s * 4)) for b, s in enumerate(shares)]
            out.append(np.concatenate([words, np.array(steps, np.int32)]))
        return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[f].sum() for f in features])

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """[text, k]: P(grade > k)."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def thresholds_of(step: np.ndarray) -> np.ndarray:
    """Thresholds from the first one and the logarithms of the steps, which keeps them in order."""
    return np.cumsum([step[0], *np.exp(step[1:])])


def loss(
    w: np.ndarray,
    step: np.ndarray,
    flat: np.ndarray,
    owner: np.ndarray,
    grades: np.ndarray,
    penalty: float,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log likelihood with the penalty, and its gradients by weights and steps.

    ``flat`` and ``owner``: the features, by their places in ``w``, of all texts.
    """
    theta = thresholds_of(step)
    s = np.bincount(owner, w[flat], len(grades))
    fu, fl = _sigmoid(np.append(theta, 40.0)[grades] - s), _sigmoid(np.concatenate([[-40.0], theta])[grades] - s)
    fu[grades == GRADES - 1], fl[grades == 0] = 1.0, 0.0
    p = np.maximum(fu - fl, 1e-9)
    gu, gl = fu * (1 - fu) / p, fl * (1 - fl) / p
    dtheta = np.array([-gu[grades == k].sum() + gl[grades == k + 1].sum() for k in range(GRADES - 1)])
    dstep = np.array([dtheta.sum(), *(dtheta[k:].sum() * np.exp(step[k]) for k in range(1, GRADES - 1))])
    dw = np.bincount(flat, (gu - gl)[owner], len(w)) + penalty * w
    return -float(np.log(p).sum()) + penalty / 2 * float(w @ w), dw, dstep


def fit(features: list[np.ndarray], grades: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over all rows at once.

    Without rows all weights are 0 and the thresholds put every text above both.
    """
    size = SPACE + SHAPES * STEPS
    if not len(grades):
        return Model(np.zeros(size, np.float32), np.array([-4.0, -3.0]))
    flat = np.concatenate(features)
    owner = np.repeat(np.arange(len(features)), [len(f) for f in features])
    seen = np.bincount(flat, minlength=size)
    keep = (seen[flat] >= MIN_TEXTS) & ((seen[flat] < len(features)) | (flat >= SPACE))
    flat, owner = flat[keep], owner[keep]
    used, flat = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    share = np.array([(np.sum(grades <= k) + 0.5) / (len(grades) + 1) for k in range(GRADES - 1)])
    theta = np.log(share / (1 - share))
    step = np.array([theta[0], *np.log(np.maximum(np.diff(theta), 0.1))])
    n = len(grades)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]
    for t in range(1, rounds + 1):
        _, dw, dstep = loss(w, step, flat, owner, grades, penalty)
        for x, g, m, v in ((w, dw / n, state[0], state[1]), (step, dstep / n, state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, thresholds_of(step))


_features = Features()


def features_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """By this worker's own table; a closure would carry a copy of it."""
    return _features.of(texts)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about ``train_rows`` labelled documents (labels: id, quality, toxic).

    Several labels of a document: it is toxic if one says so, of low quality if one says so.
    Rows without id, quality or toxic, and labels without document, teach nothing.
    """
    ship(docs.sparkSession)
    graded = labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic").dropna()
    graded = graded.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    total = graded.count()
    if total > train_rows:
        graded = graded.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * train_rows / total))
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") < 1, 1).otherwise(2)
    graded = F.broadcast(graded.select("id", grade.alias("grade")))  # about train_rows rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(graded, "id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["grade"], pa.array(features_of(as_bytes(batch["text"])), pa.list_(pa.int32()))],
                ["id", "grade", "features"],
            )

    table = rows.mapInArrow(featured, "id long, grade int, features array<int>").toArrow().sort_by("id")
    return fit([np.array(f, np.int32) for f in table["features"].to_pylist()], table["grade"].to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", min_good: float = 0.5) -> DataFrame:
    """One row per document: doc_id, expected_grade (0 to 2), p_not_toxic, p_good, kept.

    p_not_toxic and p_good are P(grade >= 1) and P(grade >= 2); kept: p_good is ``min_good`` or
    more. Null counts as empty; an empty text is scored by its shapes. Repeated ids are scored
    row by row. Other columns are not read. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            tail = shared.value.at_least(shared.value.scores(features_of(as_bytes(batch["text"]))))
            columns = [tail.sum(axis=1), tail[:, 0], tail[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *map(pa.array, columns), pa.array(tail[:, 1] >= min_good)],
                ["doc_id", "expected_grade", "p_not_toxic", "p_good", "kept"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, expected_grade double, p_not_toxic double, p_good double, kept boolean")
