"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Tokens are runs of letters and digits and runs of other characters, so that
``word***`` is the two tokens ``word`` and ``***``. Uni- and bigrams of the
tokens and of their shapes (capitals, small letters, digits, marks, length
class) hash into one table of weights. A document is the sparse vector of its
features' logarithmic counts, scaled to unit length, and its score a sparse
dot product over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitlake.llm import _text

BITS = 20
#: Bound of the labelled sample that the model is fitted on: the rows with the smallest hashes of their ids.
TRAIN_ROWS = 8_000
PASSES = 2


def _kinds() -> np.ndarray:
    """0 white space and controls, 1 letters, digits and beyond ASCII, 2 other marks."""
    kind = np.full(256, 2, np.uint8)
    kind[:33] = 0
    kind[_text.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 1
    return kind


def _shapes() -> np.ndarray:
    """One bit for each sort of byte."""
    shape = np.full(256, 8, np.uint8)
    shape[:33] = 0
    shape[0x41:0x5B], shape[0x61:0x7B], shape[0x30:0x3A], shape[0x80:] = 1, 2, 4, 2
    return shape


KIND, SHAPE = _kinds(), _shapes()


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature ids, values) of each document of a block; a document without tokens has none."""
    kind = KIND[data]
    edge = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kind[start] > 0 if len(data) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    first = np.searchsorted(start, offsets)
    token = _text.span_hash(_text.prefix_hash(data), start, end)
    shape = np.bitwise_or.reduceat(SHAPE[data], start) if len(start) else np.zeros(0, np.uint8)
    # reduceat also takes the white space up to the next token, which has no bit.
    shape = _text.mix(shape.astype(np.uint64) * np.uint64(16) + np.minimum(end - start, 24).astype(np.uint64) // np.uint64(6) + np.uint64(1))
    space = np.uint64((1 << bits) - 1)
    grams = [token, shape, _text.shingles(token, 2), _text.shingles(shape, 2) + np.uint64(7)]
    out = []
    for i in range(len(offsets) - 1):
        a, b = first[i], first[i + 1]
        ids = np.concatenate([g[a : b - (k >= 2)] if b > a else g[:0] for k, g in enumerate(grams)]) & space
        ids, n = np.unique(ids.astype(np.int32), return_counts=True)
        value = np.log1p(n)
        out.append((ids, (value / max(np.sqrt((value * value).sum()), 1e-12)).astype(np.float32)))
    return out


@dataclass(frozen=True)
class Model:
    """Weights over the hashed features; ``bias`` is the score's logit of a document without features."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, ids: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids] @ values, -35, 35))))


class Learner:
    """Follow-the-regularised-leader (proximal) state, of fixed size, fed with one row at a time."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.0005, l2: float = 0.0) -> None:
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.zb = self.nb = 0.0

    def _weight(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def _bias(self) -> float:
        return -self.zb / ((self.beta + np.sqrt(self.nb)) / self.alpha)

    def feed(self, ids: np.ndarray, values: np.ndarray, label: int) -> None:
        w, bias, n = self._weight(self.z[ids], self.n[ids]), self._bias(), self.n[ids]
        wrong = 1 / (1 + np.exp(-np.clip(bias + w @ values, -35, 35))) - label
        g = wrong * values
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] += g * g
        self.zb += wrong - (np.sqrt(self.nb + wrong * wrong) - np.sqrt(self.nb)) / self.alpha * bias
        self.nb += wrong * wrong

    def model(self) -> Model:
        return Model(self._weight(self.z, self.n).astype(np.float32), float(self._bias()), self.bits)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = PASSES) -> Model:
    """The model after ``passes`` passes over the rows in the order given. Without rows every score is one half."""
    learner = Learner(bits)
    for _ in range(passes):
        for row in rows:
            learner.feed(*row)
    return learner.model()


def _featurise(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in _text.blocks(batches):
            found = features(data, offsets, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())], names=[*batch.schema.names[:-1], "ids", "values"])

    return run


def _learn(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row of the weights that (label, ids, values) rows leave, fed in the order in which they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(bits)
        for batch in batches:
            for label, ids, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                learner.feed(np.frombuffer(ids, np.int32), np.frombuffer(values, np.float32), label)
        model = learner.model()
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], names=["weights", "bias"])

    return run


def fit(labelled: DataFrame, text_col: str, label_col: str, order: Column, rows: int = TRAIN_ROWS, bits: int = BITS, passes: int = PASSES) -> Model:
    """Fits on the ``rows`` rows that come first in ``order``, a documented bound. Rows with a null label are left out.

    Features are made where the texts lie. One task then learns, as a stream:
    it holds the weights and a batch of rows, each of at most 2**bits
    features, and the driver gets the weights alone.
    """
    some = labelled.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("int").alias("label"), order.alias("o"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.col(text_col).cast("string").alias("text"))
    some = some.mapInArrow(_featurise(bits), "label int, o long, t long, ids binary, values binary").orderBy("o", "label", "t").limit(rows)
    each = some.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(passes)))).repartition(1).sortWithinPartitions("pass", "o", "label", "t")
    learned = each.select("label", "ids", "values").mapInArrow(_learn(bits), "weights binary, bias double").first()
    return Model(np.frombuffer(learned[0], np.float32), learned[1], bits) if learned else Learner(bits).model()


def _score(model: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Model = model.value
        for batch, data, offsets in _text.blocks(batches, "_text"):
            scores = [held.score(*f) for f in features(data, offsets, held.bits)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "_score"])

    return run


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (without the text unless ``keep_text``) and ``_score``. A null or empty text gets the model's bias."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the corpus
    docs = docs.withColumn("_text", F.col(text_col).cast("string"))
    if not keep_text:
        docs = docs.drop(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "_text")
    return docs.mapInArrow(_score(shared), f"{schema + ', ' if schema else ''}_score double")


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 on division by 3; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """The model of a labelled corpus; held-out rows are never learned from."""
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_doc"))
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(F.col("_label").isNotNull() & ~held_out("_id"))
    # Ids are chosen before texts are fetched: the sample is bounded, so is the side that is sent around.
    chosen = marks.orderBy(F.xxhash64("_id"), "_id", "_label").limit(rows)
    return fit(texts.join(F.broadcast(chosen), "_id"), "_doc", "_label", F.xxhash64("_id"), rows)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    ``score`` estimates the probability of label 1 from the text alone. Null
    and empty texts have no features and get the base rate; repeated rows get
    equal scores; unlabelled ids, labels without document, null labels and
    further columns do not matter; an empty table gives an empty result, and
    without labels every score is one half.
    """
    model = quality_model(docs, labels, id_col, text_col, label_col, rows)
    out = scored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_doc")), model, "_doc")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
