"""Quality classifier: Naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.storage import whole_text
from tabloom.llm.tokens import Words, text_chunks

#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: At most so many labelled rows are used to fit; they are those with the smallest hash of their id.
MAX_LABELLED = 8_000
_SPREAD = np.uint32(2_654_435_761)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never used: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bucket(value: np.ndarray, salt: int) -> np.ndarray:
    value = (value.astype(np.uint32) + np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _SPREAD
    value ^= value >> np.uint32(15)
    return (value * np.uint32(0x85EBCA6B)) >> np.uint32(16)


def _word_shapes(words: Words) -> np.ndarray:
    """A small code per word: kind of its first and last byte, capitals, and whether it repeats the word before."""
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return np.empty(0, np.uint32)
    kind = np.zeros(256, np.uint32)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1], kind[128:] = 1, 2, 3, 1
    plain = kind > 0
    last = data[ends - 1]
    last_code = np.where(plain[last], kind[last], last.astype(np.uint32) + 4)
    before = data[np.maximum(ends - 2, starts)]
    before_code = np.where(plain[before], 0, 1).astype(np.uint32)
    middle = kind[data[np.minimum(starts + 1, ends - 1)]]
    hashes = words.hashes()
    same = np.zeros(len(starts), np.uint32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.rows[1:] == words.rows[:-1])
    size = np.minimum(ends - starts, 15).astype(np.uint32) // 4
    return (((((kind[data[starts]] * 4 + middle) * 300 + last_code) * 2 + before_code) * 2) + same) * 4 + size


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the hashed n-grams that it has: one to three bytes, and one to three word shapes."""
    for low, high, data, offsets in text_chunks(column):
        words = Words(data, offsets)
        shapes = _word_shapes(words)
        wide = data.astype(np.uint32)
        two = wide[:-1] * np.uint32(257) + wide[1:]
        three = two[:-1] * np.uint32(257) + wide[2:]
        grams = [_bucket(wide, 1), _bucket(two, 2), _bucket(three, 3)]
        shape2 = shapes[:-1] * np.uint32(40_503) + shapes[1:]
        shape3 = shape2[:-1] * np.uint32(40_503) + shapes[2:]
        shaped = [_bucket(shapes, 4), _bucket(shape2, 5), _bucket(shape3, 6)]
        for row in range(high - low):
            seen = np.zeros(BUCKETS, bool)
            a, b = offsets[row], offsets[row + 1]
            for size, gram in enumerate(grams):
                seen[gram[a : max(a, b - size)]] = True
            a, b = words.bounds[row], words.bounds[row + 1]
            for size, gram in enumerate(shaped):
                seen[gram[a : max(a, b - size)]] = True
            yield seen


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(seen).tobytes() for seen in indicators(batch.column("body"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array(bits, pa.binary())], names=["doc_id", "quality", "bits"]
        )


class Model:
    """Weights per bucket, intercept, and the logistic curve from margin to score."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift
        self.scales = None

    def margin(self, seen: np.ndarray) -> float:
        at = np.flatnonzero(seen)
        size = float(self.scales[at].sum(dtype=float)) if self.scales is not None else 1.0
        return float(self.weights[at].sum(dtype=float)) / max(size, 1e-9) ** 0.5 + self.bias

    def score(self, seen: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(seen) + self.shift, -30, 30))))


def _unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).view(bool)


def log_count_ratios(bits: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Log of the smoothed share of each indicator in class 1 over that in class 0."""
    counts = np.ones((2, BUCKETS))
    for packed, label in zip(bits, labels, strict=True):
        counts[int(label)] += _unpacked(packed)
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    features: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, costs: np.ndarray, size: int, epochs: int, seed: int,
) -> tuple[np.ndarray, float]:
    """Minimise |w|^2 / 2 plus the hinge losses times their costs; one dual variable is solved at a time."""
    weights, bias, alpha = np.zeros(size), 0.0, np.zeros(len(signs))
    diagonal = np.array([float(x @ x) + 1.0 for _, x in features])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(signs)):
            at, x = features[i]
            gradient = signs[i] * (float(weights[at] @ x) + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), costs[i])
            step = (new - alpha[i]) * signs[i]
            if step:
                weights[at] += step * x
                bias += step
                alpha[i] = new
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weights, bias


def _calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with the two target values drawn in for small samples."""
    positive = labels.sum()
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (len(labels) - positive + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        gap, weight = p - target, np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([gap @ margins + 1e-3 * slope, gap.sum()])
        hessian = np.array([
            [weight @ margins**2 + 1e-3, weight @ margins], [weight @ margins, weight.sum() + 1e-9]
        ])
        move = np.linalg.solve(hessian, gradient)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return max(slope, 1e-3), shift


def fit(bits: list[bytes], labels: np.ndarray, cost: float = 1.0, epochs: int = 30, seed: int = 42) -> Model:
    """Fit on four of five rows and draw the curve of scores from the fifth; constant where one class is missing."""
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(BUCKETS), 0.0, 1e-3, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    fold = np.random.default_rng(seed).permutation(len(labels)) % 5
    train = np.flatnonzero(fold > 0) if len(labels) >= 50 else np.arange(len(labels))
    if len(set(labels[train].tolist())) < 2:
        train = np.arange(len(labels))
    check = np.flatnonzero(fold == 0) if len(train) < len(labels) else train
    ratios = log_count_ratios([bits[i] for i in train], labels[train])
    features = []
    for i in train:
        at = np.flatnonzero(_unpacked(bits[i])).astype(np.uint16)
        x = ratios[at]
        features.append((at, (x / max(float(x @ x) ** 0.5, 1e-9)).astype(np.float32)))
    signs = np.where(labels[train] == 1, 1.0, -1.0)
    shares = {s: (signs == s).mean() for s in (1.0, -1.0)}
    costs = np.array([cost / (2 * shares[s]) for s in signs])
    weights, bias = dual_coordinate_descent(features, signs, costs, BUCKETS, epochs, seed)
    model = Model(weights * ratios, bias)
    model.scales = (ratios**2).astype(np.float32)
    if len(set(labels[check].tolist())) < 2:
        check = np.arange(len(labels))
    model.slope, model.shift = _calibrated(np.array([model.margin(_unpacked(bits[i])) for i in check]), labels[check].astype(float))
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """The model from at most ``max_labelled`` labelled rows that are not held out.

    The rows with the smallest hash of their id are taken, so the choice does not depend on partitioning. What
    reaches the driver is that bounded sample, as 8 KB of indicator bits a row. Null labels, null ids and labels
    without a document are passed over; the first of several labels of a document (0 before 1) counts.
    """
    usable = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("quality")).where(
        F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    )
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    single = sample.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    body = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("body"))
    chosen = body.join(F.broadcast(single), "doc_id")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    bits = chosen.select("doc_id", "quality", "body").mapInArrow(_features, f"doc_id {kind}, quality int, bits binary")
    got = bits.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("bits").alias("bits")).toArrow()
    order = np.argsort(np.array(got["doc_id"].to_pylist()), kind="stable") if got.num_rows else []
    packed, marks = got["bits"].to_pylist(), got["quality"].to_pylist()
    return fit([packed[i] for i in order], np.array([marks[i] for i in order], int))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for every row, in one pass over the whole texts without a shuffle.

    A null text is scored as the empty one, which has the intercept alone. Null ids are not held out. Repeated rows
    have equal scores. An empty table gives no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(seen) for seen in indicators(batch.column("body"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double").select(
        F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Model, text_col: str = "text", cut: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose score is at least ``cut``, in one pass without a shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            body = pc.fill_null(batch.column(at).cast(pa.string()), "").cast(pa.binary())
            yield batch.filter(pa.array([own.score(seen) >= cut for seen in indicators(body)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
