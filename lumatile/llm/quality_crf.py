"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's features are its own and those of the lines before and after it. The chain is fitted to
labelled documents, each line taking its document's label; forward-backward gives each line's
marginal probability of being good, and a document's score is their mean weighted by line length.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text

#: Labelled documents that the model is fitted to, and lines that they have in all, at most.
TRAIN_DOCS, TRAIN_LINES = 3000, 200_000
#: One of so many labelled documents, by CRC-32 of its doc_id, is held out.
FOLDS = 5
#: Scores from here on are label 1.
THRESHOLD = 0.3
#: Of a line's features, those that its neighbours see too.
SEEN = (2, 3, 4, 9, 10, 11)
WIDTH = 12 + 2 * (len(SEEN) + 1)
#: Line slots (documents times longest document) of one forward-backward run.
SLOTS = 1 << 18

_SYMBOLS, _UPPER, _DIGITS, _POINTS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:?'\"()-"
_HIGH = bytes(range(128, 256))


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines, WIDTH) features and the lines' lengths in bytes; lines without a word are left out."""
    rows, lengths, seen = array("d"), array("d"), set()
    for line in text.split(b"\n"):
        w = line.split()
        if not w:
            continue
        n, size = len(w), len(line)
        left = lambda drop: (size - len(line.translate(None, drop))) / size
        rows.extend((
            1.0, np.log1p(size), left(_SYMBOLS), left(b"!"), left(_UPPER), left(_DIGITS), left(_POINTS), left(_HIGH),
            min(sum(map(len, w)) / n, 40.0), sum(map(eq, w, w[1:])) / n, float(line in seen), 1 - len(set(w)) / n,
        ))
        lengths.append(size)
        seen.add(line)
    own = np.array(rows).reshape(-1, 12)
    if not len(own):
        return np.zeros((0, WIDTH)), np.zeros(0)
    near = np.hstack([own[:, SEEN], np.ones((len(own), 1))])  # the 1 tells that there is such a line
    none = np.zeros((1, near.shape[1]))
    return np.hstack([own, np.vstack([none, near[:-1]]), np.vstack([near[1:], none])]), np.array(lengths, float)


def _padded(values: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(values), max(map(len, values)), *values[0].shape[1:]))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """emit (docs, lines, 2), move (2, 2): marginals (docs, lines, 2), expected moves (docs, 2, 2), log partition sums.

    Lines from a document's length on are padding: their marginals are 0, whatever alpha has grown to there.
    """
    docs, most, _ = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[:, 0] = emit[:, 0]
    for t in range(1, most):
        alpha[:, t] = emit[:, t] + _log_sum(alpha[:, t - 1, :, None] + move, 1)
    for t in range(most - 2, -1, -1):
        beta[:, t] = np.where((t + 1 < lengths)[:, None], _log_sum(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
    log_z = _log_sum(alpha[np.arange(docs), lengths - 1], 1)
    there = np.arange(most) < lengths[:, None]
    marginals = np.exp(np.where(there[..., None], alpha + beta - log_z[:, None, None], -np.inf))
    moves = np.zeros((docs, 2, 2))
    if most > 1:
        pair = alpha[:, :-1, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None]
        moves = (np.exp(np.where(there[:, 1:, None, None], pair, -np.inf))).sum(axis=1)
    return marginals, moves, log_z


def _runs(lengths: list[int], slots: int = SLOTS) -> Iterator[list[int]]:
    """Indices of documents at least half as long as the longest of them, longest first, with at most `slots` lines when padded; longer ones are alone."""
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: lengths[i])
    while order:
        most = lengths[order[-1]]
        like = len(order) - bisect.bisect_left(order, most / 2, key=lambda i: lengths[i])
        k = max(1, min(like, slots // most))
        yield order[-k:]
        del order[-k:]


def fit(features: list[np.ndarray], labels: list[int], steps: int = 150, ridge: float = 1e-3) -> dict:
    """Weights by Adam on the conditional likelihood of the label sequences; deterministic."""
    rows = np.vstack(features) if features else np.zeros((0, WIDTH))
    if not len(rows) or len(set(labels)) < 2:  # nothing to tell apart: every line gets the labels' share
        p = min(max(float(np.mean(labels)) if labels else 0.5, 1e-3), 1 - 1e-3)
        return {"mean": np.zeros(WIDTH), "scale": np.ones(WIDTH), "w": np.eye(1, WIDTH)[0] * np.log(p / (1 - p)), "move": np.zeros((2, 2)), "empty": 0.0}
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    mean[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    chunks = list(_runs([len(f) for f in features]))
    data = [(_padded([(features[i] - mean) / scale for i in c]), np.array([labels[i] for i in c]), np.array([len(features[i]) for i in c])) for c in chunks]
    theta = np.zeros(WIDTH + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = ridge * theta * len(features)
        move = theta[WIDTH:].reshape(2, 2)
        for x, y, n in data:
            emit = np.stack([np.zeros(x.shape[:2]), x @ theta[:WIDTH]], axis=-1)
            marginals, moves, _ = forward_backward(emit, move, n)
            there = np.arange(x.shape[1]) < n[:, None]
            # Per document the mean over its lines, so that long ones don't rule.
            miss = (marginals[..., 1] - y[:, None]) * there / n[:, None]
            grad[:WIDTH] += np.einsum("dl,dlf->f", miss, x)
            seen = np.zeros((len(y), 2, 2))
            seen[np.arange(len(y)), y, y] = n - 1
            grad[WIDTH:] += ((moves - seen) / n[:, None, None]).sum(axis=0).ravel()
        grad /= len(features)
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    if not np.isfinite(theta).all():
        raise ArithmeticError("the classifier's weights are not finite")
    return {"mean": mean, "scale": scale, "w": theta[:WIDTH], "move": theta[WIDTH:].reshape(2, 2), "empty": 0.0}


def scores(model: dict, features: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    """Length-weighted mean marginal of each document; model["empty"] for one without lines."""
    out = np.full(len(features), model["empty"])
    for own in _runs([len(f) for f in features]):
        n = np.array([len(features[i]) for i in own])
        good = _padded([((features[i] - model["mean"]) / model["scale"]) @ model["w"] for i in own])
        marginals, _, _ = forward_backward(np.stack([np.zeros_like(good), good], axis=-1), model["move"], n)
        weight = _padded([lengths[i] for i in own])
        out[own] = (marginals[..., 1] * weight).sum(axis=1) / weight.sum(axis=1)
    if not np.isfinite(out).all():
        raise ArithmeticError("a score is not finite")
    return np.clip(out, 0.0, 1.0)


def _features(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        rows = [line_features(t)[0].ravel() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = TRAIN_DOCS, folds: int = FOLDS, lines: int = TRAIN_LINES) -> dict:
    """A model fitted to labelled rows whose doc_id isn't held out: `most` of them at most, chosen by a hash of doc_id.

    Of these, those with over a hundredth of `lines` stay out of the fitting, as do those, in order of a
    hash of their features, with which all would have more than `lines`: so the driver's share is bounded.
    """
    key = F.col("doc_id").cast("string")
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (F.crc32(key.cast("binary")) % folds != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(column).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")  # of `most` rows
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.text", "x.label")
    held = one.mapInArrow(_features, "label int, features array<double>").withColumn("n", F.size("features") / WIDTH).where(F.col("n") <= lines / 100)
    in_all = F.sum("n").over(Window.orderBy(F.xxhash64("features")).rowsBetween(Window.unboundedPreceding, 0))  # of `most` rows
    found = held.withColumn("in_all", in_all).where(F.col("in_all") <= lines).orderBy("label", F.xxhash64("features")).select("label", "features").toArrow()
    features = [np.array(f).reshape(-1, WIDTH) for f in found["features"].to_pylist()]
    y = found["label"].to_pylist()
    use = [i for i, f in enumerate(features) if len(f)]
    return fit([features[i] for i in use], [y[i] for i in use])


def _scored(model: dict, folds: int, threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            pairs = [line_features(t) for t in b.column(1).to_pylist()]
            s = scores(model, [p[0] for p in pairs], [p[1] for p in pairs])
            held = [d is not None and zlib.crc32(str(d).encode()) % folds == 0 for d in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def classify(docs: DataFrame, model: dict, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (columns doc_id, text): doc_id, held_out, score, predicted.

    A text that is null, empty or has no word has no line to judge and scores 0. Equal texts
    score alike. A row without a doc_id is scored and not held out. An empty table gives no rows.
    Only the text enters the score.
    """
    return id_and_text(docs).mapInArrow(_scored(model, folds, threshold), "doc_id long, held_out boolean, score double, predicted int")


def _passes(model: dict, text_at: int, threshold: float):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            pairs = [line_features((t or "").encode()) for t in b.column(text_at).to_pylist()]
            s = scores(model, [p[0] for p in pairs], [p[1] for p in pairs])
            yield b.filter(pa.array(s >= threshold))

    return run


def accepted(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold, with all their columns."""
    return docs.mapInArrow(_passes(model, docs.columns.index("text"), threshold), docs.schema)
