"""Document quality by a linear-chain conditional random field over lines.

Each line is a position of the chain with label good or bad. Its features describe the line, the
line before and the line after. Forward-backward gives each line's marginal probability of being
good; the length-weighted mean of these, calibrated by a logistic curve, is the document's score.

Training uses at most `sample` labelled documents (a documented bound), chosen by a hash of the id; of these, none over 64 K
characters or 400 lines (parameters). label_lines gives each line's label and probability.
Scoring is one pass over the documents without a shuffle.

Defined cases: null text counts as empty; an empty text is one empty line and gets a score like any
other; rows without doc_id are left out; repeated rows are scored each; labels that are null are not
used, of labels given twice the larger counts; without usable labels every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import chunks, fit_logistic, sigmoid, utf8, with_id

#: Bounds of training alone: labelled documents, and the characters and lines of one.
SAMPLE, TRAIN_TEXT, TRAIN_LINES = 3000, 1 << 16, 400


def _classes() -> np.ndarray:
    """For each byte, a row of flags: upper, letter, digit, symbol, '!', '|', punctuation, space, word start after space."""
    table = np.zeros((256, 8), np.float32)
    for byte in range(256):
        char = chr(byte)
        if byte < 128:
            row = (char.isupper(), char.isalpha(), char.isdigit(), char in "#$%&*@<>{}[]\\^~_=+/", char == "!", char == "|", char in ".,;:'\"?-()", char.isspace())
        else:
            row = (False, byte >= 0xC0, False, False, False, False, False, False)
        table[byte] = row
    return table


CLASSES = _classes()
FEATURES = 2 * 8 + 9
BYTE_HASH = np.random.default_rng(11).integers(1, 1 << 40, 256)


def line_features(data: np.ndarray, starts: np.ndarray):
    """Features of each line of each text, own and neighbours'; lengths of lines; first line and number of lines of each text."""
    n_docs = len(starts) - 1
    breaks = np.flatnonzero(data == 10)
    # A text's end closes its last line: a break is virtual there.
    doc_of_break = np.searchsorted(starts, breaks, "right") - 1
    n_lines = np.bincount(doc_of_break, minlength=n_docs) + 1
    first = np.cumsum(n_lines) - n_lines
    total = int(n_lines.sum())
    end = np.empty(total, np.int64)
    last = first + n_lines - 1
    inner = np.ones(total, bool)
    inner[last] = False
    end[inner] = breaks
    end[last] = starts[1:]
    begin = np.empty(total, np.int64)
    begin[1:] = end[:-1] + 1
    begin[first] = starts[:-1]
    length = end - begin
    x = np.zeros((total, FEATURES), np.float32)
    denominator = np.maximum(length, 1)
    for k in range(8):
        flags = CLASSES[:, k].astype(np.uint8)[data] if k else (CLASSES[:, 0].astype(np.uint8)[data] | _upper_accented(data))
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        part = (sums[end] - sums[begin]) / denominator
        x[:, k] = part
        x[:, 8 + k] = np.sqrt(part)
    words = np.maximum(1, x[:, 7] * denominator)
    x[:, 16] = np.log1p(length) / 8
    x[:, 17] = np.minimum(denominator / words, 40) / 20
    full = length > 0
    tail, head = np.zeros(total, np.uint8), np.zeros(total, np.uint8)
    tail[full], head[full] = data[end[full] - 1], data[begin[full]]
    x[:, 18] = np.isin(tail, (33, 46, 63))
    x[:, 19] = (head >= 65) & (head <= 90)
    x[:, 20] = length < 20
    x[:, 21] = x[:, 0] > 0.4 * np.maximum(x[:, 1], 1e-3)
    x[:, 22] = x[:, 3] + x[:, 4] + x[:, 5] > 0.02
    x[:, 23] = _repeated_words(data, begin, end) / words
    x[:, 24] = x[:, 23] > 0.3
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after, np.ones((total, 1), np.float32)]), length, first, n_lines


def _upper_accented(data: np.ndarray) -> np.ndarray:
    """Second bytes of the capitals of the Latin-1 block in UTF-8."""
    out = np.zeros(len(data), np.uint8)
    out[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return out


def _repeated_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words of each line equal the word before."""
    inside = np.concatenate([[False], data > 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    if len(starts) < 2:
        return np.zeros(len(begin))
    offset = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    value = np.where(data > 32, BYTE_HASH[data] * (2 * offset + 1), 0)
    sums = np.concatenate([[0], np.cumsum(value)])
    word = sums[stops] - sums[starts]
    same = np.concatenate([[False], word[1:] == word[:-1]])
    count = np.concatenate([[0], np.cumsum(same)])
    return count[np.searchsorted(starts, end)] - count[np.searchsorted(starts, begin)]


def _steps(first: np.ndarray, n_lines: np.ndarray):
    """For each position in the chains, the lines there, chains by falling length."""
    order = np.argsort(-n_lines, kind="stable")
    falling = -n_lines[order]
    for t in range(int(n_lines.max(initial=0))):
        alive = int(np.searchsorted(falling, -t, "left"))
        yield t, first[order[:alive]] + t


def forward_backward(emit: np.ndarray, first: np.ndarray, n_lines: np.ndarray, move: np.ndarray):
    """Log partition of each chain and log alpha, log beta of each line. emit: score of good (bad has 0); move[a, b]: from a to b."""
    score = np.zeros((len(emit), 2))
    score[:, 1] = emit
    alpha, beta = score.copy(), np.zeros_like(score)
    steps = list(_steps(first, n_lines))
    for t, at in steps[1:]:
        before = alpha[at - 1]
        alpha[at] += np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1])
    for t, at in reversed(steps[1:]):
        after = score[at] + beta[at]
        beta[at - 1] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
    last = first + n_lines - 1
    return np.logaddexp(alpha[last, 0], alpha[last, 1]), alpha, beta


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    calibration: np.ndarray

    def marginals(self, x, first, n_lines) -> np.ndarray:
        """Probability of each line to be good."""
        z, alpha, beta = forward_backward(x @ self.weights, first, n_lines, self.move)
        return np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - np.repeat(z, n_lines), 0))

    def raw(self, x, length, first, n_lines) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each text."""
        good = self.marginals(x, first, n_lines)
        weight = np.maximum(length, 1)
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))

    def score(self, data, starts) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        return sigmoid(self.calibration[0] * self.raw(*line_features(data, starts)) + self.calibration[1])


def train(x, length, first, n_lines, labels, steps: int = 200, rate: float = 0.05, ridge: float = 2e-4) -> Model:
    """Maximum conditional likelihood with Adam; every line carries its document's label."""
    y = np.repeat(labels, n_lines).astype(int)
    inner = np.ones(len(y), bool)
    inner[first] = False
    inner = np.flatnonzero(inner)
    size = x.shape[1]
    theta, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    target = np.concatenate([x.T @ y, seen.ravel()])
    total = len(y)
    for step in range(1, steps + 1):
        w, move = theta[:size], theta[size:].reshape(2, 2)
        emit = x @ w
        z, alpha, beta = forward_backward(emit, first, n_lines, move)
        zz = np.repeat(z, n_lines)
        good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - zz, 0))
        score = np.zeros((total, 2))
        score[:, 1] = emit
        pair = np.exp(np.minimum(alpha[inner - 1][:, :, None] + move + (score + beta)[inner][:, None, :] - zz[inner][:, None, None], 0)).sum(0)
        gradient = (target - np.concatenate([x.T @ good, pair.ravel()])) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:size], theta[size:].reshape(2, 2), np.array([1.0, 0.0]))
    model.calibration = fit_logistic(model.raw(x, length, first, n_lines)[:, None], labels.astype(float), ridge=0.1)
    return model


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = TRAIN_TEXT, most_lines: int = TRAIN_LINES) -> Model:
    """Train on at most `sample` labelled documents that are not held out; those over `longest` characters or `most_lines` lines are
    not trained on (they are scored whole like all others)."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("quality").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    picked = with_id(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= longest)

    def features(batches):
        for batch in chunks(batches, "text"):
            x, length, first, n_lines = line_features(*utf8(batch.column("text")))
            rows = [(x[a : a + n].tobytes(), length[a : a + n].tobytes()) if n <= most_lines else (None, None) for a, n in zip(first, n_lines)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__label").cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "label", "x", "n"])

    got = picked.select("doc_id", "text", "__label").mapInArrow(features, "doc_id long, label int, x binary, n binary").where("x is not null").collect()
    got = sorted({(r.doc_id, r.label, bytes(r.x), bytes(r.n)) for r in got})
    if not got:
        return Model(np.zeros(3 * FEATURES + 1), np.zeros((2, 2)), np.array([0.0, 0.0]))
    x = np.vstack([np.frombuffer(r[2], np.float32).reshape(-1, 3 * FEATURES + 1) for r in got]).astype(np.float64)
    n_lines = np.array([len(r[3]) // 8 for r in got])
    return train(x, np.concatenate([np.frombuffer(r[3], np.int64) for r in got]), np.cumsum(n_lines) - n_lines, n_lines, np.array([r[1] for r in got]))


def add_scores(docs: DataFrame, model: Model, column: str = "__score") -> DataFrame:
    """All columns of docs and the score of each text."""
    docs = with_id(docs)

    def scored(batches):
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(*utf8(batch.column("text"))), pa.float64())], names=[*batch.schema.names, column])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(scored, f"{kinds}, `{column}` double")


def label_lines(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """doc_id, line (from 0), n_bytes, probability and good (the label) of every line of every text; an empty text is one empty line."""

    def labelled(batches):
        for batch in chunks(batches, "text"):
            x, length, first, n_lines = line_features(*utf8(batch.column("text")))
            good = model.marginals(x, first, n_lines) if len(first) else np.zeros(0)
            ids = pa.array(np.repeat(batch.column("doc_id").to_numpy(zero_copy_only=False), n_lines), pa.int64())
            line = np.arange(len(length)) - np.repeat(first, n_lines)
            columns = [ids, pa.array(line, pa.int32()), pa.array(length, pa.int64()), pa.array(good, pa.float64()), pa.array(good >= cut)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "n_bytes", "probability", "good"])

    return with_id(docs, "doc_id", "text").mapInArrow(labelled, "doc_id long, line int, n_bytes long, probability double, good boolean")


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = add_scores(with_id(docs, "doc_id", "text"), fit(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= cut).cast("int").alias("predicted"))
