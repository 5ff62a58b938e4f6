"""Secret scans: a character convolutional network in numpy judges every candidate with its surroundings.

Fixed patterns give the base findings (assign, access, hex); those always stay. Every other token
that could be a key is a candidate. The network is trained on labelled findings of all documents: findings of the fixed
patterns are positive, with the keyword or prefix that shows them to these patterns taken out; tokens of plain words and short numbers are negative, and so are near-misses, tokens that look like keys and
aren't: joined identifiers, paths, abbreviated digests behind the word that names them, long numbers and encoded prose, each made of a
document's own words and put in the place of one of them. What is neither is not trained on.
`fit` begins from a network of a bounded sample of windows (`labelled_windows`, `train`) and goes on over the whole table: groups of
documents, dealt by a hash of the id, refine it side by side and their weights are averaged. Half of the distinct findings train the
network, a sixth calibrates its output, and a third chooses the highest threshold (in steps of 2**-18 of a logit) that still reaches
the wanted recall on masked findings; plain tokens and near-misses of five sixths of the documents train, those of a sixth calibrate.
Every one of these is used, and each class weighs the same. The result doesn't hang on how rows are dealt to tasks.
`held_out_rates` says how the network judges a kind that it was not trained on, by networks of the sample.

Defined cases: null text counts as empty and has no findings; rows without doc_id are left out;
repeated rows are scanned each; a table that lacks findings or negatives in one of the parts gives a model that
adds nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import chunks, dropped, fit_logistic, sigmoid, texts, with_id, written

#: Documents sampled for the first weights, and most distinct windows of each class: plain, near-miss, finding.
SAMPLE, FINDINGS = 20_000, 1500
RECALL = 0.95
#: Documents of a group that refines the network by itself and taught findings that it has at least on average; negatives and findings of a step, its rate.
GROUP, GROUP_FINDINGS = 4000, 64
NEGATIVES, POSITIVES, RATE = 4096, 512, 0.002
#: Parts of the findings (and documents) by a hash: 1 calibrates, 2 and 5 choose the threshold, the others train.
PARTS, CALIBRATES, KEPT_PARTS = 6, 1, (2, 5)
LEFT, BODY, RIGHT = 20, 40, 8
WIDTH = LEFT + BODY + RIGHT
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Every token as long as the shortest value of ASSIGN.
LEAST = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
PART = re.compile(r"[A-Za-z0-9]{8,}")
DIGIT = re.compile(r"[0-9]")
STEP, BLOCK = BODY // 2, 256
#: Words and short numbers, joined: no key looks so.
SAFE = re.compile(r"[+/_=-]*(?:(?:[A-Z]?[a-z]{1,24}|[A-Z]{1,24}|[0-9]{1,8})(?:[+/_=-]+|$))+")
WORD = re.compile(r"\b[A-Za-z]{8,}\b")
SHORT = re.compile(r"[A-Za-z]{3,12}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if DIGIT.search(text) or len(text) >= 32:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Tokens of LEAST characters or more; where a base span covers a part, what is left of them."""
    found, k = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][2] <= at:
            k += 1
        j = k
        while j < len(base) and base[j][0] < end:
            if base[j][0] - at >= LEAST:
                found.append((at, base[j][0]))
            at = max(at, base[j][2])
            j += 1
        if end - at >= LEAST:
            found.append((at, end))
    return found


def _alphabet() -> np.ndarray:
    """Class of each ASCII character; 0 is padding and 12 everything beyond ASCII."""
    kind = np.full(129, 11, np.int64)
    for c in range(128):
        char = chr(c)
        kind[c] = 1 if char in "abcdef" else 2 if char.islower() else 3 if char in "ABCDEF" else 4 if char.isupper() else 5 if char.isdigit() else 6 if char in "=:" else 7 if char in "\"'" else 8 if char in "_-" else 9 if char.isspace() else 10 if char in "/+." else 11
    kind[128] = 12
    return kind


ALPHABET = _alphabet()
N_CLASSES = 13


def views(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Pieces of at most BODY characters that cover a candidate: one every STEP, the last, and one from each part between marks."""
    if end - start <= BODY:
        if text[start:end].isalnum():  # one part
            return [(start, end)]
        at = {start}
    else:
        at = {*range(start, end - BODY, STEP), end - BODY}
    at.update(m.start() for m in PART.finditer(text, start, end))
    return [(a, min(end, a + BODY)) for a in sorted(at)]


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Classes of the characters around each piece: LEFT before, at most BODY of it, RIGHT after."""
    if not spans:
        return np.zeros((0, WIDTH), np.uint8)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.zeros(len(points) + LEFT + BODY + RIGHT, np.uint8)
    codes[LEFT : LEFT + len(points)] = ALPHABET[np.minimum(points, 128)]
    return _cut(codes, spans)


def _cut(codes: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Windows of classes that begin with LEFT paddings."""
    start, end = np.array(spans, np.int64).T
    body = codes[start[:, None] + LEFT + np.arange(BODY)]
    body[np.arange(BODY) >= (end - start)[:, None]] = 0
    return np.hstack([codes[start[:, None] + np.arange(LEFT)], body, codes[end[:, None] + LEFT + np.arange(RIGHT)]])


def masked(text: str, start: int, kind: int, end: int) -> list[bytes]:
    """Windows of a base finding that the fixed patterns don't see: no keyword, no prefix, hexadecimal runs cut; once as it is and
    once behind letters of the text and a mark, as part of a longer token, so that marks before it don't speak against a key."""
    value = ASSIGN.match(text, start).start(1) if kind == 0 else start + 4 * (kind == 1)
    body = HEX.sub(lambda m: m.group()[: 16 + len(m.group()) % 16], text[value:end])
    left, right = text[max(0, start - LEFT) : start], text[end : end + RIGHT]
    letters = "".join(c for c in left.lower() if "a" <= c <= "z")[-4:] or "id"
    out = []
    for lead in ("", letters + "_-/"[zlib.crc32(body.encode()) % 3]):
        joined, size = left + lead + body + right, len(lead) + len(body)
        out += [w.tobytes() for w in windows(joined, views(joined, len(left), len(left) + size))]
    return out


#: Labels of windows: plain tokens, then near-misses, then masked findings of the fixed patterns.
LABELS = ("plain", "identifier", "path", "digest", "number", "prose", "assign", "access", "hex")
NEAR, FOUND = 1, 6
NAMES_OF_DIGESTS = ("commit ", "sha1 ", "md5 ", "build ", "revision ")


def near_misses(text: str) -> list[tuple[int, bytes]]:
    """(label, window) of tokens that look like keys and aren't, made of the text's words behind a place that its CRC-32 picks (its
    first words, where too few follow); a text of fewer than four words of three letters gives none."""
    seed = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    for place in (seed % (len(text) + 1), 0):
        words = list(islice(SHORT.finditer(text, place), 4))
        if len(words) == 4:
            break
    else:
        return []
    own = [m.group().lower() for m in words]
    digits = str(int(hashlib.sha256(own[0].encode() + seed.to_bytes(4, "big")).hexdigest(), 16))
    short = hashlib.sha1(digits.encode()).hexdigest()[: 8 + seed % 13]
    camel = own[0] + "".join(w.title() for w in own[1 : 2 + seed % 3])
    digest_name = NAMES_OF_DIGESTS[seed % len(NAMES_OF_DIGESTS)]
    bodies = (
        ("", camel + digits[: seed % 3]),
        ("", "/".join([own[0], camel, f"{own[1]}_v{digits[0]}", own[2] + digits[1:3]])),
        (digest_name, short),
        ("", digits[: 9 + seed % 11]),
        ("", base64.b64encode(" ".join(own).encode()).decode()),
    )
    start, end = words[0].span()
    right = text[end : end + RIGHT]
    # All five in one row of classes, with paddings between.
    made, labels, spans, at = [], [], [], 0
    for label, (name, body) in enumerate(bodies, NEAR):
        left = (text[max(0, start - LEFT) : start] + name)[-LEFT:]
        joined = left + body + right
        own = views(joined, len(left), len(left) + len(body))
        labels += [label] * len(own)
        spans += [(a + at, b + at) for a, b in own]
        made.append(joined)
        at += len(joined) + WIDTH
    points = np.frombuffer(("\x7f" * WIDTH).join(made).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.zeros(at + LEFT, np.uint8)
    codes[LEFT : LEFT + len(points)] = ALPHABET[np.minimum(points, 128)]
    at = LEFT
    for joined in made:
        at += len(joined) + WIDTH
        codes[at - WIDTH : at] = 0
    return list(zip(labels, map(bytes, _cut(codes, spans))))


@dataclass
class Network:
    kernel: np.ndarray  # (5 * classes, filters)
    bias: np.ndarray
    dense: np.ndarray  # (2 * filters + 1,)
    calibration: np.ndarray
    threshold: float

    def logits(self, codes: np.ndarray) -> np.ndarray:
        tables = _tables(self.kernel, self.bias)
        out = [_pooled(_active(codes[at : at + BLOCK], *tables)) for at in range(0, len(codes), BLOCK)]
        return np.concatenate([(x * self.dense).sum(1) for x in out] or [np.zeros(0)])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return sigmoid(self.calibration[0] * self.logits(codes) + self.calibration[1])


def _tables(kernel, bias):
    """What the convolution makes of three characters in a row (with the bias) and of the two behind them."""
    taps = kernel.reshape(5, N_CLASSES, -1)
    three = taps[0][:, None, None] + taps[1][:, None] + taps[2] + bias
    two = taps[3][:, None] + taps[4]
    return three.reshape(N_CLASSES**3, -1).astype(np.float32), two.reshape(N_CLASSES**2, -1).astype(np.float32)


def _active(codes, three, two):
    """One-hot characters, convolution of width 5, ReLU: (positions, windows, filters)."""
    codes, n = np.ascontiguousarray(codes.T).astype(np.intp), WIDTH - 4
    pairs = codes[:-1] * N_CLASSES + codes[1:]
    conv = three.take(pairs[:n] * N_CLASSES + codes[2 : n + 2], 0)
    conv += two.take(pairs[3 : n + 3], 0)
    return np.maximum(conv, 0, out=conv)


def _pooled(active):
    """Maximum and mean over positions, and 1."""
    return np.hstack([active.max(0), active.mean(0), np.ones((active.shape[1], 1), np.float32)]).astype(float)


def _forward(codes, kernel, bias, dense):
    """Logits, and what _gradients needs."""
    active = _active(codes, *_tables(kernel, bias))
    pooled = _pooled(active)
    return (pooled * dense).sum(1), active, pooled


def _gradients(codes, error, active, pooled, dense):
    """Of kernel, bias and dense layer, where `error` is the derivative by each logit."""
    filters, n = active.shape[2], WIDTH - 4
    back = error[:, None] * dense[None, :-1]
    grad = np.repeat(back[None, :, filters:] / n, n, 0)
    best = active.argmax(0)[None]
    np.put_along_axis(grad, best, np.take_along_axis(grad, best, 0) + back[None, :, :filters], 0)
    grad *= active > 0
    kernel, codes = np.zeros((5, N_CLASSES, filters)), codes.T.astype(np.intp)
    for k in range(5):
        np.add.at(kernel[k], codes[k : k + n].ravel(), grad.reshape(-1, filters))
    return kernel.reshape(-1, filters), grad.sum((0, 1)), pooled.T @ error


class _Adam:
    def __init__(self, params, rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.first, self.second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def update(self, grads) -> None:
        self.step += 1
        for i, g in enumerate(grads):
            g = g + 1e-4 * self.params[i]
            self.first[i], self.second[i] = 0.9 * self.first[i] + 0.1 * g, 0.999 * self.second[i] + 0.001 * g * g
            self.params[i] = self.params[i] - self.rate * (self.first[i] / (1 - 0.9**self.step)) / (np.sqrt(self.second[i] / (1 - 0.999**self.step)) + 1e-8)


def _random(filters: int = 12, seed: int = 5):
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.2, (5 * N_CLASSES, filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters + 1)]


def _nothing() -> Network:
    return Network(np.zeros((5 * N_CLASSES, 1)), np.zeros(1), np.zeros(3), np.array([0.0, 0.0]), 2.0)


def train(codes: np.ndarray, labels: np.ndarray, filters: int = 12, epochs: int = 14, rate: float = 0.02, recall: float = RECALL) -> Network:
    rng = np.random.default_rng(5)
    order = rng.permutation(len(codes))
    codes, labels = codes[order], labels[order].astype(float)
    # A third for the threshold, a sixth for the calibration, the rest for training.
    part = np.arange(len(codes)) % 6
    kept, calibrates = part % 3 == 2, part == 1
    taught = ~(kept | calibrates)
    if not all(0 < labels[own].sum() < own.sum() for own in (kept, calibrates, taught)):
        return _nothing()
    x, y = codes[taught], labels[taught]
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    adam = _Adam([rng.normal(0, 0.2, (5 * N_CLASSES, filters)), np.zeros(filters), rng.normal(0, 0.2, 2 * filters + 1)], rate)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            out, active, pooled = _forward(x[at], *adam.params)
            adam.update(_gradients(x[at], (sigmoid(out) - y[at]) * weight[at] / len(at), active, pooled, adam.params[2]))
    net = Network(*adam.params, np.array([1.0, 0.0]), 0.5)
    net.calibration = fit_logistic(net.logits(codes[calibrates])[:, None], labels[calibrates], ridge=0.1)
    positive = np.sort(net.probability(codes[kept])[labels[kept] > 0])
    net.threshold = float(positive[int(np.floor((1 - recall) * len(positive)))])
    return net


def plain_windows(text: str, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Windows of plain tokens: words and short numbers, joined, outside the base findings."""
    safe = [(start, end) for start, end in candidates(text, base) if SAFE.fullmatch(text, start, end)]
    word = WORD.search(text)  # ordinary words are negative too
    if word and SAFE.fullmatch(word.group()):
        safe.append(word.span())
    return windows(text, [v for start, end in sorted(set(safe)) if not any(a < end and start < b for a, _, b in base) for v in views(text, start, end)])


def labelled_windows(docs: DataFrame, sample: int = SAMPLE, most: int = FINDINGS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and their labels (places in LABELS) in about `sample` documents (all, where there are fewer), chosen by a
    hash of the id; of each class the `most` first by a hash. A window with several labels has the highest."""
    docs = with_id(docs, "doc_id", "text")
    every = max(1, docs.count() // max(1, sample))

    def findings(batches):
        for batch in chunks(batches, "text"):
            codes, label = [], []
            for text in texts(batch.column("text")):
                base = base_spans(text)
                for start, kind, end in base:
                    for code in masked(text, start, kind, end):
                        codes.append(code), label.append(FOUND + kind)
                for kind, code in near_misses(text):
                    codes.append(code), label.append(kind)
                for code in plain_windows(text, base):
                    codes.append(code.tobytes()), label.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(label, pa.int32())], names=["codes", "label"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(findings, "codes binary, label int")
    distinct = written(part.groupBy("codes").agg(F.max("label").alias("label")), "findings")
    bounds = ((0, NEAR), (NEAR, FOUND), (FOUND, len(LABELS)))
    classes = [distinct.where((F.col("label") >= lo) & (F.col("label") < hi)) for lo, hi in bounds]
    got = [r for own in classes for r in own.orderBy(F.xxhash64("codes"), "codes").limit(most).collect()]
    dropped(distinct)
    codes = np.frombuffer(b"".join(bytes(r.codes) for r in got), np.uint8).reshape(-1, WIDTH).astype(np.int64)
    return codes, np.array([r.label for r in got], np.int64)


def negatives(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a text's plain tokens and of its near-misses."""
    near = [w for _, w in near_misses(text)]
    return plain_windows(text, base_spans(text)), np.frombuffer(b"".join(near), np.uint8).reshape(-1, WIDTH)


def _part(column: str):
    return F.pmod(F.xxhash64(column), F.lit(PARTS))


class _Refined:
    """A network that goes on learning from the negatives of one group of documents and the group's findings in turn. The loss is a hinge,
    quadratic up to twice the margin and linear beyond: what is on the right side of the margin has no derivative, and costs no step back."""

    def __init__(self, params, group: int):
        self.adam, self.group, self.found, self.at = _Adam([p.copy() for p in params], RATE), group, [], 0
        self.waiting: tuple[list, list] = ([], [])
        self.size = 0

    def add(self, text: str) -> None:
        for own, some in zip(self.waiting, negatives(text)):
            own.append(some)
            self.size += len(some)
        if self.size >= NEGATIVES:
            self.step()

    def step(self) -> None:
        if isinstance(self.found, list):
            self.found = np.frombuffer(b"".join(self.found), np.uint8).reshape(-1, WIDTH)
        turn = self.found[np.arange(self.at, self.at + min(POSITIVES, len(self.found))) % max(1, len(self.found))]
        self.at += len(turn)
        classes = [np.concatenate(own or [self.found[:0]]) for own in self.waiting] + [turn]
        self.waiting, self.size = ([], []), 0
        net, codes, error = Network(*self.adam.params, None, 0.0), [], []
        for own, sign, weight in zip(classes, (1, 1, -1), (0.25, 0.25, 0.5)):
            wrong = np.clip(1 + sign * net.logits(own), 0, 2)
            far = wrong > 0
            codes.append(own[far]), error.append(sign * weight * wrong[far] / max(1, len(own)))
        codes, error = np.concatenate(codes), np.concatenate(error)
        if len(codes):
            dense, grads = net.dense, None
            for at in range(0, len(codes), BLOCK):
                own = codes[at : at + BLOCK]
                _, active, pooled = _forward(own, *self.adam.params)
                part = _gradients(own, error[at : at + BLOCK], active, pooled, dense)
                grads = part if grads is None else [a + b for a, b in zip(grads, part)]
            self.adam.update(grads)

    def row(self) -> pa.RecordBatch:
        if self.size:
            self.step()
        flat = np.concatenate([p.ravel() for p in self.adam.params])
        return pa.RecordBatch.from_arrays([pa.array([np.round(flat * 2.0**32).astype(np.int64)], pa.list_(pa.int64()))], names=["weights"])


def _refine(docs: DataFrame, found: DataFrame, params, groups: int):
    """The average of the weights (in whole multiples of 2**-32, so that no order of adding changes it) that all groups arrive at."""
    group = lambda column: F.pmod(F.xxhash64(column, F.lit(7)), F.lit(groups)).alias("g")
    mine = docs.where(_part("doc_id") != CALIBRATES).select(group("doc_id"), F.lit(None).cast("binary").alias("codes"), "doc_id", "text")
    taught = found.where(~_part("codes").isin(CALIBRATES, *KEPT_PARTS))
    rows = mine.unionByName(taught.select(group("codes"), "codes", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("string").alias("text")))
    rows = rows.repartition("g").sortWithinPartitions("g", F.col("codes").asc_nulls_last(), "doc_id", "text")

    def refine(batches):
        own = None
        for batch in chunks(batches, "text", 1 << 20):
            for g, codes, text in zip(batch.column("g").to_pylist(), batch.column("codes").to_pylist(), texts(batch.column("text"))):
                if own is None or own.group != g:
                    if own:
                        yield own.row()
                    own = _Refined(params, g)
                if codes is None:
                    own.add(text)
                else:
                    own.found.append(codes)
        if own:
            yield own.row()

    each = rows.mapInArrow(refine, "weights array<long>").select(F.posexplode("weights").alias("at", "w"))
    sums = sorted(tuple(r) for r in each.groupBy("at").agg((F.sum(F.col("w").cast("decimal(38,0)")) / F.count("*")).cast("double").alias("w")).collect())
    flat = np.array([w for _, w in sums]) / 2.0**32
    ends = np.cumsum([p.size for p in params])
    return [flat[end - p.size : end].reshape(p.shape) for p, end in zip(params, ends)]


def _calibrated(docs: DataFrame, found: DataFrame, net: Network) -> np.ndarray | None:
    """Logistic curve over logits in steps of 1/64, from all that calibrates, each class with the same weight; None where a class lacks."""

    def binned(batches):
        for batch in chunks(batches, "text", 1 << 20):
            pairs = [negatives(text) for text in texts(batch.column("text"))]
            for label, own in enumerate(zip(*pairs)):
                yield counted(label, np.concatenate(own))

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                yield counted(2, np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH))

    def counted(label, codes):
        bins, n = np.unique(np.floor(np.clip(net.logits(codes), -40, 40) * 64).astype(np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), label, np.int32)), pa.array(bins), pa.array(n.astype(np.int64))], names=["label", "bin", "n"])

    kind = "label int, bin long, n long"
    every = docs.where(_part("doc_id") == CALIBRATES).mapInArrow(binned, kind).union(found.where(_part("codes") == CALIBRATES).mapInArrow(scored, kind))
    got = np.array(sorted(tuple(r) for r in every.groupBy("label", "bin").agg(F.sum("n").alias("n")).collect()), np.int64).reshape(-1, 3)
    label, weight = got[:, 0], got[:, 2].astype(float)
    if not ((label == 2).any() and (label < 2).any()):
        return None
    for k in range(3):
        weight[label == k] *= FINDINGS / PARTS / max(1.0, weight[label == k].sum())
    return fit_logistic(((got[:, 1] + 0.5) / 64)[:, None], (label == 2).astype(float), ridge=0.1, weight=weight)


def _edge(found: DataFrame, net: Network, rank: int) -> float:
    """The logit, in steps of 2**-18, that `rank` of the kept findings at most are under: bins of 1/64, then of that bin's 4096th parts."""

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(net.logits(codes), -1000, 1000) * 2.0**18).astype(np.int64))], names=["step"])

    steps = found.where(_part("codes").isin(*KEPT_PARTS)).mapInArrow(scored, "step long")

    def holds(column, rank):
        for value, n in sorted(tuple(r) for r in column.groupBy("bin").count().collect()):
            if rank < n:
                return value, rank
            rank -= n

    bins = steps.withColumn("bin", F.shiftright("step", 12))
    coarse, rank = holds(bins, rank)
    return holds(bins.where(F.col("bin") == coarse).select(F.col("step").alias("bin")), rank)[0] / 2.0**18


def fit(docs: DataFrame, sample: int = SAMPLE, recall: float = RECALL, most: int = FINDINGS) -> Network:
    """Trained, calibrated and given its threshold on all documents, from first weights by the labelled windows of about `sample`
    documents, at most `most` of each class."""
    docs = with_id(docs, "doc_id", "text")

    def findings(batches):
        for batch in chunks(batches, "text"):
            codes = {code for text in texts(batch.column("text")) for start, kind, end in base_spans(text) for code in masked(text, start, kind, end)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(codes), pa.binary())], names=["codes"])

    found = written(docs.mapInArrow(findings, "codes binary").distinct(), "findings")
    sizes = {r.part: r.n for r in found.groupBy(_part("codes").alias("part")).agg(F.count("*").alias("n")).collect()}
    kept = sum(sizes.get(p, 0) for p in KEPT_PARTS)
    taught = sum(sizes.values()) - kept - sizes.get(CALIBRATES, 0)
    net = _nothing()
    if taught and kept and sizes.get(CALIBRATES):
        codes, labels = labelled_windows(docs, sample, most)
        first = train(codes, labels >= FOUND, recall=recall)
        params = _random() if first.threshold > 1 else [first.kernel, first.bias, first.dense]
        params = _refine(docs, found, params, max(1, min(docs.count() // GROUP, taught // GROUP_FINDINGS)))
        refined = Network(*params, np.array([1.0, 0.0]), 0.5)
        curve = _calibrated(docs, found, refined)
        if curve is not None and curve[0] > 0:
            refined.calibration = curve
            edge = _edge(found, refined, int(np.floor((1 - recall) * kept)))
            refined.threshold = float(sigmoid(curve[0] * np.array([edge]) + curve[1])[0])
            net = refined
    dropped(found)
    return net


def held_out_rates(codes: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> list[tuple[str, int, float]]:
    """(kind, windows, share that reaches the threshold) for each kind, judged by a network trained on all other kinds; plain tokens
    by the network that is trained on all, so their share is no held-out figure. A kind without windows is left out."""
    out = []
    for k, name in enumerate(LABELS):
        own = labels == k
        if own.any():
            net = train(codes[~own] if k else codes, (labels[~own] if k else labels) >= FOUND, recall=recall)
            out.append((name, int(own.sum()), float((net.probability(codes[own]) >= net.threshold).mean())))
    return out


def scan(text_list: list[str], net: Network) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, as sorted (start, kind, end)."""
    base = [base_spans(t) for t in text_list]
    extra: list[list] = [[] for _ in text_list]
    if net.threshold <= 1:
        owner, codes, spans, pieces = [], [], [], []
        for i, text in enumerate(text_list):
            own = [(span, views(text, *span)) for span in candidates(text, base[i])]
            codes.append(windows(text, [v for _, some in own for v in some]))
            for span, some in own:
                owner.append(i), spans.append((span[0], 3, span[1])), pieces.append(len(some))
        if owner:
            score = np.maximum.reduceat(net.probability(np.concatenate(codes)), np.cumsum([0, *pieces[:-1]]))
            for k in np.flatnonzero(score >= net.threshold):
                extra[owner[k]].append(spans[k])
    return [(b, sorted(b + e)) for b, e in zip(base, extra)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""

    def found(batches):
        for batch in chunks(batches, "text"):
            out = scan(texts(batch.column("text")), net)
            counts = [[sum(s[1] == k for s in base) for base, _ in out] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in out], pa.string()), pa.array([joined(every) for _, every in out], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return with_id(docs, "doc_id", "text").mapInArrow(found, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, spans, mark: str = "[SECRET]") -> str:
    """The text with every maximal run of overlapping spans replaced by the mark."""
    out, at = [], 0
    end = -1
    for start, _, stop in spans:
        if start >= end:
            if end >= 0:
                out.append(mark)
            out.append(text[max(at, end if end >= 0 else 0) : start])
            at = start
        end = max(end, stop)
    if end >= 0:
        out.append(mark)
        out.append(text[end:])
        return "".join(out)
    return text


def redact_secrets(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of docs; secrets in text are replaced by a mark. A null text stays null; n_chars, where present, follows the text."""

    def clean(batches):
        for batch in chunks(batches, "text"):
            raw = texts(batch.column("text"))
            new = [redact(t, every) if every else t for t, (_, every) in zip(raw, scan(raw, net))]
            valid = batch.column("text").is_valid().to_pylist()
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array([t if v else None for t, v in zip(new, valid)], pa.string())
            if "n_chars" in columns:
                lengths = [len(t) if v else None for t, v in zip(new, valid)]
                columns["n_chars"] = pa.array([n if a != b else o for n, a, b, o in zip(lengths, new, raw, columns["n_chars"].to_pylist())], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return with_id(docs).mapInArrow(clean, docs.schema)
