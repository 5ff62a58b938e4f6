"""Near duplicates by MinHash with sequential Bayesian verification.

A document's set is its distinct word shingles. Documents with equal sets are one class, so copies are never
paired. Signatures of class representatives are cut into bands; two representatives that share
a band are candidates. Candidate pairs are compared batch by batch of their signatures: after each batch the posterior of
the similarity (uniform prior) bounds the chance that the pair still reaches the threshold, and pairs below
the chosen miss probability are dropped. Survivors are verified exactly on their full sets.

Not all pairs of a band's bucket are made. Two rounds link members to one head of their bucket, and
links merge into components; the last round compares only members of different components (those outside the
bucket's largest component with all others). Of those, pairs are left out only if their differences from a common
pivot prove that they differ too much. Every other pair of one bucket is therefore either compared or
already connected, and no link between different components is lost.

The chance that a pair at the threshold shares no band is (1 - t^rows)^bands: 2.5e-7 at 0.8 with 50 bands of 6.

Defined cases: null text counts as empty; a text without words has an empty set and is linked with nothing; fewer
words than a shingle make one shingle; rows without doc_id are left out; rows that repeat a doc_id are one node.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import chunks, dropped, fits_broadcast, mix64, release, utf8, with_id, written

BANDS, ROWS = 50, 6
HASHES = BANDS * ROWS
BATCH = 30
MISS = 1e-9
BROADCAST_ROWS = 1_000_000
DELTA_LONGS = 24

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 1 << 62, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_A = (_RNG.integers(1, 1 << 31, HASHES) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, HASHES).astype(np.uint32)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    n_docs = len(starts) - 1
    empty = np.zeros(0, np.uint64)
    if not len(data):
        return [empty] * n_docs
    inside = ~_SEPARATOR[data]
    border = np.zeros(len(data) + 1, bool)
    border[starts] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = np.flatnonzero(inside & (~before | border[:-1]))
    last = np.flatnonzero(inside & (~after | border[1:]))
    if not len(first):
        return [empty] * n_docs
    size = last - first + 1
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(size.max()), _BASE), dtype=np.uint64)])
    offset = np.zeros(len(data), np.int64)
    offset[inside] = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    value = np.where(inside, _BYTE[_LOWER[data]] * powers[offset], np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    word = mix64(sums[last + 1] - sums[first] + size.astype(np.uint64) * _PLACE[63])
    bounds = np.searchsorted(first, starts)
    joined = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        joined += word[k : k + len(joined)] * _PLACE[k]
    joined = mix64(joined)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            out.append(np.unique(joined[lo : hi - words + 1]))
        elif hi > lo:
            with np.errstate(over="ignore"):
                out.append(mix64((word[lo:hi] * _PLACE[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo) * _PLACE[62]))
        else:
            out.append(empty)
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of each of HASHES minima."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    narrow = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(narrow), 512):
        np.minimum(best, (_A[:, None] * narrow[None, at : at + 512] + _B[:, None]).min(1), out=best)
    return (best & np.uint32(0xFFFF)).astype("<u2")


def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """After each batch, the fewest equal hashes with which a pair may still be similar: below it, the posterior
    chance of a similarity at the threshold or above, P(Binomial(n + 1, t) <= m), is under `miss`."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log(1 - threshold))
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def features(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, and the signature of every document."""

    def made(batches):
        for batch in chunks(batches, "text", 1 << 20):
            sets = shingle_sets(*utf8(batch.column("text")), words)
            one = [int(mix64(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            two = [int(mix64(s ^ _BASE).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n", "h1", "h2", "sig"],
            )

    return with_id(docs, "doc_id", "text").mapInArrow(made, "doc_id long, n long, h1 long, h2 long, sig binary")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    def made(batches):
        for batch in chunks(batches, "text", 1 << 20):
            sets = shingle_sets(*utf8(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(made, "doc_id long, shingles binary")


def _attach(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with the column of both sides. The pairs are joined by b last: a bucket's head is a, and what is
    shuffled for it is its pairs, not copies of its own value."""
    left = values.select(F.col("doc_id").alias("b"), F.col(column).alias("y"))
    right = values.select(F.col("doc_id").alias("a"), F.col(column).alias("x"))
    return pairs.select("a", "b").join(left, "b").join(right, "a")


def likely_pairs(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Sequential Bayesian verification on signature batches."""
    least = least_matches(threshold)

    def judged(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<u2").reshape(-1, HASHES)
            y = np.frombuffer(b"".join(batch.column("y").to_pylist()), "<u2").reshape(-1, HASHES)
            alive, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal[alive] += (x[alive, part] == y[alive, part]).sum(1)
                alive = alive[equal[alive] >= need]
            kept = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(kept), batch.column("b").take(kept)], names=["a", "b"])

    return _attach(pairs, sigs, "sig").mapInArrow(judged, "a long, b long")


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    def judged(batches):
        for batch in chunks(batches, "y", 4 << 20):
            good = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return _attach(pairs, sets, "shingles").mapInArrow(judged, "a long, b long")


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node and component (its smallest node) of every node of the links (a, b), by alternating large and small stars."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # Large star: larger neighbours of each node move to the smallest node around it.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours and the node itself move to the smallest of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(moved, "edges")
        if edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def differences(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """For each document of the buckets: d, the size of its difference (either way) from a pivot that all documents of its
    buckets share; the difference as a bitmap of 64 * DELTA_LONGS bits; and excess, how many elements fell on taken bits."""
    head = buckets.groupBy("key").agg(F.min("doc_id").alias("a"))
    star = buckets.join(head, "key").select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()
    pairs = written(components(star).select(F.col("component").alias("a"), F.col("node").alias("b")), "pivots")

    def made(batches):
        for batch in chunks(batches, "y", 4 << 20):
            rows = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                delta = np.setxor1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)
                bit = np.unique((delta >> np.uint64(20)) % np.uint64(64 * DELTA_LONGS))
                flags = np.zeros(64 * DELTA_LONGS, np.uint8)
                flags[bit.astype(np.int64)] = 1
                rows.append((len(delta), len(delta) - len(bit), *np.packbits(flags).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("b"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["doc_id", "d", "excess", *(f"bits{k}" for k in range(DELTA_LONGS))])

    kinds = ", ".join(f"bits{k} long" for k in range(DELTA_LONGS))
    return written(_attach(pairs, sets, "shingles").mapInArrow(made, f"doc_id long, d long, excess long, {kinds}"), "differences")


def _near_enough(percent: int):
    """Two sets of one pivot differ by d_a + d_b - 2 c, c the elements that both differences hold, and c is at most the bits that
    both bitmaps have plus the lesser excess. Pairs that even so differ too much can't be similar: none other is dropped."""
    common = sum((F.bit_count(F.col(f"a_bits{k}").bitwiseAND(F.col(f"b_bits{k}"))) for k in range(DELTA_LONGS)), F.least("a_excess", "b_excess"))
    return (100 + percent) * (F.col("a_d") + F.col("b_d") - 2 * common) <= (100 - percent) * (F.col("a_n") + F.col("b_n"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    threshold = percent / 100
    base = written(features(docs, words), "minhash")
    classes = base.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    members = written(base.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "classes")
    reps = members.where("n > 0 and doc_id = rep").select("doc_id").distinct()
    sigs = base.where("n > 0").join(reps, "doc_id", "left_semi").select("doc_id", "n", "sig")
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring("sig", j * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = sigs.select("doc_id", "n", F.explode(keys).alias("key"))
    heads = bands.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    buckets = written(bands.join(heads, "key", "left_semi"), "buckets")
    release(docs.sparkSession)
    nodes = buckets.select("doc_id").distinct()
    few = fits_broadcast(nodes, BROADCAST_ROWS)
    nodes = F.broadcast(nodes) if few else nodes
    # A doc_id with several rows has a signature and a set of each; links of any of them are its links.
    sigs = written(base.join(nodes, "doc_id", "left_semi").select("doc_id", "sig"), "signatures")
    sets = written(full_sets(with_id(docs, "doc_id", "text").join(nodes, "doc_id", "left_semi"), words), "sets")
    del bands, heads, reps, classes
    dropped(base)

    tested = links = labels = None
    for step in ("star", "star", "rest"):
        at = buckets.withColumn("label", F.col("doc_id")) if labels is None else buckets.join(labels, buckets.doc_id == labels.node, "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("label"))
        if labels is not None:
            mixed = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
            at = written(at.join(mixed, "key", "left_semi"), "mixed")
            if at.isEmpty():
                break
        if step == "star":
            head = at.groupBy("key").agg(F.min(F.struct("label", "doc_id", "n")).alias("head"))
            pairs = at.join(head, "key").where("label <> head.label").select(F.col("head.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("head.n").alias("na"), "n")
            pairs = pairs.where(_sizes("na", "n", percent)).groupBy("a", "b").count()
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = pairs.groupBy("b").agg(F.max(F.struct("count", (-F.col("a")).alias("minus"))).alias("best")).select((-F.col("best.minus")).alias("a"), "b")
        else:
            most = at.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("most")).select("key", F.col("most.label").alias("major"))
            full = at.join(differences(at, sets), "doc_id").join(most, "key")
            names = ["doc_id", "n", "label", "d", "excess", *(f"bits{k}" for k in range(DELTA_LONGS))]
            right = full.select("key", "major", *(F.col(c).alias(f"b_{c}") for c in names))
            left = full.where("label <> major").select("key", *(F.col(c).alias(f"a_{c}") for c in names))
            pairs = left.join(right, "key").where("a_label <> b_label and (b_label = major or a_doc_id < b_doc_id)")
            pairs = pairs.where(_sizes("a_n", "b_n", percent)).where(_near_enough(percent)).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        pairs = written(pairs.select("a", "b"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        found = written(exact_links(written(likely_pairs(pairs, sigs, threshold), "likely"), sets, percent), "links")
        links = found if links is None else links.union(found)
        labels = written(components(links), "components")
        release(docs.sparkSession)
    out = members.join(labels, members.rep == labels.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _sizes(a: str, b: str, percent: int):
    """Sets can only be similar enough if their sizes are."""
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns."""
    gone = written(near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct(), "gone")
    return with_id(docs).join(F.broadcast(gone) if fits_broadcast(gone, BROADCAST_ROWS) else gone, "doc_id", "left_anti").select(*docs.columns)
