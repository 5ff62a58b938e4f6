"""Removal of repeated byte strings with a sampled suffix array.

A byte is removed if a string of `length` bytes that covers it also starts earlier in the corpus. The suffix array is sampled at
content-defined anchors: the anchor of a place is the TOKEN-byte token of least hash inside its window (the leftmost of
equals), so equal windows have equal tokens at equal distances, and neighbouring places mostly share one. A suffix row is
the run of places that share one anchor: where it starts, how many places, the leading bytes of the suffix at the anchor, and
hashes of its token, of all its windows, and of the bytes on either side of the token.

Sampled splitters range-partition the rows by the leading bytes of their suffixes (then by the hashes, so that one hot token may
take many ranges); a range is a task. Each bucket sorts by multikey quicksort. Of rows that are equal in all keys all but
the first are repeats. Neighbours that share a token without being equal may still share windows: they are kept for a
second round if the bytes on one side agree, too (every window reaches HALF bytes beyond its token on one of them). A token that
a splitter cuts goes on in the next bucket, so all its rows are kept: this is the comparison across boundaries. The
second round compares these rows window by window, by two independent 64-bit hashes, in buckets of hash ranges.

Before any shuffle, each FLUSH of rows keeps only its first row of equal keys; later ones are repeats already, and are merged into
runs of neighbouring places and dealt by place. Rows travel in blocks, one for each bucket, column by column and byte by byte.

Defined cases: null text counts as empty; texts shorter than `length` keep every byte; rows without doc_id are left out; rows that
repeat a doc_id have equal places, and equal places don't repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import chunks, mix64, planes, ragged, release, unplaned, utf8, with_id, written

TOKEN = 32
SAMPLE_DOCS, SAMPLE_ROWS = 2000, 100_000
#: Rows that a task holds before it sends them, and rows that a bucket is meant to hold.
FLUSH, BUCKET_ROWS = 1 << 18, 1 << 20
#: Bytes of a document that are looked at together.
STEP = 1 << 21
#: Rows up to which a segment is sorted whole.
SEGMENT = 1 << 14
_TABLE = np.random.default_rng(9).integers(1, 1 << 63, 256).astype(np.uint64)
_BASES = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _power(n: int, base: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def string_hashes(data: np.ndarray, sizes: list[int], base: int = _BASES[0]) -> list[np.ndarray]:
    """For each size the hashes of the strings of so many bytes at each place."""
    have, size = {1: _TABLE[data]}, 1
    while size * 2 <= max(sizes):
        x = have[size]
        have[size * 2] = x[:-size] * _power(size, base) + x[size:] if len(x) > size else x[:0]
        size *= 2
    out = []
    for want in sizes:
        whole, done = None, 0
        for size in sorted(have, reverse=True):
            if want & size:
                x = have[size]
                n = max(0, len(data) - done - size + 1)
                whole = x[:n] if whole is None else whole[:n] * _power(size, base) + x[done : done + n]
                done += size
        out.append(np.zeros(len(data) + 1, np.uint64) if whole is None else whole)
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    if len(x) < n:
        return x[:0]
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = n - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


#: A suffix row: leading bytes, token, all windows, sides, document, offset, number of places.
KINDS = [np.uint64, np.uint64, np.uint64, np.uint16, np.uint16, np.int64, np.int64, np.int32]
NONE = [np.zeros(0, k) for k in KINDS]


def _side(hashes: np.ndarray, at: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """1 to 65535 by the string at `at` where a window reaches it, else 0."""
    out = np.zeros(len(at), np.uint16)
    out[reached] = mix64(hashes[at[reached]]) % np.uint64(65535) + np.uint64(1)
    return out


def runs(data: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Suffix rows of a chunk (KINDS); a document is its place in the chunk."""
    sizes = np.maximum(np.diff(starts) - length + 1, 0)
    place = ragged(starts[:-1], sizes)
    if not len(place):
        return NONE
    half = (length - TOKEN) // 2
    token, beside, window = string_hashes(data, [TOKEN, half, length])
    token = mix64(token)
    # The upper half of a token's hash decides, then the leftmost place: both follow from the window alone.
    spot = (token >> np.uint64(32) << np.uint64(32)) | np.arange(len(token), dtype=np.uint64)
    anchor = (sliding_min(spot, length - TOKEN + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    chosen = anchor[place]
    new = np.ones(len(place), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(place)))
    value = window[place]
    whole = np.add.reduceat(value * (value >> np.uint64(31) | np.uint64(1)), first) + value[first] * np.uint64(3) + n.astype(np.uint64)
    at, begin, doc = chosen[first], place[first], doc[first]
    far = at - begin  # how far the first window of the run lies ahead of its token
    left, right = _side(beside, at - half, far >= half), _side(beside, at + TOKEN, far - n + 1 < half)
    return [leading(data, at), token[at] & np.uint64((1 << 40) - 1), mix64(whole), left, right, doc, begin - starts[doc], n.astype(np.int32)]


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the suffixes at these places, as numbers in the order of the bytes."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def multikey_order(*keys: np.ndarray) -> np.ndarray:
    """Multikey quicksort: rows are split by a pivot of their first key into less, equal and greater; equal ones go on with the next
    key. Segments of at most SEGMENT rows are sorted at once by the keys that are left."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(keys):
            continue
        rows = order[lo:hi]
        if hi - lo <= SEGMENT:
            order[lo:hi] = rows[np.lexsort([k[rows] for k in keys[:depth:-1]] + [keys[depth][rows]])]
            continue
        key = keys[depth][rows]
        pivot = np.sort(key[:: len(key) // 255])[127]
        less, equal = key < pivot, key == pivot
        parts = rows[less], rows[equal], rows[~(less | equal)]
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), hi - len(parts[2])
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def _repeats(keys: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray):
    """Order of rows; for each row in that order, whether it heads its keys, and whether it comes later than the head's place."""
    order = multikey_order(*keys, doc, at)
    head = np.ones(len(order), bool)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    head[1:] = ~same
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    later = (doc[order] != doc[order[lead]]) | (at[order] != at[order[lead]])
    return order, head, later


def _bucket(splitters: tuple[np.ndarray, ...], *keys: np.ndarray) -> np.ndarray:
    """How many splitters are at most the keys of each row, in the order of the first key, then of the next ones."""
    lo, hi = np.searchsorted(splitters[0], keys[0], "left"), np.searchsorted(splitters[0], keys[0], "right")
    tied = np.flatnonzero(lo < hi)
    if len(tied) and len(keys) > 1:
        begin, end = lo[tied], hi[tied]
        for a in np.unique(begin).tolist():  # rows whose first key is a splitter's
            rows = tied[begin == a]
            b = int(end[begin == a][0])
            lo[rows] = a + _bucket(tuple(s[a:b] for s in splitters[1:]), *(k[rows] for k in keys[1:]))
        return lo
    return hi


def spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of stretches of 4,096 bytes of a document: known repeats of one key are dealt evenly by it."""
    return mix64(mix64(doc.astype(np.uint64)) + (at.astype(np.uint64) >> np.uint64(12)))


FOUND = "kind int, doc_id long, at long, n long"
BLOCKS = "bucket int, known int, n int, block binary"


def _found(kind, doc, at, n):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind), pa.int32()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["kind", "doc_id", "at", "n"])


def merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray):
    """Runs of places, with neighbouring and overlapping ones joined."""
    if not len(doc):
        return doc, at, n
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + n)[order]
    # Ends grow within a document where runs don't lie inside each other; the running maximum makes sure of it.
    shift = np.cumsum(np.append(False, doc[1:] != doc[:-1])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (at + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first], (reach[last] - shift[last]) - at[first]


def _blocks(bucket: np.ndarray, known: int, columns: list[np.ndarray]):
    """Batches with a block of the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    for at in range(0, len(first), 64):
        lo, hi = first[at : at + 64], np.append(first, len(bucket))[at + 1 : at + 65]
        data = [planes(*(c[a:b] for c in columns)) for a, b in zip(lo, hi)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[lo].astype(np.int32)), pa.array(np.full(len(lo), known, np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "known", "n", "block"])


def _gather(batches, kinds):
    """All rows of a bucket: those to compare, and the runs that are repeats already."""
    rows, known = [], []
    for batch in batches:
        for is_known, n, block in zip(batch.column("known").to_pylist(), batch.column("n").to_pylist(), batch.column("block")):
            (known if is_known else rows).append(unplaned(block.as_buffer(), n, RUN if is_known else kinds))
    join = lambda parts, kinds: [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]
    return join(rows, kinds), join(known, RUN)


RUN = [np.int64, np.int64, np.int64]


def _sent(keys: list[np.ndarray], more: list[np.ndarray], n: np.ndarray, bucket, buckets: int):
    """Blocks of the first row of equal keys (more: other columns, the last two document and offset), and of the runs of the others."""
    order, head, later = _repeats(tuple(keys), *more[-2:])
    again = order[later & ~head]
    order = order[head]
    yield from _blocks(bucket(*(k[order] for k in keys)), 0, [c[order] for c in (*keys, *more, *([n] if n is not None else []))])
    doc, at, size = merged(more[-2][again], more[-1][again], n[again].astype(np.int64) if n is not None else np.ones(len(again), np.int64))
    yield from _blocks((spread(doc, at) % np.uint64(buckets)).astype(np.int64), 1, [doc, at, size])


def chunk_rows(batches, length: int, rows: int = FLUSH):
    """Suffix rows of about `rows` at a time."""
    held, size = [], 0
    for batch in chunks(batches, "text", 1 << 20):
        ids = batch.column("doc_id").to_numpy().astype(np.int64)
        data, starts = utf8(batch.column("text"))
        # A chunk is one long document, or all of it is short. A run that is cut here is compared in the second round.
        for lo in range(0, len(data), STEP) if len(ids) == 1 else (0,):
            part, bounds = (data[lo : lo + STEP + length - 1], None) if len(ids) == 1 else (data, starts)
            own = runs(part, np.array([0, len(part)]) if bounds is None else bounds, length)
            if len(own[0]):
                own[5], own[6] = ids[own[5]], own[6] + lo
                held.append(own)
                size += len(own[0])
            if size >= rows:
                yield [np.concatenate(c) for c in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def suffix_rows(docs: DataFrame, length: int, splitters, buckets: int) -> DataFrame:
    """Blocks of suffix rows by bucket; known: runs that are repeats already, dealt by place and not by their keys."""

    def made(batches):
        for lead, token, whole, left, right, doc, at, n in chunk_rows(batches, length):
            yield from _sent([lead, token, whole], [left, right, doc, at], n, lambda *keys: _bucket(splitters, *keys), buckets)

    return docs.mapInArrow(made, BLOCKS)


def sample_splitters(docs: DataFrame, length: int, least: int):
    """Splitters from the rows of about SAMPLE_DOCS documents, at most SAMPLE_ROWS rows, and the number of buckets: `least`,
    or as many as the estimated number of rows asks for."""
    total = docs.count()
    every = max(1, total // SAMPLE_DOCS)
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def made(batches):
        for lead, token, whole, *_ in chunk_rows(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (lead, token, whole)], names=["lead", "token", "whole"])

    sample = written(part.mapInArrow(made, "lead long, token long, whole long").distinct(), "sample")
    n = sample.count()
    buckets = max(least, n * every // BUCKET_ROWS + 1)
    got = sample.orderBy(F.xxhash64("token", "whole")).limit(SAMPLE_ROWS).toArrow()
    keys = [got.column(c).to_numpy().view(np.uint64) for c in ("lead", "token", "whole")]
    order = multikey_order(*keys)
    at = order[np.linspace(0, len(order) - 1, buckets + 1).astype(int)[1:-1]] if len(order) else order
    return tuple(k[at] for k in keys), buckets


def sorted_buckets(blocks: DataFrame, splitters, buckets: int) -> DataFrame:
    """Kind 1: repeats. Kind 2: rows to compare window by window. Rows that need neither are gone."""

    def local(batches):
        (lead, token, whole, left, right, doc, at, n), known = _gather(batches, KINDS)
        n = n.astype(np.int64)
        order, head, later = _repeats((lead, token, whole), doc, at)
        repeat = order[later & ~head]
        yield _found(1, *merged(*(np.concatenate([a, b]) for a, b in zip(known, (doc[repeat], at[repeat], n[repeat])))))
        rest = order[head]
        if not len(rest):
            return
        new = np.ones(len(rest), bool)
        new[1:] = (lead[rest[1:]] != lead[rest[:-1]]) | (token[rest[1:]] != token[rest[:-1]])
        group = np.cumsum(new) - 1
        mixed = np.zeros(len(rest), bool)
        for side in (left, right):
            own = np.flatnonzero(side[rest] > 0)
            key = group[own] * 65536 + side[rest[own]]
            _, back, count = np.unique(key, return_inverse=True, return_counts=True)
            mixed[own] |= count[back] > 1
        # A token that a splitter cuts has rows in the next bucket, too.
        for k in range(len(splitters[0])):
            a, b = np.searchsorted(lead[rest], splitters[0][k], "left"), np.searchsorted(lead[rest], splitters[0][k], "right")
            mixed[a:b] |= token[rest[a:b]] == splitters[1][k]
        rest = rest[mixed]
        yield _found(2, doc[rest], at[rest], n[rest])

    return blocks.repartitionById(buckets, "bucket").drop("bucket").mapInArrow(local, FOUND)


def window_rows(docs: DataFrame, runs_to_compare: DataFrame, length: int, buckets: int) -> DataFrame:
    """Repeats among the windows of the given runs."""
    lists = runs_to_compare.groupBy("doc_id").agg(F.collect_set(F.struct("at", "n")).alias("runs"))
    kinds = [np.uint64, np.uint64, np.int64, np.int64]

    def windows(batches):
        for batch in chunks(batches, "text", 1 << 20):
            data, starts = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            lists = batch.column("runs")
            flat = lists.flatten()
            owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy()
            # The bytes of the runs, one after the other, are hashed; a window never leaves its run's bytes.
            size = n.astype(np.int64) + length - 1
            group = np.cumsum(size) // STEP
            for g in np.unique(group).tolist():
                own = slice(*np.searchsorted(group, [g, g + 1]))
                part = data[ragged(starts[owner[own]] + at[own], size[own])]
                place = ragged(np.cumsum(size[own]) - size[own], n[own])
                one, two = (mix64(string_hashes(part, [length], base)[0][place]) for base in _BASES)
                yield one, two, np.repeat(ids[owner[own]], n[own]), ragged(at[own], n[own])

    def made(batches):
        held, size = [], 0
        bucket = lambda one, two: (one >> np.uint64(40)).astype(np.int64) * buckets >> 24
        send = lambda: _sent(*(lambda one, two, doc, at: ([one, two], [doc, at]))(*(np.concatenate(c) for c in zip(*held))), None, bucket, buckets)
        for rows in windows(batches):
            held.append(rows)
            size += len(rows[0])
            if size >= 2 * FLUSH:
                yield from send()
                held, size = [], 0
        if held:
            yield from send()

    def local(batches):
        (one, two, doc, at), known = _gather(batches, kinds)
        order, head, later = _repeats((one, two), doc, at)
        repeat = order[later & ~head]
        found = doc[repeat], at[repeat], np.ones(len(repeat), np.int64)
        yield _found(1, *merged(*(np.concatenate([a, b]) for a, b in zip(known, found))))

    rows = docs.join(lists, "doc_id").select("doc_id", "text", "runs").mapInArrow(made, BLOCKS)
    return rows.repartitionById(buckets, "bucket").drop("bucket").mapInArrow(local, FOUND)


def repeated_places(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, at, n): places at .. at + n - 1 of a document start a string that also starts earlier. Written."""
    spark = docs.sparkSession
    docs = with_id(docs, "doc_id", "text")
    least = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters, buckets = sample_splitters(docs, length, least)
    found = written(sorted_buckets(suffix_rows(docs, length, splitters, buckets), splitters, buckets), "suffixes")
    release(spark)
    windows = written(window_rows(docs, found.where("kind = 2"), length, buckets), "windows")
    release(spark)
    return found.where("kind = 1").union(windows).select("doc_id", "at", "n")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the kept bytes' text where it is valid."""
    docs = with_id(docs, "doc_id", "text")
    lists = repeated_places(docs, length).groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("places"))

    def cut(batches):
        for batch in chunks(batches, "text", 2 << 20):
            data, starts = utf8(batch.column("text"))
            rows = []
            for i, places in enumerate(batch.column("places")):
                raw = data[starts[i] : starts[i + 1]]
                if not places.is_valid or not len(places.values):
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                at, n = (places.values.field(name).to_numpy() for name in ("at", "n"))
                _, at, n = merged(np.zeros(len(at), np.int64), at, n + length - 1)
                digest, kept = hashlib.sha256(), 0
                for begin, end in zip(at.tolist(), (at + n).tolist()):
                    digest.update(raw[kept:begin])
                    kept = end
                digest.update(raw[kept:])
                rows.append((len(raw), int(n.sum()), len(at), digest.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.join(lists, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
