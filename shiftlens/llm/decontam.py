"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with runs of white space as one space, as UTF-8 bytes. A window of
WINDOW bytes starts at every byte of each benchmark item (a shorter item is one window); a document is contaminated by
an item if some window occurs in it with at most a tenth of the window's length in edits. A
region within e edits of a window of w bytes shares at least w + 1 - q (e + 1) of its q-grams, on diagonals at most e
apart. So shared q-grams of whole items are counted in overlapping diagonal bands, stretches of bands that meet the bound are kept,
and a banded alignment verifies their windows. Q-grams that very many places hold are not counted where the
bound of each window there, lowered by their number, is still positive: no region is lost by that.

The benchmark is taken in blocks of bounded size, each against all documents. Between blocks the documents and what was found
are written, so that a task holds one index at a time, however many blocks there are.

Defined cases: null text counts as empty and matches nothing; items shorter than SHORTEST bytes
contaminate where they occur byte for byte, empty ones nothing; repeated items count by id; rows without doc_id are left out; repeated rows are judged each;
an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import chunks, dropped, ragged, texts, with_id, written
from shiftlens.llm.substrings import sliding_min

Q, WINDOW, SHORTEST, EDITS = 8, 96, 40, 0.1
BAND = 16
#: Places a window's q-grams start at; bytes between items, so that no window holds two.
SPAN, GAP = WINDOW - Q + 1, 2 * WINDOW
BLOCK_BYTES = 16 << 20
COMMON = 12
POSTINGS = 4 << 20
BITS = 20


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    one = data.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


def _slot(g: np.ndarray) -> np.ndarray:
    return ((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)


class Index:
    """The text of benchmark items, GAP apart, and where each q-gram occurs in it; a window starts at every byte of an item."""

    def __init__(self, items: list[tuple[int, str]]):
        whole, self.short = [], {}
        for item, text in items:
            raw = normal(text)
            if len(raw) >= SHORTEST:
                whole.append((item, np.frombuffer(raw, np.uint8)))
            elif raw:
                self.short.setdefault(len(raw), {}).setdefault(raw, []).append(item)
        self.tails = {size: np.unique(np.concatenate([grams(np.frombuffer(raw[-Q:].ljust(Q, b"\0"), np.uint8)) for raw in own])) for size, own in self.short.items()}
        self.heads = {size: np.unique(np.concatenate([grams(np.frombuffer(raw[:Q].ljust(Q, b"\0"), np.uint8)) for raw in own])) for size, own in self.short.items()}
        self.items = np.array([item for item, _ in whole], np.int64)
        lengths = np.array([len(raw) for _, raw in whole], np.int64)
        self.starts = np.cumsum(lengths + GAP) - lengths - GAP
        self.sizes = np.minimum(lengths, WINDOW)
        self.edits = (self.sizes * EDITS).astype(np.int64)
        self.lasts = self.starts + lengths - self.sizes
        self.wide = int((lengths + GAP).sum()) + GAP
        self.text = np.zeros(self.wide, np.uint8)
        for at, (_, raw) in zip(self.starts.tolist(), whole):
            self.text[at : at + len(raw)] = raw
        place = ragged(self.starts, lengths - Q + 1)
        g = np.concatenate([grams(raw) for _, raw in whole]) if whole else np.zeros(0, np.uint64)
        _, number, count = np.unique(g, return_inverse=True, return_counts=True)
        common = np.zeros(self.wide + 1, np.int64)
        common[place + 1] = count[number] > COMMON
        before = np.cumsum(common)
        # Windows by the place they start at; those that can spare their common q-grams need fewer of the others.
        first = ragged(self.starts, lengths - self.sizes + 1)
        size = np.repeat(self.sizes, lengths - self.sizes + 1)
        need = size + 1 - Q * (np.repeat(self.edits, lengths - self.sizes + 1) + 1)
        lost = before[first + size - Q + 1] - before[first]
        spared = need - lost >= 1
        # Of the windows that hold a place, the least need, and whether one can't spare its common q-grams.
        low = np.full(self.wide + SPAN - 1, 1 << 14, np.int16)
        low[first + SPAN - 1] = np.where(spared, need - lost, need)
        self.low = sliding_min(low, SPAN)
        bound = np.zeros(self.wide + SPAN - 1, np.int8)
        bound[first + SPAN - 1] = np.where(spared, 0, -1)
        bound = sliding_min(bound, SPAN) < 0
        kept = ~(common[place + 1] > 0) | bound[place]
        g, place = g[kept], place[kept]
        order = np.argsort(g, kind="stable")
        self.place = place[order]
        self.grams, self.begin = np.unique(g[order], return_index=True)
        self.begin = np.append(self.begin, len(self.place))
        self.filter = np.zeros(1 << BITS, bool)
        self.filter[_slot(self.grams)] = True

    def regions(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, band) pairs from which on shared q-grams meet the bound; band b is the diagonals from (b - 1) BAND to (b + 1) BAND."""
        n = self.begin[slot + 1] - self.begin[slot]
        place = self.place[np.arange(int(n.sum())) + np.repeat(self.begin[slot] - (np.cumsum(n) - n), n)]
        band = (np.repeat(at, n) - place + self.wide) // BAND
        key = np.concatenate([band, band + 1]) * self.wide + np.concatenate([place, place])
        key = np.unique(key)
        count = np.searchsorted(key, key + SPAN - 1, "right") - np.arange(len(key))
        key = key[count >= self.low[key % self.wide]]
        return key % self.wide, key // self.wide

    def shared(self, data: np.ndarray):
        """Places of data whose q-gram is in the index, and its number there, in parts of about POSTINGS pairs; parts overlap by more than a match."""
        g = grams(data)
        if not len(self.grams) or not len(g):
            return
        at = np.flatnonzero(self.filter[_slot(g)])
        slot = np.searchsorted(self.grams, g[at])
        same = self.grams[np.minimum(slot, len(self.grams) - 1)] == g[at]
        at, slot = at[same], slot[same]
        total = np.cumsum(self.begin[slot + 1] - self.begin[slot])
        lo = 0
        while lo < len(at):
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + POSTINGS, "right"))
            hi = max(hi, int(np.searchsorted(at, at[lo] + 4 * WINDOW)))
            yield at[lo:hi], slot[lo:hi]
            if hi >= len(at):
                return
            lo = int(np.searchsorted(at, at[hi] - 2 * WINDOW))

    def distances(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, band: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least edits of the windows that start at `first`, on the band's diagonals in data[lo:hi], a document."""
        most = int(self.edits.max())
        begin = first + (band - 1) * BAND - self.wide - most
        width = 2 * BAND + 2 * most + 1
        at = begin[:, None] + np.arange(WINDOW + width)
        text = np.where((at >= lo[:, None]) & (at < hi[:, None]), data[np.clip(at, 0, len(data) - 1)].astype(np.int16), -1)
        pattern = self.text[first[:, None] + np.arange(WINDOW)]
        shift = np.arange(width, dtype=np.int16)
        cost = np.zeros((len(first), width), np.int16)
        result = np.full(len(first), 1 << 14, np.int64)
        for i in range(WINDOW):
            row = cost + (text[:, i : i + width] != pattern[:, i : i + 1])
            row[:, :-1] = np.minimum(row[:, :-1], cost[:, 1:] + 1)
            cost = (np.minimum.accumulate(row - shift, axis=1) + shift).astype(np.int16)
            done = size == i + 1
            if done.any():
                result[done] = cost[done].min(1)
        return result

    def stretches(self, place: np.ndarray, band: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """Windows to verify: document, item, band, and the first and the last place they start at."""
        # A band can touch several short documents: each is judged by itself.
        low = place + (band - 1) * BAND - self.wide
        first = np.maximum(np.searchsorted(starts, low, "right") - 1, 0)
        last = np.searchsorted(starts, low + 2 * BAND, "right") - 1
        n = np.maximum(last - first + 1, 0)
        doc = ragged(first, n)
        place, band = np.repeat(place, n), np.repeat(band, n)
        item = np.searchsorted(self.starts, place, "right") - 1
        enough = sizes[doc] >= self.sizes[item] - self.edits[item]
        place, band, doc, item = place[enough], band[enough], doc[enough], item[enough]
        order = np.lexsort((place, item, band, doc))
        place, band, doc, item = place[order], band[order], doc[order], item[order]
        lo, hi = np.maximum(place - SPAN + 1, self.starts[item]), np.minimum(place, self.lasts[item])
        new = np.ones(len(place), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (band[1:] != band[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1] + 1)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(place)) - 1
        return doc[at], item[at], band[at], lo[at], hi[end if len(at) else at]

    def verify(self, data: np.ndarray, place: np.ndarray, band: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: list[set[int]]) -> None:
        """Add to out the items of which some window is in a document within its edit budget.

        Windows k bytes apart differ by k edits at most on the same diagonals, so one with d edits too many shows that the next d - 1 don't match."""
        doc, item, band, at, end = self.stretches(place, band, starts, sizes)
        while len(at):
            good = np.zeros(len(at), bool)
            step = np.zeros(len(at), np.int64)
            for part in np.array_split(np.arange(len(at)), -(-len(at) // 2000)):
                d, i = doc[part], item[part]
                over = self.distances(data, at[part], self.sizes[i], band[part], starts[d], starts[d] + sizes[d]) - self.edits[i]
                good[part], step[part] = over <= 0, np.maximum(over, 1)
            for d, i in zip(doc[good].tolist(), self.items[item[good]].tolist()):
                out[d].add(i)
            at = at + step
            pair = doc * len(self.items) + item
            left = (at <= end) & ~np.isin(pair, pair[good])
            doc, item, band, at, end = doc[left], item[left], band[left], at[left], end[left]

    def exact(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, out: list[set[int]]) -> None:
        """Add to out the items of less than SHORTEST bytes that a document holds byte for byte."""
        if not self.short:
            return
        raw = data.tobytes()
        g = grams(np.concatenate([data, np.zeros(Q, np.uint8)]))
        for size, own in self.short.items():
            if size < Q:
                at = np.flatnonzero(np.isin(g & np.uint64((1 << 8 * size) - 1), self.heads[size]))
            else:
                at = np.flatnonzero(np.isin(g[: len(data) - size + Q], self.heads[size]))
                at = at[at + size <= len(data)]
                at = at[np.isin(g[at + size - Q], self.tails[size])]
            doc = np.searchsorted(starts, at, "right") - 1
            inside = at + size <= starts[doc] + sizes[doc]
            for d, p in zip(doc[inside].tolist(), at[inside].tolist()):
                out[d].update(own.get(raw[p : p + size], ()))

    def matches(self, raw: list[bytes]) -> list[list[int]]:
        """For each normal text, the items that contaminate it, sorted."""
        out: list[set[int]] = [set() for _ in raw]
        data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        sizes = np.array([len(r) for r in raw], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        for at, slot in self.shared(data):
            place, band = self.regions(at, slot)
            if len(place):
                self.verify(data, place, band, starts, sizes, out)
        self.exact(data, starts, sizes, out)
        return [sorted(x) for x in out]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Indexes of the benchmark, block by block; each block's texts have about block_bytes."""
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        yield Index(sorted((r.item_id, r.text) for r in rows))


def _by_block(docs: DataFrame, benchmark: DataFrame, block_bytes: int, made, schema) -> DataFrame:
    """docs after made(index) of every block as a stage of Arrow batches. A block's result is written before the next block's
    index is made, and the written table before it goes once it has been read."""
    last = shared = None
    for index in blocks(benchmark, block_bytes):
        if shared is not None:
            done = written(docs, "block")
            shared.unpersist()
            if last is not None:
                dropped(last)
            docs = last = done
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.mapInArrow(made(shared), schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items and items (ids, joined by commas) of every document."""
    out = with_id(docs, "doc_id", "text").withColumn("items", F.lit("").cast("string"))
    out = _by_block(out, benchmark, block_bytes, _adder, "doc_id long, text string, items string")
    listed = F.array_sort(F.array_distinct(F.filter(F.split("items", ","), lambda x: x != "").cast("array<long>")))
    return out.select("doc_id", listed.alias("__items")).select("doc_id", (F.size("__items") > 0).alias("contaminated"), F.size("__items").alias("n_items"), F.concat_ws(",", F.col("__items").cast("array<string>")).alias("items"))


def _adder(shared):
    def add(batches):
        for batch in chunks(batches, "text", 1 << 20):
            found = shared.value.matches([normal(t) for t in texts(batch.column("text"))])
            items = [",".join([old, *map(str, new)]) if new else old for old, new in zip(batch.column("items").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text").cast(pa.string()), pa.array(items, pa.string())], names=["doc_id", "text", "items"])

    return add


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""

    def cleaner(shared):
        def clean(batches):
            for batch in chunks(batches, "text", 1 << 20):
                found = shared.value.matches([normal(t) for t in texts(batch.column("text"))])
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        return clean

    return _by_block(with_id(docs), benchmark, block_bytes, cleaner, docs.schema)
