"""Token ids in a binary file format: Simple-8b, word-aligned.

A 64-bit word holds a selector in its upper 4 bits and 60 bits of data: selector s packs a fixed number of
ids of a fixed width. Selector 0 is the escape: its data is the place of a whole 64-bit value among
the escapes at the end of the block. Each block of BLOCK ids starts at an offset that the segment lists, so all words
of a segment decode in bulk.

Files are Parquet tables in the shared folder: a row is a segment (whole documents in ascending order) with
its documents, their counts, the block offsets and the packed words. Documents are dealt by ranges of doc_id,
so segment (shard, seq) orders the whole corpus.

Defined cases: null text counts as empty and has the end id alone; rows without doc_id are left out; repeated rows are
stored each, ordered by text.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import Numbers, chunks, no_cycles, ragged, texts, with_id, written
from shiftlens.llm.pieces import Splitter, key_text, word_key

#: Ids in a word and their width, by selector; selector 0 is the escape.
PACKINGS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
BLOCK = 1 << 13
SEGMENT = 1 << 17
PIECES = 1_200_000


#: Widths from narrow to wide, and by number of ids in a word the selector and how many widths are wide enough for it.
_WIDTHS = [width for _, width in PACKINGS.values()]
_BY_COUNT = {count: s for s, (count, _) in PACKINGS.items()}


def pack_block(ids: np.ndarray) -> np.ndarray:
    """Words of one block, then its escapes."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # How many of the widths are too narrow for each id; beyond the block everything fits.
    need = np.zeros(n + 60, np.uint8)
    small = ids.astype(np.uint32) if ids.dtype.itemsize <= 4 or not (ids >> np.uint64(32)).any() else ids.astype(np.uint64)
    for width in _WIDTHS:
        if width < 8 * small.itemsize:
            need[:n] += small >= small.dtype.type(1 << width)
    selector, widest = np.full(n, 14, np.uint8), need[:n].copy()
    selector[widest == len(_WIDTHS)] = 0
    for count in range(2, 61):  # widest: over the next `count` ids
        np.maximum(widest, need[count - 1 : count - 1 + n], out=widest)
        if count in _BY_COUNT:
            s = _BY_COUNT[count]
            fits = widest < s
            if not fits.any():  # more ids in a word, each narrower, can't fit either
                break
            np.putmask(selector, fits, s)
    at, heads, jump = 0, [], _COUNT[selector].tolist()
    while at < n:
        heads.append(at)
        at += jump[at]
    heads = np.array(heads, np.int64)
    chosen = selector[heads]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.zeros(n + 60, np.uint64)
    padded[:n] = ids
    for s in np.unique(chosen).tolist():
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            words[rows] |= np.arange(len(rows), dtype=np.uint64)
            continue
        count, width = PACKINGS[s]
        first, packed = heads[rows], words[rows]
        for k in range(count):
            packed |= padded[first + k] << np.uint64(k * width)
        words[rows] = packed
    return np.concatenate([words, padded[heads[chosen == 0]]])


_COUNT = np.array([1] + [PACKINGS[s][0] for s in range(1, 15)] + [0], np.int64)


def unpack_words(words: np.ndarray, n: int, escapes: np.ndarray) -> np.ndarray:
    """The n ids of a block's words."""
    chosen = (words >> np.uint64(60)).astype(np.uint8)
    counts = _COUNT[chosen]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    data = words & np.uint64((1 << 60) - 1)
    for s in np.unique(chosen):
        rows = np.flatnonzero(chosen == s)
        if s == 0:
            out[starts[rows]] = escapes[data[rows].astype(np.int64)]
            continue
        count, width = PACKINGS[int(s)]
        for k in range(count):
            out[starts[rows] + k] = (data[rows] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out[:n]


def pack(ids: np.ndarray) -> tuple[bytes, list[int], list[int]]:
    """All words of a sequence of ids, the word each block starts at, and the number of escapes of each block."""
    parts, offsets, escapes, at = [], [], [], 0
    for lo in range(0, len(ids), BLOCK):
        own = ids[lo : lo + BLOCK]
        words = pack_block(own)
        offsets.append(at), escapes.append(int((own >= (1 << 60)).sum()))
        parts.append(words)
        at += len(words)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)).astype("<u8").tobytes(), offsets, escapes


def unpack(data: bytes, offsets, escapes, n: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8")
    ends = [*offsets[1:], len(words)]
    out = []
    for i, (at, end, e) in enumerate(zip(offsets, ends, escapes)):
        out.append(unpack_words(words[at : end - e], min(BLOCK, n - i * BLOCK), words[end - e : end]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


#: The character by which byte-level tokenizers write each byte: itself if it is printable, or else one from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLING = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _spells(tokenizer) -> bool:
    """Whether the tokenizer only splits texts into words and writes their bytes as characters before its model sees them."""
    before = tokenizer.pre_tokenizer and json.loads(tokenizer.pre_tokenizer.__getstate__())
    steps = before["pretokenizers"] if before and before["type"] == "Sequence" else [before]
    plain = all(step and step["type"] in ("Split", "ByteLevel") and not step.get("add_prefix_space") for step in steps)
    spelled = plain and [step["type"] for step in steps].count("ByteLevel") == 1 and steps[-1]["type"] == "ByteLevel"
    return bool(spelled and tokenizer.normalizer is None and tokenizer.truncation is None and tokenizer.padding is None)


class PieceCache:
    """Ids of whole texts by a tokenizers.Tokenizer as loaded. Texts are cut into pieces that no word crosses; a piece of one word is
    encoded once, other pieces are put together from their words'. Beyond PIECES pieces it starts anew. A text that holds one
    of the tokenizer's added tokens goes to the tokenizer as a whole."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.splitter = Splitter(pattern)
        self.spells = _spells(self.tokenizer)
        self.clear()

    def clear(self) -> None:
        """Piece number k has the ids flat[starts[k] : starts[k] + sizes[k]]."""
        self.pieces, self.starts, self.sizes, self.flat = Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, known: int) -> None:
        """Ids of all pieces from number `known` on."""
        pieces, words_of = self.pieces, self.splitter.words_of
        fresh = list(islice(pieces, known, None))
        single, several, counts, parts = [], [], [], array("q")
        for number, key in enumerate(fresh, known):
            words = None if key.isalpha() else words_of(key)
            if words is None or len(words) == 1:
                single.append(number)
            else:
                several.append(number), counts.append(len(words))
                parts.extend([pieces[word_key(w)] for w in words])
        single += range(known + len(fresh), len(pieces))
        fresh += islice(pieces, known + len(fresh), None)
        coded = self.words([key_text(fresh[k - known]) for k in single])
        starts, sizes = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)

        def put(numbers, own_sizes, ids):
            at = np.array(numbers, np.int64) - known
            sizes[at], starts[at] = own_sizes, len(self.flat) + np.cumsum(own_sizes) - own_sizes
            self.flat = np.concatenate([self.flat, ids])

        put(single, np.fromiter(map(len, coded), np.int64, len(coded)), np.fromiter(chain.from_iterable(coded), np.uint32))
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        own, ends = np.array(parts, np.int64), np.cumsum(counts, dtype=np.int64)
        sums = np.append(0, np.cumsum(self.sizes[own]))
        put(several, sums[ends] - sums[ends - np.array(counts, np.int64)], self.ids(own))
        self.starts[known:], self.sizes[known:] = starts, sizes

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of words. Where the tokenizer does nothing to a word but spell its bytes, its model is asked at once."""
        if not self.spells:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w.encode().decode("latin-1").translate(SPELLING))] for w in words]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[ragged(self.starts[numbers], self.sizes[numbers])]

    def encode(self, text_list: list[str]) -> list[np.ndarray]:
        with no_cycles():
            return self._encode(text_list)

    def _encode(self, text_list: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > PIECES:
            self.clear()
        known, number = len(self.pieces), self.pieces.__getitem__
        out: list[np.ndarray] = []
        for text in text_list:
            if any(t in text for t in self.added):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            keys = self.splitter.pieces(text)
            out.append(np.fromiter(map(number, keys), np.int64, len(keys)))
        if len(self.pieces) > known:
            self.learn(known)
        return [x if x.dtype == np.uint32 else self.ids(x) for x in out]


_CACHES: dict[tuple[str, str], PieceCache] = {}


def _cache(path: str, pattern: str) -> PieceCache:
    """The worker's cache; a worker is used for task after task."""
    if (path, pattern) not in _CACHES:
        _CACHES[path, pattern] = PieceCache(path, pattern)
    return _CACHES[path, pattern]


SEGMENTS = "shard int, seq int, first_id long, doc_ids array<long>, counts array<long>, offsets array<long>, escapes array<int>, data binary"


def write_tokens(docs: DataFrame, path: str, pattern: str, end_id: int = 2) -> DataFrame:
    """Encode every text, append end_id, and write segments in ascending doc_id order; returns the stored table."""
    ordered = with_id(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def segments(batches):
        cache, shard = _cache(path, pattern), TaskContext.get().partitionId()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary())
        names = [part.split()[0] for part in SEGMENTS.split(", ")]
        ids, held, size, seq, first = [], [], 0, 0, 0

        def row():
            data, offsets, escapes = pack(np.concatenate(held))
            values = (shard, seq, first, ids, [len(x) for x in held], offsets, escapes, data)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in chunks(batches, "text", 2 << 20):
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), cache.encode(texts(batch.column("text")))):
                ids.append(doc_id), held.append(np.append(own, np.uint32(end_id)))
                size += len(own) + 1
                if size >= SEGMENT:
                    yield row()
                    ids, held, first, seq, size = [], [], first + size, seq + 1, 0
        if ids:
            yield row()

    return written(ordered.mapInArrow(segments, SEGMENTS), "tokens")


def read_tokens(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the stored segments."""
    totals = stored.groupBy("shard").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n")).orderBy("shard").collect()
    base, at = {}, 0
    for row in totals:  # one small row for each shard, that is for each task of the writer
        base[row.shard] = at
        at += row.n

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                counts = np.array(r["counts"], np.int64)
                ids = unpack(r["data"], r["offsets"], r["escapes"], int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(base[r["shard"]] + r["first_id"] + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
