"""Byte-level BPE by Spark's higher-order functions.

Texts are split into words in bulk; each chunk of documents keeps its distinct words once, in short
rows, and refers to them by number. Words that are frequent in a bounded sample are folded once beforehand and broadcast (at
most DICTIONARY words of at most LONG bytes); all others are folded with their chunk. A character of U+0000 to U+00FF stands for a byte. A higher-order fold then merges each distinct word by
rank: the state is the array of pieces and the ranks of neighbouring pairs, the rank map is a literal
of the plan (small buckets of tokens and ranks, addressed by CRC-32). Decoding concatenates the binary pieces of
the ids. No row is shuffled.

Words over LONG bytes, where a fold over arrays would take quadratic time, are merged with a heap in Python
by the same ranks.

Defined cases: null text counts as empty and has no ids; rows without doc_id are left out; repeated rows
are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import uuid
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import KEPT, Numbers, chunks, give_back, texts, with_id
from shiftlens.llm.pieces import Splitter

BUCKETS = 1 << 14
LONG = 200
#: Characters of a chunk, distinct words of a row and words of the documents of a row.
CHUNK = 14 << 20
ROW_WORDS, ROW_TOKENS = 256, 1 << 20
#: Documents sampled for the dictionary of frequent words, and its most words.
SAMPLE, DICTIONARY = 40_000, 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _json(value) -> Column:
    # Without a lambda inside, the optimizer folds this into one literal; JSON strings read as binary are base64.
    return F.lit(json.dumps(value, separators=(",", ":")))


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """Entry crc32(token) mod BUCKETS maps the tokens of that bucket to their ranks; a character stands for a byte."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return F.from_json(_json(buckets), "array<map<string,int>>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """array<binary>: the bytes of each id."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = base64.b64encode(token).decode()
    return F.from_json(_json(pieces), "array<binary>")


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once and nothing copied."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def encode_word(word: Column, table: Column) -> Column:
    """Ids of one word of 1 to LONG bytes (as characters): the whole word if it has a rank, or else a fold of merges.

    The state is where pieces start, and rank * 256 + start of each neighbouring pair that has a rank: the least of these
    is the next merge, the leftmost among equal ranks."""

    def rank(token: Column) -> Column:
        return F.element_at(F.get(table, (F.crc32(token) % BUCKETS).cast("int")), token)

    def pair(start: Column, end: Column) -> Column:
        return rank(F.substring(word, start + 1, end - start)) * 256 + start

    def merge(state: Column, at: Column, later: Column) -> Column:
        starts = state["starts"]
        gone, end, after = (F.get(later, F.lit(k)) for k in range(3))
        before = F.get(starts, F.size(starts) - F.size(later) - 2)
        others = F.filter(state["pairs"], lambda x: ~(x % 256).isin(at, gone, F.coalesce(before, at)))
        return F.struct(F.array_remove(starts, gone).alias("starts"), F.array_append(F.array_append(others, pair(before, end)), pair(at, after)).alias("pairs"))

    def step(state: Column, _: Column) -> Column:
        best = F.array_min(state["pairs"])
        return F.when(best.isNull(), state).otherwise(_let(best % 256, lambda at: _let(F.filter(state["starts"], lambda x: x > at), lambda later: merge(state, at, later))))

    n = F.length(word)
    zero = F.struct(F.sequence(F.lit(0), n).alias("starts"), F.transform(F.sequence(F.lit(0), n - 2), lambda i: pair(i, i + 2)).alias("pairs"))

    def ids(state: Column) -> Column:
        starts = state["starts"]
        return F.transform(F.slice(starts, 1, F.size(starts) - 1), lambda start, i: rank(F.substring(word, start + 1, F.get(starts, i + 1) - start)))

    fold = F.aggregate(F.sequence(F.lit(2), n), zero, step, ids)
    return _let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(fold))


def decode_ids(ids: Column, pieces: Column) -> Column:
    return F.aggregate(ids, F.lit(b""), lambda out, i: F.concat(out, F.get(pieces, i)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a long word: a heap of candidate merges over a linked list of pieces; lowest rank first, then leftmost."""
    if word in ranks:
        return [ranks[word]]
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < len(pieces):
            joined = pieces[i] + pieces[after[i]]
            if joined in ranks:
                heapq.heappush(heap, (ranks[joined], i, joined))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if pieces[i] is None or after[i] >= len(pieces) or pieces[i] + pieces[after[i]] != joined:
            continue
        gone = after[i]
        pieces[i], pieces[gone] = joined, None
        after[i] = after[gone]
        if after[i] < len(pieces):
            before[after[i]] = i
        offer(before[i]), offer(i)
    return [ranks[p] for p in pieces if p is not None]


@dataclass
class Dictionary:
    """Frequent words and what the fold makes of them. Every worker holds it once; it changes no result."""

    words: list[str]
    n: list[int]
    said: list[str]
    raw: list[bytes]


def _numbered(key: int, held) -> dict[str, int]:
    """The worker's own numbering of the broadcast words; a worker is used for task after task."""
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = {word: i for i, word in enumerate(held.value)}
    return KEPT[key]


def _coded(ranks: dict[bytes, int], words: str) -> Column:
    """For each word of the column (characters for bytes; null: null) the number of ids, the ids as text and the decoded
    bytes, all by higher-order functions."""

    def all_words(table: Column, pieces: Column) -> Column:
        return F.transform(
            words,
            lambda w: F.when(w.isNotNull(), _let(encode_word(w, table), lambda ids: F.struct(F.size(ids).alias("n"), F.array_join(ids.cast("array<string>"), ",").alias("ids"), decode_ids(ids, pieces).alias("bytes")))),
        )

    # Both literals are bound once for each row.
    return _let(F.struct(rank_literal(ranks).alias("table"), piece_literal(ranks).alias("pieces")), lambda t: all_words(t["table"], t["pieces"]))


def frequent_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, sample: int = SAMPLE, size: int = DICTIONARY) -> Dictionary:
    """The `size` most frequent words of about `sample` documents, encoded by the same fold as all others. It only saves work:
    a word that isn't here is encoded with its chunk, so the sample has no bearing on any result."""
    docs = with_id(docs, "doc_id", "text")
    every = max(1, docs.count() // max(1, sample))

    def count(batches):
        splitter, found = Splitter(pattern), Counter()
        for batch in chunks(batches, "text", 1 << 20):
            for text in texts(batch.column("text")):
                found.update(splitter(text))
        words = list(found)
        for lo in range(0, len(words), 10_000):
            part = words[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([found[w] for w in part], pa.int64())], names=["word", "n"])

    counted = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(count, "word string, n long")
    counted = counted.where(F.octet_length("word") <= LONG).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = counted.orderBy(F.desc("n"), "word").limit(size).select("word", F.decode(F.encode("word", "UTF-8"), "ISO-8859-1").alias("w"))
    rows = top.groupBy(F.pmod(F.xxhash64("word"), F.lit(max(1, size // ROW_WORDS))).alias("g")).agg(F.collect_list("word").alias("words"), F.collect_list("w").alias("w"))
    got = rows.select("words", _coded(ranks, "w").alias("coded")).toArrow()
    out = Dictionary([], [], [], [])
    for words, coded in zip(got.column("words").chunks, got.column("coded").chunks):
        flat = coded.flatten()
        out.words += words.flatten().to_pylist()
        for values, name in ((out.n, "n"), (out.said, "ids"), (out.raw, "bytes")):
            values += flat.field(name).to_pylist()
    return out


SPLIT = "ids array<long>, counts binary, numbers binary, words array<string>, long_words array<binary>, sizes binary, parts binary"


def split_chunks(docs: DataFrame, pattern: str, chunk: int = CHUNK, dictionary=None) -> DataFrame:
    """For each chunk of documents first its distinct words beyond the dictionary's, in rows of ROW_WORDS, then its distinct pieces as
    word numbers, then its documents as piece numbers. A piece is a stretch that no word crosses.

    A long word is null among the words of its row and listed beside them."""

    def split(batches):
        splitter = Splitter(pattern)
        base = _numbered(dictionary.id, dictionary.held) if dictionary else {}
        seen, pieces = Numbers(base), Numbers()
        ids, counts, numbers, size = [], [], array("i"), 0

        def rows():
            sizes, parts = array("i"), array("i")
            for key in pieces:
                words = splitter.words_of(key)
                sizes.append(len(words))
                parts.extend(map(seen.__getitem__, words))
            raw = [word.encode() for word in islice(seen, len(base), None)]
            seen.clear(), pieces.clear()  # while the chunk's rows are put together elsewhere
            for lo in range(0, len(raw), ROW_WORDS):
                part = raw[lo : lo + ROW_WORDS]
                yield row(words=[w.decode("latin-1") if len(w) <= LONG else None for w in part], far=[w for w in part if len(w) > LONG])
            yield from cut([], sizes, parts, lambda _, n, index: row(sizes=n, parts=index))
            yield from cut(ids, counts, numbers, lambda own, n, index: row(own, n, index))

        def cut(own, counts, numbers, made):
            """Rows of about ROW_TOKENS numbers."""
            counts, index, done, first = np.array(counts, np.int32), np.frombuffer(numbers, np.int32), 0, 0
            ends = np.cumsum(counts, dtype=np.int64)
            while first < len(counts):
                to = max(first + 1, int(np.searchsorted(ends, done + ROW_TOKENS, "right")))
                yield made(own[first:to], counts[first:to], index[done : ends[to - 1]])
                first, done = to, int(ends[to - 1])

        def row(ids=(), counts=(), index=(), words=(), far=(), sizes=(), parts=()):
            packed = lambda values: pa.array([np.array(values, np.int32).tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([list(ids)], pa.list_(pa.int64())), packed(counts), packed(index), pa.array([list(words)], pa.list_(pa.string())), pa.array([list(far)], pa.list_(pa.binary())), packed(sizes), packed(parts)],
                names=["ids", "counts", "numbers", "words", "long_words", "sizes", "parts"],
            )

        for batch in chunks(batches, "text", 1 << 20, keep=True):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                keys = splitter.pieces(text)
                numbers.extend(map(pieces.__getitem__, keys))
                ids.append(doc_id), counts.append(len(keys))
                size += len(text)
            if size >= chunk:
                yield from rows()
                seen, pieces = Numbers(base), Numbers()
                ids, counts, numbers, size = [], [], array("i"), 0
                give_back()
        if ids:
            yield from rows()
        del seen, pieces, ids, counts, numbers
        give_back()

    return with_id(docs, "doc_id", "text").mapInArrow(split, SPLIT)


def encode_chunks(split: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds, for each distinct word, the number of ids, the ids as text and the decoded bytes."""
    return split.select("ids", "counts", "numbers", "long_words", "sizes", "parts", _coded(ranks, "words").alias("coded"))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, chunk: int = CHUNK, with_ids: bool = False, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every document. Smaller chunks and fewer words in the
    dictionary take less memory and more time, and give the same result."""
    frequent, share = frequent_words(docs, ranks, pattern, size=dictionary), docs.sparkSession.sparkContext.broadcast
    coded = encode_chunks(split_chunks(docs, pattern, chunk, _Shared(share(frequent.words))), ranks)
    # Splitting holds the words alone, putting together what they give alone.
    known = share((frequent.n, frequent.said, frequent.raw))

    def assemble(batches):
        back = {rank: token for token, rank in ranks.items()}
        base = known.value
        # Rows arrive in the order in which the splitting wrote them: a chunk's words, its pieces, its documents.
        words = pieces = None
        complete = True
        for batch in batches:
            for at in range(batch.num_rows):
                coded = batch.column("coded")[at].values
                ids = batch.column("ids")[at].values
                if complete and not len(ids):
                    pieces = said = raw = each = sums = None
                    give_back()
                    words, pieces, complete = tuple(map(list, base)), ([], [], []), False
                if len(coded):
                    far = (merge_long(w, ranks) for w in batch.column("long_words")[at].as_py())
                    parts = [coded.field(name).to_pylist() for name in ("n", "ids", "bytes")]
                    for known_word, *values in zip(coded.is_valid().to_pylist(), *parts):
                        if not known_word:
                            own = next(far)
                            values = len(own), ",".join(map(str, own)), b"".join(back[i] for i in own)
                        for column, value in zip(words, values):
                            column.append(value)
                    continue
                read = lambda name: np.frombuffer(batch.column(name)[at].as_py(), np.int32)
                if not len(ids):
                    n, said, raw = words
                    index, end = read("parts").tolist(), 0
                    for size in read("sizes").tolist():
                        own = index[end : end + size]
                        end += size
                        if size == 1:
                            i = own[0]
                            pieces[0].append(n[i]), pieces[1].append(said[i]), pieces[2].append(raw[i])
                        else:
                            pieces[0].append(sum([n[i] for i in own]))
                            pieces[1].append(",".join([said[i] for i in own])), pieces[2].append(b"".join([raw[i] for i in own]))
                    continue
                complete, words = True, None
                _, said, raw = pieces
                each = np.array(pieces[0], np.int64)
                ids, counts, numbers = ids.to_numpy(), read("counts"), read("numbers")
                ends = np.cumsum(counts, dtype=np.int64)
                sums = np.zeros(len(numbers) + 1, np.int64)
                np.cumsum(each[numbers], out=sums[1:])
                totals = sums[ends] - sums[ends - counts]
                for lo in range(0, len(ids), 500):
                    rows = []
                    for doc, end, count, total in zip(ids[lo : lo + 500].tolist(), ends[lo : lo + 500].tolist(), counts[lo : lo + 500].tolist(), totals[lo : lo + 500].tolist()):
                        own = numbers[end - count : end].tolist()
                        text = ",".join([x for i in own if (x := said[i])])  # an empty piece has no ids
                        rows.append((doc, total, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(b"".join([raw[i] for i in own])).hexdigest(), text if with_ids else None))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
        words = pieces = said = raw = each = sums = None
        give_back()

    out = coded.mapInArrow(assemble, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids string")
    return out.withColumn("ids", F.filter(F.split("ids", ","), lambda x: x != "").cast("array<int>")) if with_ids else out.drop("ids")


class _Shared:
    """Broadcast words and a number that tells them from others in the same worker."""

    def __init__(self, held):
        self.held, self.id = held, uuid.uuid4().int
