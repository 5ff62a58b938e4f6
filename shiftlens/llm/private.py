"""Personal data by bootstrapped contextual extraction.

Fixed patterns give the base findings (email, ip, card, phone); those always stay and are the seeds. Every other word with a
digit or an @ sign that no base finding covers is a candidate. Each occurrence of a seed or of a candidate stands in lexical
patterns: the words around it (one before, one after, one on both sides, two before, two after) with the class of what stands
in the slot (digits only, with an @ sign, mixed; short or not). Patterns and instances (distinct texts) are the two sides of a graph, which
Spark scores in rounds:

* a pattern's confidence is the belief in its distinct instances, summed, over their number and a half;
* the belief in an instance is 1 for a seed, and for others the mean confidence of its patterns, each counted by the
  logarithm of its distinct instances, so that a pattern met once says nothing.

A candidate is found where a pattern of confidence `confidence` or more, induced by at least `seeds` distinct seeds, holds it,
and the belief in it is at least `belief`. The found spans have the kind "context".

Spark partitions the work: one pass over the texts writes a row for each document and one for each occurrence; edges are
distinct pairs, counted before they are shuffled; scores are joined by instance and by pattern and never collected.

Defined cases: null text counts as empty and has no findings; rows without doc_id are left out; rows of the same id and text
have the same spans, each row once; digits and letters are ASCII; words longer than 48 characters take part by their digest;
without seeds nothing is found beyond the base; other columns don't matter. A candidate's match of a base pattern that was
dropped (too few digits, no valid check digit) is a candidate like any other.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.common import chunks, fits_broadcast, texts, with_id, written

KINDS = ("email", "ip", "card", "phone", "context")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits begins a match only at its start: what fails there fails further in.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
TWO_WORDS = re.compile(r"\x20*([^\x20]*)\x20*([^\x20]*)")
SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
EDGE = ".,;:!?\"'()[]{}<>|*#&%$~`_=-+/\\"
DIGITS = re.compile(r"[0-9]+")
#: Rows of patterns or beliefs up to which a side is broadcast; beyond, it is shuffled.
SMALL = 200_000
ROUNDS, CONFIDENCE, BELIEF, SEEDS = 4, 0.7, 0.6, 3


def luhn(digits: str) -> bool:
    """Whether the last digit fits the others: every second one from the right is doubled, nines cast out."""
    doubled = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses. The local part reaches back from each @ to the first other character or the match before: time in
    proportion to the text, however long a run of such characters is."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append((start, free))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if MARK.search(text):
        found += [(m.start(), 1, m.end()) for m in ADDRESS.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(found)


def candidates(flat: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Words with a digit or @, without marks at their ends, that no base span touches. Only single spaces part words in flat."""
    found, free, k = [], 0, 0
    mark = MARK.search(flat)
    while mark:
        at = mark.start()
        start = flat.rfind(" ", free, at) + 1 or free
        end = flat.find(" ", at)
        free = len(flat) if end < 0 else end
        while k < len(base) and base[k][2] <= start:
            k += 1
        if k == len(base) or base[k][0] >= free:
            word = flat[start:free]
            start += len(word) - len(word.lstrip(EDGE))
            found.append((start, start + len(word.strip(EDGE))))
        mark = MARK.search(flat, free)
    return found


def _word(word: str) -> str:
    """A context word as patterns know it: lower case, digits as 0, marks at its ends off; a long one by its digest."""
    plain = DIGITS.sub("0", word.strip(EDGE).lower())
    return plain if len(plain) <= 48 else hashlib.md5(plain.encode()).hexdigest()


def slot_class(instance: str) -> str:
    """@ for what has an @ sign, x for letters and digits, 0 for digits; a minus follows where these are fewer than six, so that
    versions and years are judged by other patterns than identifiers."""
    kind = "@" if "@" in instance else "x" if any(c.isalpha() for c in instance) else "0"
    return kind + "-" * (sum(c.isalnum() for c in instance) < 6)


class Words:
    """The words around places of a text, asked for in order of their starts: what touches a place belongs to it. The last word
    looked at is kept, so many places in one long word don't read it again."""

    def __init__(self, flat: str):
        self.flat, self.backwards = flat, flat[::-1]
        self.first = self.last = (0, 0)
        self.before: list[str] = []
        self.after: list[str] = []

    def _bounds(self, at: int) -> tuple[int, int]:
        end = self.flat.find(" ", at)
        return self.flat.rfind(" ", 0, at) + 1, len(self.flat) if end < 0 else end

    def around(self, start: int, end: int) -> tuple[list[str], list[str]]:
        """The two words before a place, the nearer one first, and the two behind it. An end of the text counts as the word ^."""
        if not self.before or not self.first[0] <= start < self.first[1]:
            self.first = self._bounds(start)
            self.before = [_word(w[::-1]) or "^" for w in TWO_WORDS.match(self.backwards, len(self.flat) - self.first[0]).groups()]
        if not self.after or not self.last[0] < end <= self.last[1]:
            self.last = self._bounds(end - 1)
            self.after = [_word(w) or "^" for w in TWO_WORDS.match(self.flat, self.last[1]).groups()]
        return self.before, self.after


def contexts(words: Words, start: int, end: int) -> list[str]:
    """The lexical patterns of one occurrence."""
    before, after = words.around(start, end)
    slot = slot_class(words.flat[start:end])
    return [
        f"{before[0]} <{slot}>", f"<{slot}> {after[0]}", f"{before[0]} <{slot}> {after[0]}", f"{before[1]} {before[0]} <{slot}>", f"<{slot}> {after[0]} {after[1]}"
    ]


def instance_of(text: str) -> str:
    plain = text.lower()
    return plain if len(plain) <= 48 else hashlib.md5(plain.encode()).hexdigest()


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans, and the occurrences of seeds and candidates with their patterns."""
    base = base_spans(text)
    if not base and not MARK.search(text):
        return base, []
    flat = text.translate(SPACES)
    words = Words(flat)
    out, free = [], 0
    for start, _, end in base:
        if start >= free:  # of overlapping seeds the first one
            out.append((start, end, True))
            free = end
    out += [(start, end, False) for start, end in candidates(flat, _merged(base)) if end > start]
    rows = [
        {"start": a, "end": b, "instance": instance_of(text[a:b]), "seed": seed, "patterns": contexts(words, a, b)} for a, b, seed in sorted(out)
    ]
    return base, rows


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int, int]] = []
    for start, kind, end in spans:
        if out and start <= out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
        else:
            out.append((start, kind, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


PLACE = "struct<start:int,`end`:int,instance:string,seed:boolean,patterns:array<string>>"
SCANNED = f"doc_id long, digest binary, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, places array<{PLACE}>"
PLACE_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))])


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: counts and spans of the base, the text's digest, and all places with their patterns."""

    def scanned(batches):
        for batch in chunks(batches, "text"):
            raw = texts(batch.column("text"))
            found = [occurrences(t) for t in raw]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            spans = [joined(base) for base, _ in found]
            columns = [
                batch.column("doc_id").cast(pa.int64()), pa.array([hashlib.md5(t.encode()).digest() for t in raw], pa.binary()), *counts,
                pa.array([hashlib.sha256(s.encode()).hexdigest() for s in spans], pa.string()), pa.array(spans, pa.string()),
                pa.array([places for _, places in found], pa.list_(PLACE_TYPE)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "places"])

    return with_id(docs, "doc_id", "text").mapInArrow(scanned, SCANNED)


def graph(scanned: DataFrame) -> DataFrame:
    """(pattern, instance, seed): distinct edges. A text that is a seed anywhere is one everywhere."""
    places = scanned.select(F.explode("places").alias("p")).select("p.instance", "p.seed", F.explode("p.patterns").alias("pattern"))
    return places.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed"))


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, confidence, seeds) and (instance, belief) after so many rounds over the graph."""
    known = edges.groupBy("instance").agg(F.bool_or("seed").alias("seed"))
    belief = known.select("instance", F.col("seed").cast("double").alias("belief"))
    patterns = None
    for k in range(rounds):
        # belief has a row for each instance; a common instance's edges are one side of a join that AQE splits
        weighed = edges.drop("seed").join(belief, "instance")
        sums = weighed.groupBy("pattern").agg(F.sum("belief").alias("s"), F.count("*").alias("n"), F.count_if(F.col("belief") == 1.0).alias("seeds"))
        patterns = written(sums.select("pattern", (F.col("s") / (F.col("n") + 0.5)).alias("confidence"), F.log2(F.col("n").cast("double")).alias("weight"), "seeds"), f"patterns{k}")
        met = edges.join(patterns, "pattern").groupBy("instance").agg(
            F.bool_or("seed").alias("seed"), (F.sum(F.col("weight") * F.col("confidence")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean")
        )
        belief = written(met.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("mean", F.lit(0.0))).alias("belief")), f"belief{k}")
    return patterns, belief


def discover(scanned: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, belief: float = BELIEF, seeds: int = SEEDS) -> DataFrame:
    """(doc_id, digest, start, end, instance, pattern, confidence, belief) of candidates in high-confidence patterns: the best pattern of each."""
    edges = written(graph(scanned), "edges")
    patterns, beliefs = score(edges, rounds)
    trusted = patterns.where((F.col("confidence") >= confidence) & (F.col("seeds") >= seeds)).select("pattern", "confidence")
    likely = beliefs.where(F.col("belief") >= belief)
    if fits_broadcast(trusted, SMALL):
        trusted = F.broadcast(trusted)
    if fits_broadcast(likely, SMALL):
        likely = F.broadcast(likely)
    places = scanned.select("doc_id", "digest", F.explode("places").alias("p")).where("not p.seed").select("doc_id", "digest", "p.*")
    met = places.join(likely, "instance").withColumn("pattern", F.explode("patterns")).join(trusted, "pattern")
    best = F.max(F.struct("confidence", "pattern")).alias("best")
    found = met.groupBy("doc_id", "digest", "start", "end", "instance").agg(best, F.max("belief").alias("belief"))
    return found.select("doc_id", "digest", "start", "end", "instance", "best.pattern", "best.confidence", "belief")


def find_private(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (base and found) of every document, and n_context."""
    scanned = written(scan(docs), "places")
    found = discover(scanned, **options)
    extra = found.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("extra"))
    own = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(F.split(s, ":")[1].cast("int").alias("start"), s.alias("span")))
    # A base span's kind comes before "context" at the same start; array_sort keeps the base's own order by its rank.
    ranked = F.transform(own, lambda s, i: F.struct(s["start"].alias("start"), i.cast("int").alias("rank"), s["span"].alias("span")))
    more = F.transform(F.coalesce("extra", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.struct(
        s["start"].alias("start"), F.lit(1 << 30).alias("rank"), F.concat(F.lit("context:"), s["start"], F.lit(":"), s["end"]).alias("span")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(ranked, more)), lambda s: s["span"]), ",")
    out = scanned.drop("places").join(extra, ["doc_id", "digest"], "left")
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_context")
    )


def redact_private(docs: DataFrame, **options) -> DataFrame:
    """All columns of docs; each maximal run of overlapping spans in text is replaced by its first kind in brackets. A null
    text stays null. Spans come by a join on id and digest, so texts are shuffled once."""
    scanned = written(scan(docs), "places")
    found = discover(scanned, **options).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).agg(F.collect_list(F.struct("start", "end")).alias("__extra"))
    rows = with_id(docs).withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    both = rows.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__digest")), "left").drop("__id", "__digest", "__key")

    def clean(batches):
        for batch in chunks(batches, "text"):
            new = []
            for text, extra in zip(batch.column("text").to_pylist(), batch.column("__extra").to_pylist()):
                if text is not None:
                    spans = _merged(sorted(base_spans(text) + [(e["start"], 4, e["end"]) for e in extra or []]))
                    for start, kind, end in reversed(spans):
                        text = f"{text[:start]}[{KINDS[kind].upper()}]{text[end:]}"
                new.append(text)
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != "__extra"}
            columns["text"] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return both.mapInArrow(clean, docs.schema)
