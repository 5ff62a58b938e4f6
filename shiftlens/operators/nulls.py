"""Null models: iterations for each window, and randomizers as column expressions.

A randomizer takes the sequence and seed columns. Choices come from md5(seed|place), so that a rerun of a lost task gives the same rows.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftlens.functions import seq as S

STOPS = ("TAA", "TAG", "TGA")
SENSE = [c for c in S.CODONS if c not in STOPS]
SYNONYMS = {c: [d for d, b in zip(S.CODONS, S.AMINO) if b == a] for c, a in zip(S.CODONS, S.AMINO)}


def fan_out(windows: DataFrame, iterations: int = 100) -> DataFrame:
    return windows.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))


def draw(n: Column, *seed: Column) -> Column:
    """A number of 0 to n - 1 from the first 28 bits of md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[s.cast("string") for s in seed])), 1, 7), 16, 10).cast("long")
    return (bits % n).cast("int")


def shuffled_codons(seq: Column, *seed: Column) -> Column:
    """The same codons in another order; bases beyond the last whole codon are dropped."""
    keyed = F.transform(S.codons(seq), lambda c, i: F.struct(F.md5(F.concat_ws("|", *[s.cast("string") for s in seed], i.cast("string"))).alias("k"), c.alias("c")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda x: x["c"]), "")


def random_sense(seq: Column, *seed: Column) -> Column:
    """Random codons without stops, as many as there were."""
    table = F.array(*[F.lit(c) for c in SENSE])
    return F.array_join(F.transform(S.codons(seq), lambda c, i: F.get(table, draw(F.lit(len(SENSE)), *seed, i))), "")


def same_protein(seq: Column, *seed: Column) -> Column:
    """Each codon replaced by one of the codons for its amino acid."""
    table = F.create_map(*[x for c, own in SYNONYMS.items() for x in (F.lit(c), F.array(*[F.lit(d) for d in own]))])

    def swap(codon: Column, i: Column) -> Column:
        options = F.element_at(table, codon)
        return F.coalesce(F.get(options, draw(F.size(options), *seed, i)), codon)

    return F.array_join(F.transform(S.codons(seq), swap), "")


def random_middle(seq: Column, *seed: Column) -> Column:
    """First and third base of each codon stay, so that the pairs across codons do; the middle base is drawn."""
    middle = lambda i: F.substring(F.lit("ACGT"), draw(F.lit(4), *seed, i) + 1, F.lit(1))
    return F.array_join(F.transform(S.codons(seq), lambda c, i: F.concat(F.substring(c, 1, 1), middle(i), F.substring(c, 3, 1))), "")


def drawn_doublets(seq: Column, *seed: Column) -> Column:
    """Pairs of bases drawn, with replacement, from those at even offsets of the sequence."""
    pairs = F.regexp_extract_all(seq, F.lit("(?s).{2}"), F.lit(0))
    return F.array_join(F.transform(pairs, lambda c, i: F.get(pairs, draw(F.size(pairs), *seed, i))), "")


def same_slot_protein(seq: Column, *seed: Column) -> Column:
    """Each codon replaced by one with its amino acid, its last base and, but for the first codon, its first base; a codon with
    another letter stays."""

    def swap(codon: Column, i: Column) -> Column:
        first = F.when(i == 0, ".").otherwise(F.substring(codon, 1, 1))
        options = S.alternates(F.get(S.amino_letters(F.array(codon)), F.lit(0)), F.concat(first, F.lit("."), F.substring(codon, 3, 1)))
        return F.coalesce(F.get(options, draw(F.greatest(F.size(options), F.lit(1)), *seed, i)), codon)

    return F.array_join(F.transform(S.codons(seq), swap), "")


def _draws(seed: str):
    """Numbers 0 <= u < 1 from md5(seed|k), so that a rerun draws the same."""
    for k in count():
        yield int(hashlib.md5(f"{seed}|{k}".encode()).hexdigest()[:13], 16) / 16.0**13


def euler_walk(text: str, seed: str) -> str:
    """A sequence with the same first and last letter and the same count of every pair of neighbours, drawn evenly from all of these.

    The letters are the nodes of a graph and each pair of neighbours an edge; the text is a walk over all edges. A random tree towards
    the last letter gives each other letter's last edge: letters join it by a walk over random edges whose loops are cut
    (so that a tree is drawn by the product of its edges' counts). The other edges are put in random order, and the walk follows."""
    if len(text) < 3:
        return text
    draw, edges = _draws(seed), {}
    for a, b in zip(text, text[1:]):
        edges.setdefault(a, []).append(b)
    last, joined = {}, {text[-1]}
    for start in sorted(edges):
        at = start
        while at not in joined:
            own = edges[at]
            last[at] = own[int(next(draw) * len(own))]
            at = last[at]
        at = start
        while at not in joined:  # what was drawn last at each letter has no loop
            joined.add(at)
            at = last[at]
    for a in sorted(edges):
        own = edges[a]
        if a != text[-1]:
            own.remove(last[a])
        for k in range(len(own) - 1, 0, -1):
            j = int(next(draw) * (k + 1))
            own[k], own[j] = own[j], own[k]
        if a != text[-1]:
            own.append(last[a])
    out, used = [text[0]], dict.fromkeys(edges, 0)
    for _ in range(len(text) - 1):
        at = out[-1]
        out.append(edges[at][used[at]])
        used[at] += 1
    return "".join(out)


def kept_doublets(seq: Column, *seed: Column) -> Column:
    """A random order of the bases that keeps every count of two neighbours, and both ends; null stays null. Built-in functions can't
    walk a graph, so this runs over Arrow batches, all of a batch's walks step by step (euler_walks)."""

    @F.pandas_udf("string")
    def walk(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series(euler_walks(texts.tolist(), seeds.tolist()), dtype=object)

    return walk(seq, F.concat_ws("|", *[s.cast("string") for s in seed]))


RANDOMIZERS = {"bases": S.shuffled, "codons": shuffled_codons, "sense": random_sense, "protein": same_protein, "middle": random_middle, "doublets": drawn_doublets, "slots": same_slot_protein, "kept_doublets": kept_doublets}


def bootstrap_summary(nulls: DataFrame, keys: list[str], values: tuple[str, ...] = ("mfe",), listed: str | None = "mfe") -> DataFrame:
    """For each window iterations and, of each value (mfe, pairs), mean, deviation (of a sample) and standard error; the values of
    `listed` as one string, in rising order, joined by a space. Nulls count for no value; a single iteration has no deviation.

    A window has as many null rows as iterations, which bounds the list."""
    out = [F.count("*").alias("iterations")]
    for v in values:
        sd = F.stddev_samp(v)
        out += [F.round(F.avg(v), 2).alias(f"{v}_mean"), F.round(sd, 2).alias(f"{v}_sd"), F.round(sd / F.sqrt(F.count(v)), 2).alias(f"{v}_se")]
    if listed:
        out.append(F.concat_ws(" ", F.sort_array(F.collect_list(listed)).cast("array<string>")).alias(f"{listed}_values"))
    return nulls.groupBy(*keys).agg(*out)


def bootstrap(windows: DataFrame, randomizer, fold, keys: list[str], iterations: int = 100, seed: int = 7) -> DataFrame:
    """Null models of windows (keys, sequence): `iterations` random orders of each, folded (fold: sequence column to a struct of mfe
    and pairs) and summed up. Seeds are the keys and the iteration, so a lost task draws the same again. All of a window's
    iterations begin as one row, so sums are made before anything is shuffled."""
    rows = fan_out(windows.select(*keys, "sequence"), iterations)
    drawn = rows.withColumn("__s", randomizer(F.col("sequence"), F.lit(seed), *[F.col(k) for k in keys], F.col("iteration")))
    return bootstrap_summary(drawn.withColumn("__f", fold(F.col("__s"))).select(*keys, "__f.mfe", "__f.pairs"), keys, ("mfe", "pairs"))


def bootstrap_stacks(windows: DataFrame, keys: list[str], weights: dict[str, int], iterations: int = 100, seed: int = 7) -> DataFrame:
    """The same as bootstrap with shuffled bases, a fold that sums weights of neighbours, and pairs as the number of G before C: keys,
    iterations, mean, deviation and standard error of both, and the energies as text. Whole windows are shuffled at once in
    Arrow batches (the keys of S.shuffled, sorted as a matrix), so no row is multiplied and nothing is shuffled between tasks.
    Null sequences give no row; letters beyond ACGT weigh nothing."""
    table = np.zeros((5, 5), np.int64)
    for pair, value in weights.items():
        table["ACGT".index(pair[0]), "ACGT".index(pair[1])] = value
    code = np.full(256, 4, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    numbers = np.arange(1, iterations + 1)

    def folded(batches):
        for batch in batches:
            rows = []
            for text, name in zip(batch.column("sequence").to_pylist(), batch.column("__seed").to_pylist()):
                own = code[np.frombuffer(text.encode("ascii", "replace"), np.uint8)]
                h = np.array([int(hashlib.md5(f"{name}|{k}".encode()).hexdigest()[:7], 16) for k in numbers], np.int64)
                i = np.arange(len(own), dtype=np.int64)
                x = (h[:, None] * 7 + i * S.STEP) % S.PRIME
                y = (x * x + i * S.SHIFT) % S.PRIME
                order = (((y * y + x) % S.PRIME) * (1 << 31) + i).argsort(1)
                mixed = own[order]
                left, right = mixed[:, :-1], mixed[:, 1:]
                energy, pairs = table[left, right].sum(1), ((left == 2) & (right == 1)).sum(1)
                rows.append((*(f(v) for v in (energy, pairs) for f in (np.mean, _deviation)), " ".join(map(str, np.sort(energy)))))
            made = [pa.array(c, pa.string() if k == 4 else pa.float64()) for k, c in enumerate(zip(*rows))] if rows else [pa.array([], k) for k in (pa.float64(),) * 4 + (pa.string(),)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made], names=[*keys, "m", "s", "pm", "ps", "mfe_values"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keys).schema)
    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    rows = windows.where(F.col("sequence").isNotNull()).select(*keys, "sequence", name.alias("__seed"))
    done = rows.mapInArrow(folded, f"{kinds}, m double, s double, pm double, ps double, mfe_values string")
    root = F.sqrt(F.lit(float(iterations)))
    figures = {"mfe_mean": F.col("m"), "mfe_sd": F.col("s"), "mfe_se": F.col("s") / root, "pairs_mean": F.col("pm"), "pairs_sd": F.col("ps"), "pairs_se": F.col("ps") / root}
    return done.select(*keys, F.lit(iterations).cast("long").alias("iterations"), *[F.round(c, 2).alias(n) for n, c in figures.items()], "mfe_values")


def _deviation(values: np.ndarray) -> float | None:
    return float(np.std(values, ddof=1)) if len(values) > 1 else None


def fold_with(windows: DataFrame, folder, existing: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """Windows with mfe, parens and error from a caller's folder: a function of one sequence that gives (mfe, parens), or raises.

    Each distinct sequence is folded once and not at all where existing (sequence, mfe, parens) has it. Sequences are dealt by hash, so
    every task gets its share of each length, and sorted by length, so that a task's batches are alike. A folder that
    raises gives a row with a null mfe and the error's text; other sequences go on. Null sequences are left out."""
    todo = windows.select("sequence").where("sequence is not null").distinct()
    if existing is not None:
        todo = todo.join(existing.select("sequence"), "sequence", "left_anti")

    def folded(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                rows = []
                for text in frame["sequence"].iloc[at : at + batch]:
                    try:
                        mfe, parens = folder(text)
                        rows.append((text, float(mfe), parens, None))
                    except Exception as why:  # a failed window is a result
                        rows.append((text, None, None, f"{type(why).__name__}: {why}"))
                yield pd.DataFrame(rows, columns=["sequence", "mfe", "parens", "error"]).astype({"mfe": "float64"})

    dealt = todo.repartition("sequence").sortWithinPartitions(F.length("sequence"))
    fresh = dealt.mapInPandas(folded, "sequence string, mfe double, parens string, error string")
    fresh = fresh.withColumn("mfe", F.when(F.col("error").isNull(), F.col("mfe")))
    if existing is not None:
        known = existing.groupBy("sequence").agg(F.min(F.struct("mfe", "parens")).alias("x")).select("sequence", "x.mfe", "x.parens", F.lit(None).cast("string").alias("error"))
        fresh = known.unionByName(fresh)
    return windows.join(fresh, "sequence")


def bulk_fold(windows: DataFrame, fold, existing: DataFrame | None = None) -> DataFrame:
    """fold(sequence column) on each distinct sequence, joined back to all windows that share it; sequences among the existing
    ones (sequence, mfe) keep the energy they have there and are not folded again."""
    todo = windows.select("sequence").distinct()
    if existing is None:
        return windows.join(todo.withColumn("mfe", fold(F.col("sequence"))), "sequence")
    known = existing.groupBy("sequence").agg(F.min("mfe").alias("mfe"))
    fresh = todo.join(known, "sequence", "left_anti").withColumn("mfe", fold(F.col("sequence")))
    return windows.join(known.unionByName(fresh), "sequence")


#: Steps and shifts of md5.
_SINES = [int(abs(np.sin(k + 1)) * 2**32) for k in range(64)]
_TURNS = [(7, 12, 17, 22)[k % 4] if k < 16 else (5, 9, 14, 20)[k % 4] if k < 32 else (4, 11, 16, 23)[k % 4] if k < 48 else (6, 10, 15, 21)[k % 4] for k in range(64)]


def _md5(words: list[np.ndarray | int], two: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The first (with `two`, first and second) four bytes of the md5 of blocks of 16 words, as numbers with the first byte on top."""
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.uint32(x) for x in start)
    with np.errstate(over="ignore"):
        for k in range(64 if two else 61):
            if k < 16:
                f, g = d ^ (b & (c ^ d)), k
            elif k < 32:
                f, g = c ^ (d & (b ^ c)), (5 * k + 1) % 16
            elif k < 48:
                f, g = b ^ c ^ d, (3 * k + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * k % 16
            x = a + f + (words[g] + np.uint32(_SINES[k]))
            x = (x << np.uint32(_TURNS[k])) | (x >> np.uint32(32 - _TURNS[k]))
            a, d, c, b = d, c, b, b + x
        # after 61 steps the newest value is the one that becomes a
        first = (a if two else b) + np.uint32(start[0])
        return first.byteswap(), (b + np.uint32(start[1])).byteswap() if two else None


def md5_heads(heads: list[str], tails: list[str], two: bool = False, chunk: int = 1 << 15) -> np.ndarray:
    """(heads x tails) first 28 bits, or with `two` 52 bits, of md5 of head + tail, all of them at once; a text over 55 bytes goes
    through hashlib."""
    out = np.zeros((len(heads), len(tails)), np.int64)
    raw, ends_ = [h.encode() for h in heads], [x.encode() for x in tails]
    sizes = np.array([len(h) for h in raw])
    most = max(map(len, ends_), default=0)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        if size + most > 55:
            for r in rows:
                out[r] = [int(hashlib.md5(raw[r] + x).hexdigest()[: 13 if two else 7], 16) for x in ends_]
            continue
        whole = b"".join(raw[r].ljust(64, b"\0") for r in rows)
        front = np.frombuffer(whole, "<u4").reshape(len(rows), 16)
        back = b"".join((b"\0" * int(size) + x + b"\x80").ljust(56, b"\0") + (8 * (int(size) + len(x))).to_bytes(8, "little") for x in ends_)
        back = np.frombuffer(back, "<u4").reshape(len(ends_), 16)
        step = max(1, chunk // max(len(ends_), 1))
        for lo in range(0, len(rows), step):
            own = front[lo : lo + step]
            words = []
            for k in range(16):  # words that only one side fills stay small
                f, b = own[:, k, None], back[None, :, k]
                words.append(f + b if f.any() and b.any() else f if f.any() else b if b.any() else np.uint32(0))
            first, second = _md5(words, two)
            value = (first.astype(np.int64) << 20) | (second >> np.uint32(12)) if two else first >> np.uint32(4)
            out[rows[lo : lo + step]] = np.broadcast_to(value, (len(own), len(ends_)))
    return out


def euler_walks(texts: list[str | None], seeds: list[str], group: int = 4096) -> list[str | None]:
    """euler_walk of each text with its seed, walks of texts of ACGT of one length taken step by step together. Other texts, and
    walks whose tree takes over 16 draws more than the text has letters, go one by one."""
    out: list[str | None] = [None] * len(texts)
    by_size: dict[int, list[int]] = {}
    for r, text in enumerate(texts):
        if text is not None and (len(text) < 3 or text.strip("ACGT")):
            out[r] = euler_walk(text, seeds[r])
        elif text is not None:
            by_size.setdefault(len(text), []).append(r)
    for size, rows in by_size.items():
        at_once = max(1, min(group, 2_000_000 // size))
        for lo in range(0, len(rows), at_once):
            part = rows[lo : lo + at_once]
            for r, walk in zip(part, _walks([texts[r] for r in part], [seeds[r] for r in part], size)):
                out[r] = walk
    return out


def _walks(texts: list[str], seeds: list[str], size: int) -> list[str]:
    code = np.zeros(256, np.int64)
    code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    own = code[np.frombuffer("".join(texts).encode(), np.uint8)].reshape(-1, size)
    n, most = len(texts), size + 16
    draws = md5_heads([s + "|" for s in seeds], [str(k) for k in range(most)], two=True) / 16.0**13
    every, places = np.arange(n), np.arange(size)
    edges, sizes = np.zeros((n, 4, size), np.int8), np.zeros((n, 4), np.int64)
    for k in range(size - 1):
        edges[every, own[:, k], sizes[every, own[:, k]]] = own[:, k + 1]
        sizes[every, own[:, k]] += 1
    used, late = np.zeros(n, np.int64), np.zeros(n, bool)

    def draw(rows: np.ndarray, below) -> np.ndarray:
        late[rows] |= used[rows] >= most
        got = (draws[rows, np.minimum(used[rows], most - 1)] * below).astype(np.int64)
        used[rows] += 1
        return got

    last, joined = np.zeros((n, 4), np.int64), np.zeros((n, 4), bool)
    joined[every, own[:, -1]] = True
    for start in range(4):
        rows = np.flatnonzero((sizes[:, start] > 0) & ~joined[:, start])
        first, at = rows, np.full(len(rows), start)
        while len(rows):
            last[rows, at] = edges[rows, at, draw(rows, sizes[rows, at])]
            at = last[rows, at]
            on = ~joined[rows, at] & ~late[rows]
            rows, at = rows[on], at[on]
        rows, at = first, np.full(len(first), start)
        for _ in range(4):
            on = ~joined[rows, at]
            rows, at = rows[on], at[on]
            joined[rows, at] = True
            at = last[rows, at]
    for a in range(4):
        tree = (own[:, -1] != a) & (sizes[:, a] > 0)
        rows = np.flatnonzero(tree)  # without the first edge to last[a], which comes last
        gap = (edges[rows, a] == last[rows, a, None]).argmax(1)
        edges[rows, a] = np.take_along_axis(edges[rows, a], np.minimum(places + (places >= gap[:, None]), size - 1), 1)
        left = sizes[:, a] - tree
        for k in range(int(left.max(initial=0)) - 1, 0, -1):
            rows = np.flatnonzero(left > k)
            j = draw(rows, k + 1)
            held = edges[rows, a, k]
            edges[rows, a, k] = edges[rows, a, j]
            edges[rows, a, j] = held
        rows = np.flatnonzero(tree)
        edges[rows, a, left[rows]] = last[rows, a]
    walk, taken = np.empty((n, size), np.int64), np.zeros((n, 4), np.int64)
    walk[:, 0] = own[:, 0]
    for k in range(1, size):
        at = walk[:, k - 1]
        walk[:, k] = edges[every, at, np.minimum(taken[every, at], size - 1)]
        taken[every, at] += 1
    whole = np.frombuffer(b"ACGT", np.uint8)[walk].tobytes().decode()
    return [euler_walk(texts[r], seeds[r]) if late[r] else whole[r * size : (r + 1) * size] for r in range(n)]


def doublet_counts(seq: Column) -> Column:
    """How often each two of ACGT are neighbours, overlapping ones too: an array of 16 in the order AA, AC, ... TT; null for null."""

    @F.arrow_udf("array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        code = np.full(256, 4, np.int64)
        code[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
        own = pa.concat_arrays([texts.cast("string").fill_null("")])
        ends = np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1].astype(np.int64)
        raw = code[np.frombuffer(own.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        row = np.repeat(np.arange(len(own)), np.diff(ends))
        both = (row[1:] == row[:-1]) & (raw[1:] < 4) & (raw[:-1] < 4)
        n = np.bincount((row[1:] * 16 + raw[:-1] * 4 + raw[1:])[both], minlength=16 * len(own))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(own) + 1, 16), pa.int32()), pa.array(n, pa.int32()), mask=texts.is_null())

    return counted(seq)


def _drawn(windows: DataFrame, keys: list[str], iterations: int, places, options, seed: int) -> DataFrame:
    """(keys, iteration, shuffled): for each window (keys, sequence) and iteration, one of the options of each place, picked by the
    numbers of draw(). places(text) cuts a text, options(list) gives a list of options for each of its places. A window's row goes
    to Python once for all iterations."""
    schema = windows.select(*keys).schema

    def run(batches):
        for batch in batches:
            names, texts = batch.column("__seed").to_pylist(), batch.column("sequence").to_pylist()
            cut = [places(t) for t in texts]
            most = max(map(len, cut), default=0)
            bits = md5_heads([n + "|" for n in names], [f"{k}|{i}" for k in range(1, iterations + 1) for i in range(most)]).reshape(len(texts), iterations, most)
            out = []
            for own, drawn in zip(map(options, cut), bits):
                sizes = np.array([len(o) for o in own], np.int64)
                for picks in (drawn[:, : len(own)] % sizes).tolist():
                    out.append("".join([o[k] for o, k in zip(own, picks)]))
            row = pa.array(np.repeat(np.arange(len(texts)), iterations))
            which = pa.array(np.tile(np.arange(1, iterations + 1), len(texts)), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), which, pa.array(out, pa.string())], names=[*keys, "iteration", "shuffled"])

    name = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    rows = windows.where("sequence is not null").select(*keys, "sequence", name.alias("__seed"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.mapInArrow(run, f"{kinds}, iteration int, shuffled string")


def doublet_iterations(windows: DataFrame, keys: list[str], iterations: int = 100, seed: int = 7) -> DataFrame:
    """drawn_doublets of fan_out(windows) with seeds of seed, keys and iteration, in Arrow batches; null sequences give no row."""
    return _drawn(windows, keys, iterations, lambda t: [t[k : k + 2] for k in range(0, len(t) - 1, 2)], lambda own: [own] * len(own), seed)


def same_slot_iterations(windows: DataFrame, keys: list[str], iterations: int = 100, seed: int = 7) -> DataFrame:
    """same_slot_protein of fan_out(windows) with seeds of seed, keys and iteration, in Arrow batches; null sequences give no row."""
    inner = {c: [d for d in own if d[0] == c[0] and d[2] == c[2]] for c, own in SYNONYMS.items()}
    front = {c: [d for d in own if d[2] == c[2]] for c, own in SYNONYMS.items()}
    options = lambda own: [front.get(c, [c]) if i == 0 else inner.get(c, [c]) for i, c in enumerate(own)]
    return _drawn(windows, keys, iterations, lambda t: [t[k : k + 3] for k in range(0, len(t) - 2, 3)], options, seed)


def stack_sums(seq: Column) -> Column:
    """S.stack_energy in Arrow batches: weights of all neighbours are looked up at once, and a sequence has the difference of two running
    sums. Null stays null; letters beyond ACGT weigh nothing."""

    @F.arrow_udf("int")
    def total(texts: pa.Array) -> pa.Array:
        table = np.zeros((256, 256), np.int64)
        for pair, value in S.STACK.items():
            table[ord(pair[0]), ord(pair[1])] = round(value * 100)
        own = pa.concat_arrays([texts.cast("string").fill_null("")])
        ends = np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1].astype(np.int64)
        raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)
        sums = np.concatenate(([0, 0], np.cumsum(table[raw[:-1], raw[1:]]))) if len(raw) else np.zeros(2, np.int64)
        first, last = ends[:-1], ends[1:]  # sums[k]: weights of the pairs that end before place k
        out = np.where(last > first, sums[last] - sums[np.minimum(first + 1, last)], 0)
        return pa.array(out.astype(np.int32), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return total(seq)


def landscape_fold(windows: DataFrame, folds: dict, existing: DataFrame | None = None) -> DataFrame:
    """Energies of landscape windows by each method (name: fold of a sequence column): (id, start, mfe_method, mfe); windows that
    existing (id, start, mfe_method) has are left out.

    A window is folded by all methods in its row, and its sequence goes no further: what meets existing is its id, its start and the
    energies, one row a window. A fold that costs more than a shuffle of the sequences belongs in bulk_fold."""
    names = list(folds)
    made = windows.where("sequence is not null").select("id", "start", *[folds[n](F.col("sequence")).alias(f"__f{k}") for k, n in enumerate(names)])
    if existing is not None:
        # A bit for each method that has been done.
        done = F.coalesce(*[F.when(F.col("mfe_method") == n, F.lit(1 << k)) for k, n in enumerate(names)]).cast("long")
        known = existing.where(F.col("mfe_method").isin(names)).groupBy("id", "start").agg(F.bit_or(done).alias("__done"))
        made = made.join(known, ["id", "start"], "left")
    else:
        made = made.withColumn("__done", F.lit(0).cast("long"))
    left = lambda k: F.coalesce(F.col("__done").bitwiseAND(F.lit(1 << k)), F.lit(0)) == 0
    rows = F.array(*[F.when(left(k), F.struct(F.lit(n).alias("mfe_method"), F.col(f"__f{k}").alias("mfe"))) for k, n in enumerate(names)])
    return made.select("id", "start", F.explode(rows).alias("r")).where("r is not null").select("id", "start", "r.mfe_method", "r.mfe")
