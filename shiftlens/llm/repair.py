"""Conversation structure repair: the cheapest edits that give a conversation legal turns, by divide and conquer in linear space.

A legal conversation is empty, or an optional system turn and then pairs of a user's and an assistant's turn. Four states tell
how far a conversation is: nothing yet, after the system's turn, after a user's, after an assistant's. Edits are Keep (0),
Rerole to user or assistant (1), Delete (2, required for blank and repeated turns) and Insert (5); a truncated turn that
stays adds 5. Letters of the edits in order are the audit; of several cheapest audits the least by ASCII counts.

Search: a forward vector (cost and rank of the least audit for each state) and a backward vector (cost to a legal end) meet
in the middle of a conversation; the crossing of least cost, then of least audit, splits it into two halves that are solved
alike. A vector has four entries, so a conversation of any length needs memory for its codes (one byte a turn) and its
audit, which is one cell of the result. Audits that have consumed the same turns both end in the letter of the last one, so
none is the beginning of another, and ranks carry over from turn to turn.

Spark deals turns by conversation and sorts them; tasks read the sorted rows as a stream. Texts are never held: the first
stream makes codes of them, the second one meets a conversation's audit before its turns and hashes what is repaired.

Defined cases: a null role or text counts as one space, a null turn sorts first, null conv_id is a conversation of its own;
turns with the same number are ordered by role, then text; a role that begins with another letter than s, u or a can't be
kept; a conversation without turns has an empty audit; other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Characters that aren't white space, and the last one of a text.
INK, LAST = r"[^\x20\x09-\x0D]", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
ROLES = "sua?"
BLANK, DUPLICATE, CUT = 1, 2, 3
#: State after a turn of each role, by the state before: nothing, system, user, assistant.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The one role that Rerole and Insert can give in a state.
NEXT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
FAR = 1 << 60
#: Cheapest insertions that end a conversation in each state.
ENDING = {0: "", 1: "II", 2: "I", 3: ""}
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}


def _moves(role: int, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state after a turn: (state before, cost, letters) of the cheapest ways there, at most two insertions first."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        state, cost, letters = before, 0, ""
        for _ in range(3):
            own = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED * (fault == CUT)
                kept = AFTER.get(ROLES[role], {}).get(state)
                own += [(kept, more, "K")] if kept is not None else []
                own.append((NEXT[state][0], REROLE + more, "R"))
            for after, price, letter in own:
                way = (cost + price, letters + letter)
                best[before, after] = min(best.get((before, after), way), way)
            state, cost, letters = NEXT[state][0], cost + INSERT, letters + "I"
    return [[(s, *best[s, t]) for s in range(4) if (s, t) in best] for t in range(4)]


MOVES = [_moves(code // 4, code % 4) for code in range(16)]


def _forward(codes: bytes, lo: int, hi: int, start: int) -> list[tuple[int, int]]:
    """(cost, rank of the least audit) of each state once turns lo to hi - 1 are consumed."""
    front = [(0, 0) if s == start else (FAR, 0) for s in range(4)]
    for i in range(lo, hi):
        ways = [min(((front[s][0] + cost, front[s][1], letters) for s, cost, letters in own), default=(FAR, 0, "")) for own in MOVES[codes[i]]]
        order = {w: k for k, w in enumerate(sorted({w[1:] for w in ways}))}
        front = [(min(w[0], FAR), order[w[1:]]) for w in ways]
    return front


def _backward(codes: bytes, lo: int, hi: int, after: list[int]) -> list[int]:
    """Cost of turns lo to hi - 1 and of what follows, from each state."""
    for i in range(hi - 1, lo - 1, -1):
        before = [FAR] * 4
        for t, own in enumerate(MOVES[codes[i]]):
            for s, cost, _ in own:
                before[s] = min(before[s], cost + after[t])
        after = before
    return after


def _solve(codes: bytes, lo: int, hi: int, start: int, after: list[int], out: list[str]) -> int:
    """Append the letters of turns lo to hi - 1; the state behind them."""
    if hi - lo == 1:
        ways = [(cost + after[t], letters, t) for t, own in enumerate(MOVES[codes[lo]]) for s, cost, letters in own if s == start]
        _, letters, state = min(ways)
        out.append(letters)
        return state
    mid = (lo + hi) // 2
    behind = _backward(codes, mid, hi, after)
    front = _forward(codes, lo, mid, start)
    crossing = min(range(4), key=lambda s: (front[s][0] + behind[s], front[s][1]))
    _solve(codes, lo, mid, start, [0 if s == crossing else FAR for s in range(4)], out)
    return _solve(codes, mid, hi, crossing, after, out)


def _audit(codes: bytes) -> tuple[int, str]:
    end = [INSERT * len(ENDING[s]) for s in range(4)]
    if not codes:
        return 0, ""
    out: list[str] = []
    state = _solve(codes, 0, len(codes), 0, end, out)
    return _backward(codes, 0, len(codes), end)[0], "".join(out) + ENDING[state]


_short = lru_cache(1 << 16)(_audit)


def cheapest_audit(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation whose turns have the codes 4 * role + fault; short ones recur and are remembered."""
    return _short(codes) if len(codes) <= 48 else _audit(codes)


def normalised(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: nulls of role and text as one space."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])


def damage(turns: DataFrame) -> DataFrame:
    """Rows with the faults that a digest of conversation and turn picks: dropped (kept as a row with there = false, so that its
    conversation is not lost), emptied, without marks of an end, repeated, or said by the user."""
    rows = normalised(turns)
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("there"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def _sorted(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("turn").asc_nulls_first(), "role", "text")


def coded(turns: DataFrame) -> DataFrame:
    """Turns in order with their code. A turn is a repeat where role and text were seen earlier in its conversation; the
    window keeps the dealing by conversation, so it costs a sort and no shuffle."""
    dealt = turns.repartition("conv_id")
    # The first of the same rows in turn order: ranks are counted as rows stream by, no group is held.
    earlier = F.expr("row_number() over (partition by conv_id, there, role, text order by turn nulls first) > 1")
    fault = (
        F.when(~F.col("text").rlike(INK), BLANK).when(F.col("__earlier"), DUPLICATE)
        .when(~F.regexp_extract("text", LAST, 1).isin(".", "!", "?"), CUT).otherwise(0)
    )
    role = F.when(F.startswith("role", F.lit("s")), 0).when(F.startswith("role", F.lit("u")), 1).when(F.startswith("role", F.lit("a")), 2).otherwise(3)
    marked = dealt.withColumn("__earlier", earlier).withColumn("code", (role * 4 + fault).cast("int"))
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "__earlier")
    return ordered.select("conv_id", "turn", "there", "code")


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, counts of faults, cost and audit. Turns are conv_id, turn, role, text and there."""

    def stream(batches):
        own, codes, low, high, places = None, bytearray(), None, None, 0
        begun = False

        def closed():
            code = bytes(codes)
            cost, letters = cheapest_audit(code)
            faults = [sum(c % 4 == f for c in code) for f in (BLANK, DUPLICATE, CUT)]
            illegal = sum((a // 4, b // 4) not in LEGAL_PAIRS for a, b in zip(code, code[1:]))
            gaps = high - low + 1 - places if low is not None else 0
            return own, gaps, *faults, illegal, cost, letters

        for batch in batches:
            out = []
            for conv, turn, there, code in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != own:
                    if begun:
                        out.append(closed())
                    begun, own, codes, low, high, places = True, conv, bytearray(), None, None, 0
                if there:
                    codes.append(code)
                    if turn is not None and turn != high:  # turns come in order
                        low, high, places = turn if low is None else low, turn, places + 1
            if out:
                yield _batch(out, AUDITS)
        if begun:
            yield _batch([closed()], AUDITS)

    return coded(turns).mapInArrow(stream, AUDITS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = [pa.array(c, pa.string() if k == "string" else pa.int64()) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The turns that the audits leave, in order: conv_id, place, role, text (streamed; an audit comes before its turns)."""
    return _stream_with(turns, found, TURNS, _edited)


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """found with the digest of the repaired turns as `role:text`, joined by line feeds."""
    return _stream_with(turns, found, f"{AUDITS}, repaired_sha256 string", _digested)


def _stream_with(turns: DataFrame, found: DataFrame, schema: str, make) -> DataFrame:
    body = turns.where("there").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    head = found.select("conv_id", F.lit(0).alias("kind"), F.struct(*found.columns).alias("found"))
    both = head.unionByName(body, allowMissingColumns=True)
    return _sorted(both, "kind").select("kind", "role", "text", "found").mapInArrow(make, schema)


def edits(state: int, letters: str, at: int, role: str | None) -> tuple[int, int, list[tuple[str, bool]]]:
    """Follow an audit from `at` until a turn of this role is consumed (None: to the end): the state, the place behind, and
    (role, whether the turn's own text stays) of each repaired turn."""
    out = []
    while at < len(letters):
        letter = letters[at]
        at += 1
        if letter == "I":
            state, said = NEXT[state]
            out.append((said, False))
            continue
        if letter == "R":
            state, said = NEXT[state]
            out.append((said, True))
        elif letter == "K":
            state = AFTER[role[0]][state]
            out.append((role, True))
        break
    return state, at, out


def _walk(batches, begin, take, end):
    """Run through conversations: begin(found), take(role, text), end() for each, in the order of the stream."""
    state = at = 0
    letters, open_ = "", False

    def close():
        if open_:
            for said, _ in edits(state, letters, at, None)[2]:
                take(said, "")
            end()

    for batch in batches:
        for kind, role, text, found in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                close()
                state, at, letters, open_ = 0, 0, found["audit"], True
                begin(found)
            else:
                state, at, said = edits(state, letters, at, role)
                for name, own in said:
                    take(name, text if own else "")
        yield
    close()
    yield


TURNS = "conv_id long, place long, role string, text string"


def _edited(batches):
    rows: list[tuple] = []
    own = [None, 0]

    def begin(found):
        own[:] = [found["conv_id"], 0]

    def take(role, text):
        rows.append((own[0], own[1], role, text))
        own[1] += 1

    for _ in _walk(batches, begin, take, lambda: None):
        if rows:
            yield _batch(rows, TURNS)
            rows.clear()


def _digested(batches):
    rows: list[tuple] = []
    own: list = [None, None, b""]

    def begin(found):
        own[:] = [found, hashlib.sha256(), b""]

    def take(role, text):
        own[1].update(own[2] + f"{role}:{text}".encode())
        own[2] = b"\n"

    for _ in _walk(batches, begin, take, lambda: rows.append((*own[0].values(), own[1].hexdigest()))):
        if rows:
            yield _batch(rows, f"{AUDITS}, repaired_sha256 string")
            rows.clear()


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of turns
    (conv_id, turn, role, text, and there where rows were dropped)."""
    rows = turns if "there" in turns.columns else normalised(turns).withColumn("there", F.lit(True))
    return repaired_digests(rows, audits(rows))
