"""Chat formatting by a finite-state machine over roles.

A template declares, for each role, the strings around a turn, whether its text counts for the loss, and which role
may follow. Formatting emits segments (text, loss flag); control strings inside texts are escaped with a sentinel
character and can be restored exactly. `parse` reads formatted segments back.

Turns of a conversation stream through one task in order; the state carried from turn to turn is the machine's role
and the running digests, so a conversation of any length needs bounded memory. Each segment is its own row.

Defined cases: null text counts as empty, null role as the empty role; a null turn sorts first; equal turns are ordered by role and
text; rows without conv_id are left out; unknown roles are formatted by the fallback and make the conversation invalid; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SENTINEL = "\x1a"


@dataclass(frozen=True)
class Template:
    """prefix and suffix have `{role}` where the role goes; order maps a role (None: the start) to the roles that may follow."""

    prefix: str = "<|turn|>{role}\n"
    suffix: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    order: tuple[tuple[str | None, tuple[str, ...]], ...] = ((None, ("system", "user")), ("system", ("user",)), ("user", ("assistant",)), ("assistant", ("user", "tool")), ("tool", ("assistant",)))

    def escape(self, text: str) -> str:
        """A sentinel after the first character of each control string, and a doubled mark for a sentinel in the text."""
        text = text.replace(SENTINEL, SENTINEL + "s")
        for control in self.controls:
            text = text.replace(control, control[0] + SENTINEL + "c" + control[1:])
        return text

    def unescape(self, text: str) -> str:
        return re.sub(SENTINEL + "([sc])", lambda m: SENTINEL if m[1] == "s" else "", text)

    def follows(self, state: str | None, role: str) -> bool:
        return role in dict(self.order).get(state, ())


DEFAULT = Template()

SEGMENTS = "conv_id long, turn_no long, role string, part string, text string, loss boolean, valid boolean"


def _ordered(turns: DataFrame) -> DataFrame:
    return (
        turns.select("conv_id", "turn", "role", "text").where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    )


def segments(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Three segments for each turn (prefix, text, suffix) in order; valid: the turns so far keep to the machine's order."""

    def emit(batches):
        conv, state, number, valid = None, None, 0, True
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv_id != conv:
                    conv, state, number, valid = conv_id, None, 0, True
                valid = valid and template.follows(state, role)
                state = role
                head = template.prefix.format(role=template.escape(role).replace("\n", SENTINEL + "n"))
                for part, piece, loss in (("prefix", head, False), ("text", template.escape(text), role in template.loss_roles), ("suffix", template.suffix, False)):
                    out.append((conv_id, number, role, part, piece, loss, valid))
                number += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[p.split()[0] for p in SEGMENTS.split(", ")])

    return _ordered(turns).mapInArrow(emit, SEGMENTS)


def _role(head: str, template: Template) -> str:
    before, after = template.prefix.split("{role}")
    return template.unescape(head[len(before) : len(head) - len(after)].replace(SENTINEL + "n", "\n"))


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of each conversation, from its segments alone (in the order that `segments` emits)."""

    def read(batches):
        conv, turns, digest, loss, masked, chars, valid, role = None, 0, None, 0, None, 0, True, ""
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            done = []
            for conv_id, part, text, flag, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss", "valid"))):
                if conv_id != conv:
                    if conv is not None:
                        done.append((conv, turns, digest.hexdigest(), loss, masked.hexdigest(), chars, valid))
                    conv, turns, digest, loss, masked, chars = conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                chars += len(text)
                valid = ok
                if part == "prefix":
                    role = _role(text, template)
                    turns += 1
                elif part == "text":
                    plain = template.unescape(text)
                    digest.update(f"{role}\n{plain}\n".encode())
                    if flag:
                        loss += len(plain)
                        masked.update(plain.encode())
            if done:
                yield batch_of(done)
        if conv is not None:
            yield batch_of([(conv, turns, digest.hexdigest(), loss, masked.hexdigest(), chars, valid)])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def format_conversations(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """The formatted text and the loss spans (start, end) of each conversation; for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("turn_no", F.when(F.col("part") == "prefix", 0).when(F.col("part") == "text", 1).otherwise(2).alias("k"), "text", "loss")))
    return segments(turns, template).groupBy("conv_id").agg(parts.alias("parts"), F.min("valid").alias("valid")).select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), F.transform("parts", lambda p: F.struct(F.length(p["text"]).alias("chars"), p["loss"].alias("loss"))).alias("mask"), "valid")
