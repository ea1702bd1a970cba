"""Repair of conversation structure by a square-root checkpointed dynamic program.

A conversation is repaired by the cheapest edits (Keep, Rerole, Delete, Insert) that give role initials `(s?(ua)+)?`. Four states say how
far a prefix of that pattern has come: nothing, after s, after u, after a. The cost of finishing from each state is computed backwards,
the edits are read off forwards, so both directions need all rows. Rows are therefore sorted globally and cut into blocks of about the square
root of the longest conversation; a block's least costs from state to state form a matrix, made block by block in parallel. One backward
stream over matrices leaves the vector of costs at each block's end, its checkpoint, and nothing else. A block's rows are then walked again
from its checkpoint, for every state it may be entered in, and one forward stream picks the walk that follows from the block before.

No conversation is held whole: a task has one block in memory, and sorted streams carry four numbers or a running digest from block to block.
The digest of a conversation's whole repaired text is sequential by nature, so that stream passes through one task, at constant memory.

Defined results: NULL role or text counts as one space, and so do NULLs in the key that decides the damage; NULL conv_id is a conversation of its
own; rows of one turn are taken by role and text (code points); rows equal in all columns are rows of their own; a conversation of which damage leaves no
row has zeros and an empty audit; an empty table gives no row. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewright.llm.common import cut, salted_join

START, SYSTEM, USER, DONE = range(4)  # states: nothing said, after the system's turn, after the user's, after the assistant's
NEXT = (USER, USER, DONE, USER)  # the state after the turn that an Insert or a Rerole makes
FINISH = (0, 6, 3, 0)  # cost of Inserts that complete the pattern from a state
KEEP, REROLE, INSERT, DELETE, CUT_OFF = 0, 3, 3, 4, 3
NEVER = 1 << 60
INITIALS, OTHER = {"s": 0, "u": 1, "a": 2}, 3
BLANK, TRUNCATED, REPEATED = 4, 8, 16  # bits beside the class of the role's initial
LEGAL = {(0, 1), (1, 2), (2, 1)}
SEEN = re.compile(r"[^\x20\x09-\x0D]")
LEAST_BLOCK, BLOCK_BYTES = 64, 1 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after the damage that crc32(`conv_id:turn`) % 20 decides; conv is a text key that tells NULL apart."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(key(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), fate.alias("fate"))
    return rows.where("fate <> 0").select(
        "conv", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def key(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), conv_id.cast("string")), F.lit("n"))


def turn_gaps(rows: DataFrame) -> DataFrame:
    """Per conversation the turns missing between its first and last; 0 if every turn is NULL, NULL beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return rows.groupBy("conv").agg(F.coalesce(
        (wide(F.max("turn")) - wide(F.min("turn")) + 1 - wide(F.count_distinct("turn"))).try_cast("long"), F.when(F.count("turn") == 0, F.lit(0).cast("long"))).alias("gaps"))


def kind(role: str, text: str) -> int:
    """The role's initial and the faults that the row shows by itself, as bits."""
    last = SEEN.findall(text[-64:]) or SEEN.findall(text)
    return INITIALS.get(role[:1], OTHER) | (TRUNCATED * (last[-1] not in ".!?") if last else BLANK)


BLOCKS = T.StructType([
    T.StructField("conv", T.StringType()), T.StructField("block", T.LongType()), T.StructField("kinds", T.BinaryType()),
    T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType()))])


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """The rows in global order, cut into blocks of one conversation each: at most `size` rows, or about BLOCK_BYTES of text.

    Blocks are numbered in that order. A range of rows ends anywhere, also within a conversation or among equal rows.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text", "copy", "deal"]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held, held_bytes, of = [], 0, None

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            digests = [hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest() for r, t in held]
            columns = [[of], [number], [bytes(kind(r, t) for r, t in held)], [digests], [[r for r, _ in held]], [[t for _, t in held]]]
            types = [pa.string(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=BLOCKS.names)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text"))):
                if held and (conv != of or len(held) >= size or held_bytes > BLOCK_BYTES):
                    yield block()
                    held, held_bytes = [], 0
                of = conv
                held.append((role, text))
                held_bytes += len(text)
        if held:
            yield block()

    dealt = rows.withColumn("deal", F.rand(13))  # only so that equal rows may be split between ranges
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text").mapInArrow(cut_up, BLOCKS)


def repeats(blocks: DataFrame) -> DataFrame:
    """(block, repeated): per block the places of rows whose role and text an earlier row of the conversation has."""
    rows = blocks.select("conv", "block", F.posexplode("digests").alias("place", "digest"))
    at = F.struct("block", "place")
    several = rows.groupBy("conv", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    joined = salted_join(rows, several, ["conv", "digest"], "many", rows.count(), at)
    return joined.where(F.col("first").isNotNull() & (at > F.col("first"))).groupBy("block").agg(F.collect_list("place").alias("repeated"))


def back(row: int, after: list[int]) -> list[int]:
    """The costs of finishing from each state before a row, from those after it."""
    used = [DELETE + cost for cost in after]
    if not row & (BLANK | REPEATED):
        more = CUT_OFF if row & TRUNCATED else 0
        for s in range(4):
            t = kept(row, s)
            used[s] = min(used[s], REROLE + more + after[NEXT[s]], KEEP + more + after[t] if t is not None else NEVER)
    one = [min(used[s], INSERT + used[NEXT[s]]) for s in range(4)]
    return [min(used[s], INSERT + one[NEXT[s]]) for s in range(4)]


def kept(row: int, state: int) -> int | None:
    """The state after a row that keeps its role, None if the pattern forbids it."""
    role = row & 3
    if role == INITIALS["s"]:
        return SYSTEM if state == START else None
    if role == INITIALS["u"]:
        return None if state == USER else USER
    return DONE if role == INITIALS["a"] and state == USER else None


def walk(kinds: bytes, end: list[int], last: bool) -> list[tuple[str, int]]:
    """For each state that the block is entered in: the ASCII-least tight edits and the state they leave. `end`: the checkpoint behind the block.

    Inserts before a row belong to the row's block, those behind the conversation's last row to the last block.
    """
    costs = [end]
    for row in reversed(kinds):
        costs.append(back(row, costs[-1]))
    costs.reverse()
    out = []
    for state in range(4):
        edits, i = [], 0
        while i < len(kinds) or (last and costs[i][state] > 0):
            here = costs[i][state]
            if i == len(kinds):
                edits.append("I")
                state = NEXT[state]
                continue
            row, after = kinds[i], costs[i + 1]
            more = CUT_OFF if row & TRUNCATED else 0
            t = kept(row, state)
            if here == DELETE + after[state]:
                edits.append("D")
                i += 1
            elif here == INSERT + costs[i][NEXT[state]]:
                edits.append("I")
                state = NEXT[state]
            elif t is not None and here == KEEP + more + after[t]:
                edits.append("K")
                state, i = t, i + 1
            else:
                edits.append("R")
                state, i = NEXT[state], i + 1
        out.append(("".join(edits), state))
    return out


FACTS = T.StructType([*BLOCKS.fields[:3], T.StructField("matrix", T.ArrayType(T.LongType()))])
CHECKPOINTS = T.StructType([T.StructField("block", T.LongType()), T.StructField("checkpoint", T.ArrayType(T.LongType())), T.StructField("last", T.BooleanType())])
LONGS = pa.list_(pa.int64())


def facts(blocks: DataFrame) -> DataFrame:
    """Per block the rows' kinds, repeats included, and the least costs from state to state over its rows, row by row of the matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, matrices = [], []
            for own, repeated in zip(batch.column("kinds").to_pylist(), batch.column("repeated").to_pylist()):
                rows = bytearray(own)
                for place in repeated or ():
                    rows[place] |= REPEATED
                columns = []
                for target in range(4):
                    costs = [0 if s == target else NEVER for s in range(4)]
                    for row in reversed(rows):
                        costs = [min(c, NEVER) for c in back(row, costs)]
                    columns.append(costs)
                kinds.append(bytes(rows))
                matrices.append([columns[t][s] for s in range(4) for t in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(kinds, pa.binary()), pa.array(matrices, LONGS)], names=FACTS.names)

    return blocks.select("conv", "block", "kinds").join(repeats(blocks), "block", "left").select("conv", "block", "kinds", "repeated").mapInArrow(run, FACTS)


def checkpoints(known: DataFrame) -> DataFrame:
    """(block, checkpoint, last): the costs of finishing from each state behind the block. One backward stream over matrices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, costs = None, None
        for batch in batches:
            out, ends = [], []
            for conv, matrix in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist()):
                ends.append(conv != of)
                if conv != of:
                    of, costs = conv, list(FINISH)
                out.append(costs)
                costs = [min(matrix[4 * s + t] + costs[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, LONGS), pa.array(ends, pa.bool_())], names=CHECKPOINTS.names)

    return known.select("conv", "block", "matrix").repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(run, CHECKPOINTS)


WALKS = T.StructType([*BLOCKS.fields[:3], T.StructField("cost", T.LongType()), T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("leaves", T.ArrayType(T.LongType()))])


def walks(known: DataFrame) -> DataFrame:
    """Per block, for each state it may be entered in, the edits and the state left; and the cost from its start on with nothing said."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("kinds", "matrix", "checkpoint", "last")]
            costs = [min(m[t] + end[t] for t in range(4)) for _, m, end, _ in zip(*columns)]
            made = [walk(rows, end, last) for rows, _, end, last in zip(*columns)]
            yield pa.RecordBatch.from_arrays([
                batch.column("conv"), batch.column("block"), batch.column("kinds"), pa.array(costs, pa.int64()),
                pa.array([[a for a, _ in m] for m in made], pa.list_(pa.string())), pa.array([[s for _, s in m] for m in made], LONGS)], names=WALKS.names)

    return known.join(checkpoints(known), "block").select("conv", "block", "kinds", "matrix", "checkpoint", "last").mapInArrow(run, WALKS)


REPAIRS = T.StructType([T.StructField("conv", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
                        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


class Report:
    """What one conversation's stream of blocks adds up to."""

    def __init__(self, conv: str, cost: int) -> None:
        self.conv, self.cost, self.state, self.before = conv, cost, START, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.audit, self.digest, self.said = [], hashlib.sha256(), False

    def enter(self, kinds: bytes, audits: list[str], leaves: list[int]) -> list[str]:
        """Counts the block's faults; returns its edits from the state that the conversation is in."""
        for row in kinds:
            if row & BLANK:
                self.blank += 1
            elif row & REPEATED:
                self.duplicate += 1
            elif row & TRUNCATED:
                self.truncated += 1
            self.illegal += self.before is not None and (self.before, row & 3) not in LEGAL
            self.before = row & 3
        self.audit.append(audits[self.state])
        self.entered, self.state = self.state, leaves[self.state]
        return self.audit[-1]

    def say(self, edits: str, roles: list[str], texts: list[str]) -> None:
        """Adds the block's repaired turns to the digest."""
        state, rows = self.entered, zip(roles, texts)
        for edit in edits:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            if edit == "K":
                state = kept(INITIALS.get(role[:1], OTHER), state)
            else:
                state = NEXT[state]
                role = "user" if state == USER else "assistant"
            self.digest.update((("\n" if self.said else "") + f"{role}:{text}").encode())
            self.said = True

    def row(self) -> tuple:
        return self.conv, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def report(blocks: DataFrame, walked: DataFrame) -> DataFrame:
    """One row per conversation, from one forward stream in which a block's walks come just before its texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, edits = None, ""
        done = lambda r: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r.row(), [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()])], names=REPAIRS.names)
        for batch in batches:
            for conv, texts, kinds, cost, audits, leaves, roles, said in zip(*(batch.column(c).to_pylist() for c in ("conv", "is_text", "kinds", "cost", "audits", "leaves", "roles", "texts"))):
                if of is None or conv != of.conv:
                    if of is not None:
                        yield done(of)
                    of = Report(conv, cost)
                if texts:
                    of.say(edits, roles, said)
                else:
                    edits = of.enter(kinds, audits, leaves)
        if of is not None:
            yield done(of)

    steps = walked.withColumn("is_text", F.lit(False)).unionByName(blocks.select("conv", "block", "roles", "texts").withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    return steps.repartition("conv").sortWithinPartitions("conv", "block", "is_text").mapInArrow(run, REPAIRS)


def repair(rows: DataFrame) -> DataFrame:
    """Per conversation of damaged rows (conv, turn, role, text, copy): faults, cost, audit and digest of the repaired turns."""
    longest = rows.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    blocks = cut(in_blocks(rows, max(LEAST_BLOCK, int(longest ** 0.5))))
    known = cut(facts(blocks))
    return report(blocks, walks(known))


def audit(conversations: DataFrame) -> DataFrame:
    """Damages the conversations, repairs them, and reports on every original conv_id."""
    rows = damaged(conversations)
    out = conversations.select("conv_id").distinct().withColumn("conv", key(F.col("conv_id")))
    out = out.join(turn_gaps(rows), "conv", "left").join(repair(rows), "conv", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = F.col("audit").isNull()
    return out.select("conv_id", *(F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
