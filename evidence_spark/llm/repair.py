"""Conversation structure repair: the cheapest edits that make a conversation alternate, found as a lightest derivation."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Faults of a row, the first of which counts.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: States of `(s?(ua)+)?`: at its start, after s, after u, after a. Each wants one of the roles below next.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = ("user", "user", "assistant", "user")
#: (state before, role's initial) of the steps that lead into each state.
INTO = {START: (), SYSTEM: ((START, "s"),), USER: ((START, "u"), (SYSTEM, "u"), (ASSISTANT, "u")), ASSISTANT: ((USER, "a"),)}
STEP = {(before, initial): state for state, steps in INTO.items() for before, initial in steps}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
REROLE, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"


def cheapest_edits(initials: list[str], faults: bytearray) -> tuple[int, str]:
    """(cost, edits' initials in order) of the cheapest repair; of equal costs the ASCII-least edits.

    Knuth's lightest derivation. An item (row, state) says that the rows from there on can end well from this state. A deduction
    takes an edit of the row before (Keep, Rerole, Delete; with its weight) and an item, or an item alone (Insert), and gives
    another item, whose edits are the deduction's letter and then the item's. The agenda pops by (cost, rows taken, first letter): every
    deduction leads to a later place in this order, so what is popped first is final. Two deductions of one item never have the
    same letter, so the first letter decides between whole strings of edits. Cyclic deductions (inserts) only add cost.
    """
    n = len(initials)
    most = 1 << 62
    # of an item, 4 * row + state: cost and letter of the best deduction so far, as cost * 128 + letter
    best, done = array("q", [most]) * (4 * n + 4), bytearray(4 * n + 4)
    agenda: list[tuple[int, int, int, int]] = []  # cost, rows taken, letter, item

    def deduce(cost: int, taken: int, letter: str, item: int) -> None:
        value = cost * 128 + ord(letter)
        if value < best[item]:
            best[item] = value
            heappush(agenda, (cost, taken, ord(letter), item))

    for state in (START, ASSISTANT):
        deduce(0, 0, "\0", 4 * n + state)
    while not done[START]:
        cost, taken, _, item = heappop(agenda)
        if done[item]:
            continue
        done[item] = 1
        row, state = item >> 2, item & 3
        stays = bool(row) and faults[row - 1] not in (BLANK, DUPLICATE)
        late = cost + (CUT_SHORT if stays and faults[row - 1] == TRUNCATED else 0)
        if row:
            deduce(cost + DELETE, taken + 1, "D", item - 4)
        for before, symbol in INTO[state]:
            if stays and initials[row - 1] == symbol:
                deduce(late, taken + 1, "K", 4 * row - 4 + before)
            if symbol != "s":
                if stays:
                    deduce(late + REROLE, taken + 1, "R", 4 * row - 4 + before)
                deduce(cost + INSERT, taken, "I", 4 * row + before)
    edits, row, state = bytearray(), 0, START
    while letter := best[4 * row + state] & 127:
        edits.append(letter)
        if letter == ord("K"):
            state = STEP[state, initials[row]]
        elif letter != ord("D"):
            state = STEP[state, WANTED[state][0]]
        row += letter != ord("I")
    return best[START] >> 7, edits.decode()


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with _turn, _role, _text (nulls: one space), and a digest of conversation, role and text."""
    null = F.lit(" ")
    out = rows.select(
        "conv_id", F.col("turn").cast("long").alias("_turn"), F.coalesce("role", null).alias("_role"), F.coalesce("text", null).alias("_text"),
        (F.coalesce("_gone", F.lit(False)) if "_gone" in rows.columns else F.lit(False)).alias("_gone"),
    )
    conv = F.coalesce(F.col("conv_id").cast("string"), null)
    return out.withColumn("_digest", F.unhex(F.sha2(F.concat(conv, F.lit(":"), F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Whole conversations in a partition each, their rows by turn (nulls first), role and digest."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.col("_turn").asc_nulls_first(), "_role", "_digest")


_FOUND = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads ordered rows and gives each conversation's counts and edits; of a conversation it holds initials and faults only."""
    kind, none = None, object()
    conv, out = none, []
    initials: list[str] = []
    faults, turns, illegal, last_turn, last = bytearray(), 0, 0, None, None
    first_turn = None

    def close() -> None:
        gaps = min(last_turn - first_turn + 1 - turns, 2**63 - 1) if turns else 0
        cost, audit = cheapest_edits(initials, faults)
        out.append((conv, gaps, *(faults.count(k) for k in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit))

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * (1 + len(_FIELDS))
        out.clear()
        kinds = [kind, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", *_FIELDS])

    for batch in batches:
        kind = batch.schema.field(0).type
        for own, turn, initial, fault, gone, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv is none or own != conv:
                if conv is not none:
                    close()
                conv, initials, faults = own, [], bytearray()
                turns, illegal, first_turn, last_turn, last = 0, 0, None, None, None
            if gone:
                continue
            if turn is not None and turn != last_turn:
                first_turn = turn if first_turn is None else first_turn
                last_turn, turns = turn, turns + 1
            if fault != BLANK and last == (turn, digest):
                fault = DUPLICATE  # equal rows of one turn stand together
            if initials and (initials[-1], initial) not in LEGAL:
                illegal += 1
            last = (turn, digest)
            initials.append(initial)
            faults.append(fault)
        if len(out) >= 1000:
            yield flushed()
    if conv is not none:
        close()
        yield flushed()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each conversation's plan and then its rows, and hashes the repaired rows as they pass."""
    kind, conv, out = None, None, []
    digest, letters, at, state, begun = hashlib.sha256(), "", 0, START, False

    def put(role: str, text: str) -> None:
        nonlocal begun
        digest.update(f"{chr(10) * begun}{role}:{text}".encode())
        begun = True

    def inserted() -> None:
        nonlocal at, state
        while at < len(letters) and letters[at] == "I":
            put(WANTED[state], "")
            state, at = STEP[state, WANTED[state][0]], at + 1

    def close() -> None:
        if conv is not None:
            inserted()
            out.append((*conv, digest.hexdigest()))

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * (2 + len(_FIELDS))
        out.clear()
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", *_FIELDS, "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for own, plan, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if plan is not None:
                close()
                conv, letters = (own, *plan.values()), plan["audit"]
                digest, at, state, begun = hashlib.sha256(), 0, START, False
                continue
            inserted()
            edit, at = letters[at], at + 1
            if edit == "D":
                continue
            role = role if edit == "K" else WANTED[state]
            state = STEP[state, role[0]]
            put(role, text)
        if len(out) >= 1000:
            yield flushed()
    close()
    if out:
        yield flushed()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows`: conv_id, turn, role, text, and perhaps _gone: such a row only makes its conversation known. Rows stand by turn, nulls
    first; rows of equal turn by role, then digest, so equal rows stand together. Null roles and texts are one space. A null conv_id is
    a conversation like others. An empty role has no initial and can't be kept. A row's first fault counts: blank, duplicate (its role and
    text stand earlier), truncated (its last character other than white space is not `.`, `!` or `?`). A conversation
    without rows needs no edits. An empty table gives no rows; further columns are ignored.

    The plan is made from small rows (initial, fault, digest), the texts are shuffled once, after it. Where a text stands first is a sum by
    digest, so no set of texts is held. A conversation's rows pass through one task as a sorted stream, as its hash needs all of
    them in order: the task holds its agenda (under 1 KB a row), never its texts.
    """
    marked = _marked(rows)
    solid = F.rtrim("_text", F.lit(SPACES))
    small = marked.select(
        "conv_id", "_turn", "_role", "_gone", "_digest", (solid == "").alias("_blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("_cut")
    )
    first = small.filter("not _gone").groupBy("_digest").agg(F.min(F.struct("_turn")).alias("_first"), F.count(F.lit(1)).alias("_times")).filter("_times > 1")
    known = small.join(first.drop("_times"), "_digest", "left")
    again = F.coalesce(~F.col("_first._turn").eqNullSafe(F.col("_turn")) & F.col("_first").isNotNull(), F.lit(False))
    fault = F.when(F.col("_blank"), BLANK).when(again, DUPLICATE).when(F.col("_cut"), TRUNCATED).otherwise(0)
    known = known.select("conv_id", "_turn", "_role", F.substring("_role", 1, 1).alias("_initial"), fault.alias("_fault"), "_gone", "_digest")
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = _in_order(known).select("conv_id", "_turn", "_initial", "_fault", "_gone", "_digest")
    plans = ordered.mapInArrow(_plan, _FOUND.format(kind))
    none = {c: F.lit(None).cast(t) for c, t in (("_turn", "long"), ("_role", "string"), ("_text", "string"), ("_digest", "binary"))}
    heads = plans.select("conv_id", F.struct(*_FIELDS).alias("_plan")).withColumns(none)
    texts = marked.filter("not _gone").select("conv_id", F.lit(None).cast(heads.schema["_plan"].dataType).alias("_plan"), "_turn", "_role", "_text", "_digest")
    both = heads.unionByName(texts).withColumn("_body", F.col("_plan").isNull())
    stream = _in_order(both, "_body").select("conv_id", "_plan", "_role", "_text")
    return stream.mapInArrow(_write, _FOUND.format(kind) + ", repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with planted damage, chosen by crc32 of `conv_id:turn` modulo 20; nulls count as one space.

    0 drops a row (it stays with _gone set, so that its conversation is still known), 1 empties its text, 2 takes `.`, `!` and `?` out, 3
    repeats it, 4 makes its role user.
    """
    null = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), null), F.lit(":"), F.coalesce(F.col("turn").cast("string"), null))
    kind: Column = F.crc32(key) % 20
    text = F.coalesce("text", null)
    hurt = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", null)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("_gone"), F.when(kind == 3, 2).otherwise(1).alias("_copies"),
    )
    return hurt.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copy", "_copies")
