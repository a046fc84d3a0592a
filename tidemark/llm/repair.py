"""Repair of the turn structure of conversations by cheapest edits.

The initials of a conversation's roles shall be ``(s?(ua)+)?``: nothing, or an optional system turn and pairs of a
user and an assistant turn.  Edits are Keep (0), Rerole to user or assistant (1), Delete (2, required for blank and
duplicate turns) and Insert of an empty user or assistant turn (5); a truncated turn that stays costs 5 more.

Cost layers: a register is a row of bitsets, one for each cost, of the four grammar states (start, after s, after u,
after a) from which the turns that follow can be accepted at exactly this cost.  The register of a turn comes from
that of the next turn by shifts, since an edit moves all layers at once: Keep by no layer, Rerole by one, Delete by
two, Insert by five.  The first layer of the first turn's register that holds the start state is the least cost.  From
there a bit-trace follows the set of states that the letters chosen so far reach, and takes at each place the least
letter that keeps a state in the layer of the cost left; that is the least audit.

Ten layers above the lowest are enough: from each state two inserts, or one insert and a deletion, lead to all that
any other can do, so a state costs at most ten more than the best one, and a path through one that costs more is not
among the cheapest.  So a turn is one number of 44 bits, and time grows with the turns.

Conversations are sorted by a shuffle and streamed: first what the grammar needs (a task holds some 70 bytes for each
turn of one conversation while it looks for duplicates and decides), then the texts, one at a time, along the decided
edits.  A conversation stays in one task, since its hash and its least audit depend on
all turns before.

Defined cases: nulls in conv_id, turn, role and text count as one space when rows are damaged, and afterwards in role
and text; a null conv_id is one conversation; null turns come first; turns that tie are taken by role and
text, in the order of their bytes; equal rows are duplicates of each other; a role without any letter can't be kept; a conversation that
loses all rows has zeros, an empty audit and the hash of an empty string; a very long text is held once by one task; an
empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BLANKS = " \t\n\x0b\x0c\r"
RULED = ["blank", "duplicate", "truncated", "illegal"]
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: States of the grammar, as bits of a layer: start, after s, after u, after a.
START, AFTER_S, AFTER_U, AFTER_A = 1, 2, 4, 8
LAYERS = 11
FULL = (1 << 4 * LAYERS) - 1
_EACH = FULL // 15
#: What a turn is to the grammar: its initial and whether it must go or is cut off.
OTHER, S, U, A = 0, 1, 2, 3
MUST_GO, TRUNCATED = 4, 8


def before(register: int, initial: int) -> int:
    """The states of each layer from which a turn with this initial leads into the layer."""
    if initial == U:
        x = register & _EACH * AFTER_U
        return x >> 2 | x >> 1 | x << 1
    if initial == A:
        return (register & _EACH * AFTER_A) >> 1
    return (register & _EACH * AFTER_S) >> 1 if initial == S else 0


def after(states: int, initial: int) -> int:
    """The states that a turn with this initial leads to."""
    if initial == U:
        return AFTER_U if states & (START | AFTER_S | AFTER_A) else 0
    if initial == A:
        return AFTER_A if states & AFTER_U else 0
    return AFTER_S if initial == S and states & START else 0


def _inserted(register: int) -> int:
    for _ in range(2):
        register |= (before(register, U) | before(register, A)) << 4 * INSERT
    return register & FULL


def layers(turns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each turn, and for the end, its register and the cost of the lowest layer."""
    register, base = _inserted(START | AFTER_A), 0
    registers, bases = np.zeros(len(turns) + 1, np.int64), np.zeros(len(turns) + 1, np.int64)
    registers[-1] = register
    for k in range(len(turns) - 1, -1, -1):
        turn, now = int(turns[k]), register << 4 * DELETE
        if not turn & MUST_GO:
            stays = before(register, turn & 3) << 4 * KEEP | (before(register, U) | before(register, A)) << 4 * REROLE
            now |= stays << (4 * CUT if turn & TRUNCATED else 0)
        step = ((now & -now).bit_length() - 1) // 4
        register, base = _inserted(now >> 4 * step), base + step
        registers[k], bases[k] = register, base
    return registers, bases


def cheapest(turns: np.ndarray) -> tuple[int, str]:
    """The least cost, and the least of the audits that have it."""
    registers, bases = layers(turns)
    first = registers[0].item()
    left = bases[0].item() + next(c for c in range(LAYERS) if first >> 4 * c & START)
    cost, states, k, out, n = left, START, 0, [], len(turns)

    def layer(place: int, rest: int) -> int:
        c = rest - bases[place].item()
        return registers[place].item() >> 4 * c & 15 if 0 <= c < LAYERS else 0

    while k < n or left:
        turn = int(turns[k]) if k < n else MUST_GO
        some = after(states, U) | after(states, A)
        extra = CUT if turn & TRUNCATED else 0
        moves = [("D", states, 1, DELETE)] if k < n else []
        moves.append(("I", some, 0, INSERT))
        if not turn & MUST_GO:
            moves += [("K", after(states, turn & 3), 1, KEEP + extra), ("R", some, 1, REROLE + extra)]
        for letter, reached, step, price in moves:
            reached &= layer(k + step, left - price)
            if reached:
                out.append(letter)
                states, k, left = reached, k + step, left - price
                break
    return cost, "".join(out)


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, text: rows dropped, emptied, stripped of sentence ends, repeated or given to the user, by a checksum of conversation and turn."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind")).filter("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv", "turn", "role", "text")


def _sorted(rows: DataFrame, *more: str) -> DataFrame:
    """Each conversation in one partition, in order; nulls first, as ascending sorts have them."""
    return rows.repartition("conv").sortWithinPartitions("conv", *more, "turn", "role", "text")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(OTHER)


def _runs(values: list) -> Iterator[tuple[int, int]]:
    """Where runs of equal neighbours begin and end."""
    lo = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[lo]:
            yield lo, k
            lo = k


def _judge(conv, parts: list[dict]) -> tuple:
    """One row of ``decisions`` from the columns of a conversation's turns."""
    ka, kb, marks, turn = (np.concatenate([p[c] for p in parts]) for c in ("ka", "kb", "marks", "turn"))
    null = np.concatenate([p["null"] for p in parts])
    order = np.lexsort((kb, ka))  # stable: the first of equals comes first
    again = np.zeros(len(ka), bool)
    again[order[1:]] = (ka[order[1:]] == ka[order[:-1]]) & (kb[order[1:]] == kb[order[:-1]])
    blank = marks & MUST_GO > 0
    duplicate = again & ~blank
    truncated = (marks & TRUNCATED > 0) & ~blank & ~again
    turns = (marks & 3 | MUST_GO * (blank | duplicate) | TRUNCATED * truncated).astype(np.int8)
    a, b = turns[:-1] & 3, turns[1:] & 3
    legal = ((b == U) & ((a == S) | (a == A))) | ((b == A) & (a == U))
    known = turn[~null]
    gaps = int(known[-1]) - int(known[0]) + 1 - (1 + int((known[1:] != known[:-1]).sum())) if len(known) else 0
    cost, audit = cheapest(turns)
    return conv, gaps, int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), int((~legal).sum()), cost, audit


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, parts, out = None, [], []

    def close() -> None:
        if parts:
            out.append(_judge(name, parts))
            parts.clear()

    def decided(kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 8
        out.clear()
        arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]], pa.array(columns[7], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["conv", "gaps", *RULED, "cost", "audit"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv").type
        turn = batch.column("turn")
        cols = {c: batch.column(c).to_numpy() for c in ("ka", "kb", "marks")} | {"turn": turn.fill_null(0).to_numpy(), "null": np.array(turn.is_null())}
        names = batch.column("conv").to_pylist()
        for lo, hi in _runs(names):
            if names[lo] != name:
                close()
                name = names[lo]
            parts.append({c: x[lo:hi] for c, x in cols.items()})
        yield decided(kind)
    if kind is not None:
        close()
        yield decided(kind)


def decisions(rows: DataFrame) -> DataFrame:
    """rows: conv, turn, role, text.  One row a conversation: gaps, counts of faults, cost and audit."""
    small_batches(rows.sparkSession, 10_000)
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    cut = ~F.substring(body, -1, 1).isin(".", "!", "?")
    marks = _initial(F.col("role")) + F.when(body == "", MUST_GO).when(cut, TRUNCATED).otherwise(0)
    key = lambda *salt: F.xxhash64(*salt, F.col("role"), F.lit(0), F.col("text"))
    line = _sorted(rows).select("conv", F.col("turn").cast("bigint").alias("turn"), key().alias("ka"), key(F.lit(7)).alias("kb"), marks.cast("tinyint").alias("marks"))
    kind = rows.schema["conv"].dataType.simpleString()
    return line.mapInArrow(_decide, f"conv {kind}, gaps bigint, {', '.join(f'{c} bigint' for c in RULED)}, cost bigint, audit string")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of a conversation comes first, then its turns."""
    place, letters, at, expected = 0, "", 0, "user"
    for batch in batches:
        out = []

        def inserts(conv) -> None:
            nonlocal at, place, expected
            while at < len(letters) and letters[at] == "I":
                out.append((conv, place, "I", None, expected, ""))  # noqa: B023
                at, place, expected = at + 1, place + 1, "assistant" if expected == "user" else "user"

        for conv, audit, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "turn", "role", "text")), strict=True):
            if audit is not None:
                place, letters, at, expected = 0, audit, 0, "user"
                inserts(conv)
                continue
            letter = letters[at]
            at += 1
            if letter != "D":
                role = expected if letter == "R" else role
                out.append((conv, place, letter, turn, role, text))
                place, expected = place + 1, "assistant" if role[0] == "u" else "user"
            inserts(conv)
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [batch.schema.field("conv").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv", "place", "edit", "turn", "role", "text"])


def repaired(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv, place (from 0), edit, turn (null where inserted), role, text.
    Each conversation lies in one partition, in order."""
    turns = rows.select("conv", F.lit(1).alias("then"), F.col("turn").cast("bigint").alias("turn"), "role", "text", F.lit(None).cast("string").alias("audit"))
    none = lambda c: F.lit(None).cast(turns.schema[c].dataType).alias(c)
    heads = decided.select("conv", F.lit(0).alias("then"), none("turn"), none("role"), none("text"), "audit")
    kind = rows.schema["conv"].dataType.simpleString()
    return _sorted(heads.union(turns), "then").mapInArrow(_apply, f"conv {kind}, place bigint, edit string, turn bigint, role string, text string")


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, digest, kind = None, None, None
    for batch in batches:
        kind, out = batch.schema.field("conv").type, []
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "place", "role", "text")), strict=True):
            if place == 0:
                if digest is not None:
                    out.append((name, digest.hexdigest()))
                name, digest = conv, sha256()
            digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out], pa.string())], ["conv", "repaired_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([digest.hexdigest()], pa.string())], ["conv", "repaired_sha256"])


def digests(turns: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of the turns that ``repaired`` returns, as they lie in its partitions."""
    return turns.mapInArrow(_hash, f"conv {turns.schema['conv'].dataType.simpleString()}, repaired_sha256 string")
