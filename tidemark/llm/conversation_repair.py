"""Repair of conversations at least cost: one scalar per state holds the cost and the audit of the best edits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLANKS = " \t\n\v\f\r"
ENDS = (".", "!", "?")
LEGAL_PAIRS = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

#: Where a role initial leads: 0 nothing yet, 1 after s, 2 after u, 3 after a.  0 and 3 may end.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only role of ROLES that may follow in each state.
WANTED = ("u", "u", "a", "u")
#: Roles inserted after the last row, by state.
CLOSING = ("", "ua", "a", "")

KEEP, REROLE, DELETE, INSERT, SHORT = 0, 2, 3, 2, 1
#: Digits in the order of the letters in ASCII; 0 pads the end.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = " DIKR"
BITS = 3
#: Rows whose scalars are made together.
BLOCK_ROWS = 256

REPORT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired array<struct<role:string,text:string>>"
)


def block_edits(rows: list[tuple[str, bool, bool]], ends: list[int]) -> list[tuple[int, str]]:
    """Per entry state the least cost up to the end of the conversation and the audit of these rows.

    ``rows``: role initial, whether it must go, whether it ends early.  ``ends``:
    cost of all that follows, per state.  A scalar has the cost in its high
    digits; below stand ``width`` digits, one per letter of the audit from the
    highest on, zeros behind the last.  Putting a letter in front shifts the
    low digits by one place and adds one weight, so the least of the scalars is
    least in cost, then in ASCII.

    Edits of later blocks need no digits: an audit of these rows ends with the
    letter of their last row, so two different ones differ before either ends,
    and equal ones lead to the same state.
    """
    width = 3 * len(rows)  # at most two rows go in before each
    high = BITS * width
    low = (1 << high) - 1
    weight = {(cost, letter): (cost << high) + (digit << (high - BITS)) for letter, digit in DIGITS.items() for cost in range(4)}
    best = [cost << high for cost in ends]
    for initial, gone, short in reversed(rows):
        behind = [v - (v & low) + ((v & low) >> BITS) for v in best]
        taken = [v + weight[DELETE, "D"] for v in behind]
        if not gone:
            for state, steps in enumerate(STEPS):
                if initial in steps:
                    taken[state] = min(taken[state], behind[steps[initial]] + weight[KEEP + short, "K"])
                taken[state] = min(taken[state], behind[steps[WANTED[state]]] + weight[REROLE + short, "R"])
        best = taken
        for _ in range(2):
            behind = [v - (v & low) + ((v & low) >> BITS) for v in best]
            best = [min(v, behind[steps[wanted]] + weight[INSERT, "I"]) for v, steps, wanted in zip(taken, STEPS, WANTED, strict=True)]
    letters = [f"{v & low:0{width}o}".rstrip("0") for v in best]
    return [(v >> high, "".join(LETTERS[int(x)] for x in t)) for v, t in zip(best, letters, strict=True)]


def replay(audit: str, initials: list[str], state: int) -> Iterator[tuple[str, int, str, int]]:
    """Letter, row number, role initial of the result (empty where deleted) and the state after it, in turn."""
    k = 0
    for letter in audit:
        role = "" if letter == "D" else initials[k] if letter == "K" else WANTED[state]
        state = STEPS[state][role] if role else state
        yield letter, k, role, state
        k += letter != "I"


def least_edits(rows: list[tuple[str, bool, bool]]) -> tuple[int, str]:
    """Least cost and, among the edits of that cost, the audit least in ASCII."""
    blocks = [rows[k : k + BLOCK_ROWS] for k in range(0, len(rows), BLOCK_ROWS)]
    ends, solved = [INSERT * len(x) for x in CLOSING], []
    for block in reversed(blocks):
        solved.append(block_edits(block, ends))
        ends = [cost for cost, _ in solved[-1]]
    state, audit = 0, []
    for block, options in zip(blocks, reversed(solved), strict=True):
        audit.append(options[state][1])
        for *_, state in replay(audit[-1], [r[0] for r in block], state):
            pass
    return ends[0], "".join(audit) + "I" * len(CLOSING[state])


def repaired(turns: list[int | None], said: list[tuple[str, str]]) -> dict:
    """The report of one conversation; rows in order as (role, text)."""
    seen, rows, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text in said:
        body = text.rstrip(BLANKS)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body.endswith(ENDS) else "truncated"
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = least_edits(rows)
    out = []
    for letter, k, role, _ in replay(audit, [r[0] for r in rows], 0):
        if letter != "D":
            out.append({"role": said[k][0] if letter == "K" else ROLES[role], "text": "" if letter == "I" else said[k][1]})
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0, **faults,
        "illegal": sum(a[0] + b[0] not in LEGAL_PAIRS for a, b in pairwise(rows)), "cost": cost, "audit": audit, "repaired": out,
    }


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_col``, its faults, ``cost``, ``audit`` and the ``repaired`` turns.

    Rows follow each other by turn (nulls first), then role and text; null roles
    and texts count as one space.  The first fault of a row counts: ``blank`` (no
    ``[^\\x20\\x09-\\x0D]``), ``duplicate`` (role and text stood earlier),
    ``truncated`` (the last such character is none of ``.!?``).  ``illegal``
    counts neighbours whose role initials are not su, ua or au, ``gaps`` the turns
    missing between the first and the last.

    Edits: keep a row (0), give it the role user or assistant (2), delete it (3;
    blank and duplicate rows must go), insert an empty user or assistant row (2);
    a truncated row that stays adds 1.  The cheapest edits that leave role
    initials ``(s?(ua)+)?`` are taken; ``audit`` has their initials in order, the
    least in ASCII among equal costs.

    A null id is a conversation, rows equal in everything are rows of their own, other columns are
    ignored, an empty table gives an empty result.  Rows are shuffled once; one
    task streams through its conversations and holds one at a time, since its
    audit and its turns are one row.
    """
    said = [F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    named = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), *said)
    ordered = named.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = StructType([named.schema["conv"], *StructType.fromDDL(REPORT).fields])
    target = to_arrow_schema(schema)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, turns, pairs = [], None, [], []
        for batch in batches:
            for c, turn, role, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if pairs and c != conv:
                    done.append({"conv": conv} | repaired(turns, pairs))
                    turns, pairs = [], []
                conv = c
                turns.append(turn)
                pairs.append((role, text))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=target)
                done = []
        if pairs:
            yield pa.RecordBatch.from_pylist([{"conv": conv} | repaired(turns, pairs)], schema=target)

    return ordered.mapInArrow(repair, schema).withColumnRenamed("conv", conv_col)
