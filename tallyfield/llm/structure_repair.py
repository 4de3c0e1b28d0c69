"""Conversation structure repair: the cheapest edits of a dialogue, decided by one integer for each state.

A dialogue must have roles of the form (system? (user assistant)+)?.  Its rows are kept, given another role,
deleted, or preceded by an inserted empty turn.  Every way to edit the rows from a place on is one integer:
its high digits are the cost, its low digits the edits' initials, as many places as any audit can need, the
first edit in the first place and zeros after the last.  So the lesser integer is the cheaper way, or of two
ways of equal cost the one whose audit comes first, and a dynamic program over (row, role state) that takes
integer minima from the last row to the first decides cost and audit at once; the edits are read off the
digits.  A long dialogue is solved in segments, last one first: the low digits then hold one segment's
edits.  That loses nothing, for ways through the same rows hold as many row edits, hence none is the
beginning of another, and what follows can't turn their order.

Spark orders the rows and finds faults; a row comes to the program as one letter, so that what is gathered
for a dialogue is no longer than the audit it gives back.  Texts are joined to their edits by place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyfield.llm.common import stash
from tallyfield.llm.turns import in_order, turn_key

#: Rows of a segment.
SEGMENT = 256
#: Costs of the edits; an undeleted truncated row costs one more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Digits of the edits' initials, in ASCII order; three bits each.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTER = {v: k for k, v in DIGIT.items()}
BITS = 3

#: Role states: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The role that must come next, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
LEGAL = {"su", "ua", "au"}

#: A row's letter: its role's initial (x: none of s, u, a) as it is, in capitals if its text is truncated,
#: or a digit if it must be deleted (0 to 3: blank, 4 to 7: duplicate, in the order of ROLES).
ROLES = "suax"
LETTERS = ROLES + ROLES.upper() + "01234567"


def _initial(letter: str) -> str:
    return ROLES[LETTERS.index(letter) % 4]


def _solve(rows: str, after: list[int | None]) -> list[int | None]:
    """For each state before ``rows`` the least integer; ``after`` has the costs of what follows, by state."""
    places = 2 * len(rows) + 1  # each row's edit and an insertion before it, one insertion at the end
    width = BITS * places
    low, first = (1 << width) - 1, width - BITS

    def put(letter: str, cost: int, rest: int | None) -> int | None:
        """The integer of this edit followed by those of ``rest``."""
        return None if rest is None else (((rest >> width) + cost) << width) | (DIGIT[letter] << first) | ((rest & low) >> BITS)

    def least(ways: list[int | None]) -> int | None:
        return min((w for w in ways if w is not None), default=None)

    best = [None if c is None else c << width for c in after]
    for letter in reversed(rows):
        role, extra = _initial(letter), TRUNCATED if letter.isupper() else 0
        edited = []
        for q in STATES:
            ways = [put("D", DELETE, best[q])]
            if not letter.isdigit():
                ways.append(put("R", REROLE + extra, best[NEXT[q][1]]))
                if role == NEXT[q][0][0]:
                    ways.append(put("K", KEEP + extra, best[NEXT[q][1]]))
                elif role == "s" and q == START:
                    ways.append(put("K", KEEP + extra, best[SYSTEM]))
            edited.append(least(ways))
        # two insertions in a row bring back the state before them, or cost more than the row they serve
        best = [least([edited[q], put("I", INSERT, edited[NEXT[q][1]])]) for q in STATES]
    return best


def _digits(value: int, rows: int) -> str:
    """The audit that the low digits of a segment's integer hold."""
    first, out = BITS * 2 * rows, []
    while first >= 0 and (d := (value >> first) & ((1 << BITS) - 1)):
        out.append(LETTER[d])
        first -= BITS
    return "".join(out)


def _walk(rows: str, audit: str, state: int) -> Iterator[tuple[int | None, str, str | None]]:
    """(row or None, edit, new role or None) of each edit; a generator that returns the state it ends in."""
    at = 0
    for edit in audit:
        role = None
        if edit == "D":
            pass
        elif edit == "K" and state == START and _initial(rows[at]) == "s":
            state = SYSTEM
        else:
            role, state = NEXT[state] if edit != "K" else (None, NEXT[state][1])
        yield (None if edit == "I" else at), edit, role
        at += edit != "I"
    return state


def repair_plan(segments: list[str]) -> tuple[int, str, list[tuple[int | None, str, str | None]]]:
    """Cost, audit and edits of a dialogue whose rows' letters come in segments, in order."""
    # at the end a user turn may be answered by an insertion; after a lone system turn two would be needed,
    # which cost more than to delete it
    ending = [0, None, INSERT, 0]
    solved, costs = [], ending
    for rows in reversed(segments):
        solved.append(_solve(rows, costs))
        costs = [None if v is None else v >> (BITS * (2 * len(rows) + 1)) for v in solved[-1]]
    state, audit, edits, done = START, [], [], 0
    for rows, best in zip(segments, reversed(solved), strict=True):
        piece = _digits(best[state], len(rows))
        steps = _walk(rows, piece, state)
        while True:
            try:
                row, edit, role = next(steps)
            except StopIteration as end:
                state = end.value
                break
            edits.append((None if row is None else done + row, edit, role))
        audit.append(piece)
        done += len(rows)
    if state == USER:
        audit.append("I")
        edits.append((None, "I", "assistant"))
    return costs[START], "".join(audit), edits


_REPORT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_EDITS = "conv_id long, place long, pos long, edit string, role string"
_REPORT_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_EDITS_ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string())])


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, segments in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            rows = "".join(segments)
            roles = "".join(map(_initial, rows))
            illegal = sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
            cost, audit, _ = repair_plan(segments)
            out.append((conv, sum(r in "0123" for r in rows), sum(r in "4567" for r in rows), sum(r.isupper() for r in rows), illegal, cost, audit))
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(_REPORT_ARROW.names, zip(*out, strict=True), strict=True)), _REPORT_ARROW)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, segments in zip(batch.column("conv_id").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            for place, (row, edit, role) in enumerate(repair_plan(segments)[2], 1):
                if edit != "D":
                    out.append((conv, place, None if row is None else row + 1, edit, role))
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_pydict(dict(zip(_EDITS_ARROW.names, zip(*out, strict=True), strict=True)), _EDITS_ARROW)
                    out = []
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(_EDITS_ARROW.names, zip(*out, strict=True), strict=True)), _EDITS_ARROW)


def letters(rows: DataFrame) -> DataFrame:
    """conv_id, pos, letter of rows with conv_id, pos, key, role and text (no nulls in the last two).

    A row is blank without a character other than white space; else duplicate if an earlier row of its
    dialogue has its role and text; else truncated if its last such character is none of . ! ?
    """
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\f\r")), -1, 1)
    slim = rows.select("conv_id", "pos", "key", F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))
    first = slim.groupBy(F.col("conv_id").alias("of_conv"), F.col("key").alias("of_key")).agg(F.min("pos").alias("first"))
    slim = slim.join(first, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("key") == F.col("of_key")))
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES[:3]), F.col("initial")), F.lit(0)), F.lit(4))
    role = F.when(F.col("initial") == "", 4).otherwise(role)
    fault = F.when(F.col("blank"), 8).when(F.col("first") < F.col("pos"), 12).when(F.col("truncated"), 4).otherwise(0)
    return slim.select("conv_id", "pos", F.substring(F.lit(LETTERS), role + fault, F.lit(1)).alias("letter"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report of each dialogue and its repaired turns.

    ``rows`` has conv_id, turn, role, text; others aren't read.  Rows are taken by turn, nulls first, rows of
    one turn by the digest of role and text.  Rows of a null conv_id are one dialogue; a null role or text
    counts as one space, a role that isn't system, user or assistant (by its initial) can only be given
    another or be deleted.  The report: conv_id, blank, duplicate, truncated, illegal (adjacent roles that
    don't follow each other), cost, audit.  The turns: conv_id, place, role, text.  No rows, no reports.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    rows = stash(in_order(rows.withColumn("key", turn_key(F.col("role"), F.col("text"))), "key").select("conv_id", "pos", "key", "role", "text"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c]), "")
    pieces = letters(rows).groupBy("conv_id", F.floor((F.col("pos") - 1) / SEGMENT).alias("segment")).agg(joined("letter").alias("rows"))
    segments = F.transform(F.array_sort(F.collect_list(F.struct("segment", "rows"))), lambda x: x["rows"])
    dialogues = stash(pieces.groupBy("conv_id").agg(segments.alias("segments")))
    edits = dialogues.mapInArrow(_edits, _EDITS).withColumnsRenamed({"conv_id": "of_conv", "pos": "of_pos", "role": "new_role"})
    here = rows.select("conv_id", "pos", "role", "text")
    found = edits.join(here, F.col("of_conv").eqNullSafe(F.col("conv_id")) & (F.col("of_pos") == F.col("pos")), "left")
    turns = found.select(F.col("of_conv").alias("conv_id"), "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return dialogues.mapInArrow(_reports, _REPORT), turns
