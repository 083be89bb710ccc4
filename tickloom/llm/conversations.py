"""Structure repair of conversations by depth-first branch-and-bound.

The rows of a conversation are reduced to one letter each: its role and its first fault. A search over the edits of a
stretch of letters keeps an explicit stack, a bound on the cost of every suffix, the best (cost, audit) so far, and for
each node (row, grammar state) the best prefix that reached it; it ends when no open prefix can beat the incumbent.

Rows are dealt by ranges of (conversation, turn), so one conversation may lie in many tasks. Where a conversation is cut,
and within long ones, each stretch of at most SEGMENT rows is solved for every pair of grammar states at its ends; the
stretches are then chained. Texts take no part in this: they are read once more, in order, to write the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialized

#: Rows that one search looks at.
SEGMENT = 64
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What ends a conversation in each state: cost and edits.
CLOSING = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}
INITIALS, FAULTS = "sua-", ("none", "blank", "duplicate", "truncated")
SPACE = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows after a damage that depends on the CRC-32 of ``conv_id:turn`` alone; nulls of
    role and text, and in the key, are one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                                           F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1).cast("int"))).alias("copy"))
    return rows.drop("copy")


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))


def _letters(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, letter, fault, copies): rows that repeat turn, role and text as one."""
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    kept = F.expr(rf"trim(TRAILING '{SPACE}' FROM text)")
    fault = F.when(F.length(kept) == 0, 1).when(~F.substring(kept, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    rows = rows.select("conv_id", "turn", _digest().alias("digest"), letter.alias("letter"), fault.alias("fault"))
    rows = rows.groupBy("conv_id", "turn", "digest", "letter", "fault").agg(F.count("*").alias("copies"))
    # where a role and text stands at several turns, all but the first are duplicates
    seen = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    often = rows.groupBy("conv_id", "digest").agg(F.min(seen).alias("first"), F.count("*").alias("n")).filter("n > 1")
    often = often.select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    rows = rows.join(often.hint("shuffle_merge"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return rows.select("conv_id", "turn", "digest", "letter", "fault", "copies", F.coalesce(again, F.lit(False)).alias("again"))


def _bounds(letters: tuple[tuple[str, int], ...]) -> list[tuple[int, int]]:
    """For each row and for a user or an assistant due: the least cost of the rows from there on, if system rows were
    allowed everywhere and the end were free."""
    out = [(0, 0)]
    for initial, fault in reversed(letters):
        user, assistant = out[-1]
        extra = UNFINISHED if fault == 3 else 0
        best = [DELETE + user, DELETE + assistant]
        if fault not in (1, 2):
            best = [min(best[0], REROLE + extra + assistant), min(best[1], REROLE + extra + user)]
            if initial == "s":
                best = [min(best[0], extra + user), min(best[1], extra + assistant)]
            elif initial == "u":
                best[0] = min(best[0], extra + assistant)
            elif initial == "a":
                best[1] = min(best[1], extra + user)
        out.append((min(best[0], INSERT + best[1]), min(best[1], INSERT + best[0])))
    return out[::-1]


def _after(state: int, initial: str) -> int | None:
    """The grammar state after a row with this initial, None where it may not stand."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return None if state == USER else USER
    return ASSISTANT if initial == "a" and state == USER else None


def _choices(letter: tuple[str, int], state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next state, rows consumed) at a row."""
    initial, fault = letter
    turned = ASSISTANT if state == USER else USER
    out = [("D", DELETE, state, 1), ("I", INSERT, turned, 0)]
    if fault not in (1, 2):
        extra = UNFINISHED if fault == 3 else 0
        out.append(("R", REROLE + extra, turned, 1))
        if (kept := _after(state, initial)) is not None:
            out.append(("K", KEEP + extra, kept, 1))
    return out


def search(letters: tuple[tuple[str, int], ...], state: int, ends: dict[int, tuple[int, str]]) -> tuple[int, str] | None:
    """The least (cost, audit) from a grammar state to one of ``ends``, whose own cost and edits are added."""
    bounds, n = _bounds(letters), len(letters)
    best: tuple[int, str] | None = None
    reached = {(0, state): (0, "")}
    stack = [(0, state, 0, "")]
    while stack:
        row, state, cost, audit = stack.pop()
        if reached[row, state] < (cost, audit):
            continue  # dominated since it was pushed
        if row == n:
            if state in ends:
                found = (cost + ends[state][0], audit + ends[state][1])
                best = found if best is None else min(best, found)
            continue
        children = []
        for edit, price, after, step in _choices(letters[row], state):
            node, label = (row + step, after), (cost + price, audit + edit)
            least = label[0] + bounds[row + step][after == USER]
            if best is not None and (least > best[0] or least == best[0] and label[1] > best[1][: len(label[1])]):
                continue
            if node in reached and reached[node] <= label:
                continue
            reached[node] = label
            children.append((least, label[1], node, label[0]))
        stack += [(*node, price, edits) for _, edits, node, price in sorted(children, reverse=True)]
    return best


@lru_cache(1 << 16)
def solved(letters: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Least (cost, audit) of a conversation of one segment."""
    return search(letters, START, CLOSING)


@lru_cache(1 << 12)
def segment(letters: tuple[tuple[str, int], ...]) -> list[list[tuple[int, str] | None]]:
    """Least (cost, audit) between each two grammar states. Inserts stand before a row, so none ends a segment."""
    return [[search(letters, first, {last: (0, "")}) for last in range(4)] for first in range(4)]


def chained(tables: list[list[list[tuple[int, str] | None]]]) -> tuple[int, str]:
    """The segments of a conversation put together from the last to the first.

    Between the same two states no audit of a cost is a prefix of another of that cost, so the least of each segment
    is part of the least of the whole."""
    rest = dict(CLOSING)
    for table in reversed(tables):
        rest = {first: min((row[last][0] + rest[last][0], row[last][1] + rest[last][1]) for last in range(4) if row[last] and last in rest)
                for first, row in enumerate(table) if any(row[last] and last in rest for last in range(4))}
    return rest[START]


class Tally:
    """Counts over consecutive rows of one conversation that can be joined with those of the rows after them."""

    FIELDS = ("lowest", "highest", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn")

    def __init__(self):
        self.lowest = self.highest = self.first_turn = self.last_turn = None
        self.first = self.last = ""
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, other: Tally) -> None:
        if not other.first:
            return
        if other.lowest is not None:
            self.highest = other.highest
            self.turns += other.turns - (other.first_turn is not None and other.first_turn == self.last_turn)
            self.lowest = other.lowest if self.lowest is None else self.lowest
        self.illegal += other.illegal + bool(self.first and self.last + other.first not in ("su", "ua", "au"))
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if not self.first:
            self.first, self.first_turn = other.first, other.first_turn
        self.last, self.last_turn = other.last, other.last_turn

    @classmethod
    def of(cls, turn: int | None, letters: list[tuple[str, int]]) -> Tally:
        own = cls()
        if letters:
            own.lowest = own.highest = own.first_turn = own.last_turn = turn
            own.turns = int(turn is not None)
            own.first, own.last = letters[0][0], letters[-1][0]
            own.illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
            own.blank, own.duplicate, own.truncated = (sum(f == k for _, f in letters) for k in (1, 2, 3))
        return own

    @property
    def gaps(self) -> int:
        return 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns


PART = ("turn long, digest binary, seq long, whole boolean, cost long, audit string, costs array<long>, audits array<string>, "
        "lowest long, highest long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long")
SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _records(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def _written(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], many: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) == many:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _pieces(records: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted letter rows of one conversation -> (turn, digest, letters, tally) of at most SEGMENT letters."""
    held, tally, at = [], Tally(), None
    for _, turn, digest, letter, fault, copies, again in records:
        for copy in range(copies):
            one = (letter, 2 if fault != 1 and (again or copy) else fault)
            if len(held) == SEGMENT:
                yield *at, tuple(held), tally
                held, tally, at = [], Tally(), None
            at = at or (turn, digest)
            held.append(one)
            tally.add(Tally.of(turn, [one]))
    yield *(at or (None, None)), tuple(held), tally


def _parts(conv: pa.DataType, names: list[str], types: list[pa.DataType]):
    """Letter rows in the order of their range -> one row for a conversation that lies within the task, one row for each
    segment of the first and the last conversation, which may go on in another task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        groups = groupby(_records(batches, ["conv_id", "turn", "digest", "letter", "fault", "copies", "again"]), key=lambda r: r[0])
        number, waiting = 0, None
        for conv_id, own in groups:
            if waiting is not None:
                yield from whole(*waiting) if number > 1 else cut(*waiting)
            number, waiting = number + 1, (conv_id, list(_pieces(own)))
        if waiting is not None:
            yield from cut(*waiting)

    def tallied(tally: Tally) -> tuple:
        return tuple(getattr(tally, f) for f in Tally.FIELDS)

    def whole(conv_id, pieces) -> Iterator[tuple]:
        tally = Tally()
        for *_, more in pieces:
            tally.add(more)
        cost, audit = solved(pieces[0][2]) if len(pieces) == 1 else chained([segment(p[2]) for p in pieces])
        yield conv_id, *pieces[0][:2], 0, True, cost, audit, None, None, *tallied(tally)

    def cut(conv_id, pieces) -> Iterator[tuple]:
        for seq, (turn, digest, letters, tally) in enumerate(pieces):
            cells = [c for row in segment(letters) for c in row] if letters else []
            yield conv_id, turn, digest, seq, False, None, None, [c and c[0] for c in cells], [c and c[1] for c in cells], *tallied(tally)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(rows(batches), names, [conv, *types])

    return run


def _joined(conv: pa.DataType, fields: list[str]):
    """Parts in order -> one summary for each conversation."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [conv, *[pa.int64()] * 6, pa.string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, own in groupby(_records(batches, ["conv_id", "whole", "cost", "audit", "costs", "audits", *Tally.FIELDS]), key=lambda r: r[0]):
            tally, tables, answer = Tally(), [], None
            for _, whole, cost, audit, costs, audits, *counts in own:
                more = Tally()
                for name, value in zip(Tally.FIELDS, counts, strict=True):
                    setattr(more, name, value)
                tally.add(more)
                if whole:
                    answer = (cost, audit)
                elif costs:
                    cells = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
                    tables.append([cells[4 * k : 4 * k + 4] for k in range(4)])
            cost, audit = answer or chained(tables)
            yield conv_id, tally.gaps, tally.blank, tally.duplicate, tally.truncated, tally.illegal, cost, audit

    return lambda batches: _written(rows(batches), names, types)


def _typed(df: DataFrame, name: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[name].dataType
    return kind.simpleString(), to_arrow_type(kind)


def summaries(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id): gaps, blank, duplicate,
    truncated, illegal, cost, audit.

    * rows stand by turn, nulls first, those of one turn by the MD5 of role and text; rows without id are one
      conversation; null roles and texts are read as one space; an empty role has no legal initial.
    * repeated rows are rows: all but the first are duplicates (blank ones are blank).
    * a conversation without rows: zeros and an empty audit; empty tables give an empty result.
    """
    name, arrow = _typed(rows, "conv_id")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    letters = _letters(rows)
    if ids is not None:
        empty = ids.select("conv_id").distinct()
        letters = letters.unionByName(empty.selectExpr("conv_id", "cast(null as long) turn", "cast('' as binary) digest", "'' letter", "0 fault", "0L copies", "false again"))
    letters = materialized(letters, "letters")
    order = ["conv_id", "turn", "digest"]
    letters = letters.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["conv_id", *[c.split()[0] for c in PART.split(", ")]]
    whole, text, number = pa.bool_(), pa.string(), pa.int64()
    types = [number, pa.binary(), number, whole, number, text, pa.list_(number), pa.list_(text), *[number] * 7, text, text, number, number]
    parts = letters.mapInArrow(_parts(arrow, names, types), f"conv_id {name}, {PART}")
    parts = parts.repartition("conv_id").sortWithinPartitions(*order, "seq")
    return parts.mapInArrow(_joined(arrow, names), f"conv_id {name}, {SUMMARY}")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, the summary record, repaired rows) in turn; the rows are read as they come."""
    fields = ["conv_id", "role", "text", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    for conv_id, own in groupby(_records(batches, fields), key=lambda r: r[0]):
        record = next(own)
        yield conv_id, record[3:], _repaired(record[-1], ((role, text) for _, role, text, *_ in own))


def _repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the rows that an audit leaves."""
    state = START
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit in "RI":
            role = "assistant" if state == USER else "user"
        state = _after(state, role[:1])
        yield edit, role, text


def _ordered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The summary of each conversation, then its rows in order, all in one task, which reads them as a stream."""
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", _digest()).withColumn("is_row", F.lit(True))
    both = found.withColumn("is_row", F.lit(False)).unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "digest")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the conversations after the edits of ``found``, the summaries of ``rows``.

    The kept and reroled rows and the inserted ones, whose text is empty. Nulls, ties and empty tables: as ``summaries``."""
    name, arrow = _typed(rows, "conv_id")
    types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ((conv_id, at, *row) for conv_id, _, own in _edited(batches) for at, row in enumerate(own))
        return _written(out, ["conv_id", "position", "edit", "role", "text"], types, many=1024)

    return _ordered(rows, found).mapInArrow(run, f"conv_id {name}, position long, edit string, role string, text string")


def digested(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The summaries with repaired_sha256: the digest of the repaired ``role:text`` joined by newlines."""
    name, arrow = _typed(rows, "conv_id")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv_id, record, own in _edited(batches):
            seen = hashlib.sha256()
            for at, (_, role, text) in enumerate(own):
                seen.update(f"{chr(10) if at else ''}{role}:{text}".encode("utf-8", "replace"))
            yield conv_id, *record, seen.hexdigest()

    types = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
    return _ordered(rows, found).mapInArrow(lambda batches: _written(rows_of(batches), names, types), f"conv_id {name}, {SUMMARY}, repaired_sha256 string")


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Summaries and digests of ``rows``: see ``summaries``."""
    return digested(rows, materialized(summaries(rows, ids), "summaries"))
