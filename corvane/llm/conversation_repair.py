"""Conversation structure repair: the cheapest edits that make a conversation's roles ``(s?(ua)+)?``.

Edits of a row: Keep costs 0, Rerole to user or assistant 3, Delete 4; an undeleted truncated row
costs 3 more; blank and duplicate rows have to be deleted. Insert puts an empty user or assistant
turn anywhere for 3. Of the cheapest lists of edits the one whose initials (the audit) are least in
ASCII counts; it determines the repaired turns.

The method is weighted interval parsing. The repair grammar in Chomsky normal form has a symbol
``pq`` for what leads from state p to state q of the roles' automaton (0 nothing yet, 1 after s, 2
after u, 3 after a), binary rules ``pq -> pr rq``, and weighted rules for single rows. Insertions, which cover no
rows, are closed into the cells. A span's cell has the least (cost, audit) of each symbol.
Two audits of equal cost over one span are never prefixes of each other (a longer one would have
more insertions and cost more), so the least parts make the least whole; and since ``pr`` and ``rq``
cover every way to cross a border, each border of a span gives the same cell and one is enough. Cells
are combined bottom-up by span length: spans of 1, 2, 4, 8 rows and so on.

A conversation is never gathered: identical rows are counted first, narrow rows (without text) are
range-partitioned in order, so a long conversation lies in several tasks that parse a segment each, and
only a cell a segment is combined. Texts come in once more at the end, streamed in order into the
digest, a turn at a time; SHA-256 is sequential, so that last stream of one conversation is one task's, in bounded memory but for the audit.

Null roles and texts are one space; such a role, like an empty one, is none that can be kept, and such a text is blank. Rows
are in the order of turn (nulls first), role and the SHA-256 of the text; identical rows of one turn are
next to each other, all but the first of them duplicates or blank. Null conv_ids are one conversation. An empty
table gives no rows. Other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.tables import written

RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, DUPLICATE, CUT, FINE = 1, 2, 3, 0

#: state and role initial -> state
_MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: how many insertions lead from one state to another
_INSERTED = {(p, p): 0 for p in range(4)} | {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}
SYMBOLS = sorted(_INSERTED | {(0, 1): 0})
RULES = [(SYMBOLS.index((p, q)), SYMBOLS.index((p, r)), SYMBOLS.index((r, q))) for p, q in SYMBOLS for r in range(4) if (p, r) in SYMBOLS and (r, q) in SYMBOLS]
_LEGAL = {"su", "ua", "au"}

Cell = list  # for each symbol the least (cost, audit), or None
EMPTY: Cell = [(0, "") if p == q else None for p, q in SYMBOLS]
_CLOSURE: Cell = [(INSERT * _INSERTED[s], "I" * _INSERTED[s]) if s in _INSERTED else None for s in SYMBOLS]


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans, by the binary rules."""
    out: Cell = [None] * len(SYMBOLS)
    for whole, first, second in RULES:
        a, b = left[first], right[second]
        if a is not None and b is not None:
            cost = a[0] + b[0]
            best = out[whole]
            if best is None or cost < best[0]:
                out[whole] = (cost, a[1] + b[1])
            elif cost == best[0] and (audit := a[1] + b[1]) < best[1]:
                out[whole] = (cost, audit)
    return out


def closed(cell: Cell) -> Cell:
    return combined(combined(_CLOSURE, cell), _CLOSURE)


@lru_cache(maxsize=256)
def row_cell(initial: str, fault: int) -> Cell:
    """The cell of one row, insertions on both sides included."""
    cell: Cell = [(DELETE, "D") if p == q else None for p, q in SYMBOLS]
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        for (p, role), q in _MOVES.items():
            edits = [(extra, "K")] if role == initial else []
            edits += [(RETYPE + extra, "R")] if role in "ua" else []
            for edit in edits:
                at = SYMBOLS.index((p, q))
                cell[at] = min(filter(None, (cell[at], edit)))
    return closed(cell)


def deleted_cell(n: int) -> Cell:
    """The cell of n rows that have to be deleted."""
    return closed([(DELETE * n, "D" * n) if p == q else None for p, q in SYMBOLS])


class Spans:
    """A segment's rows, parsed as they come: adjacent spans of equal length are combined."""

    def __init__(self):
        self._stack: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        length = 1
        while self._stack and self._stack[-1][0] == length:
            cell, length = combined(self._stack.pop()[1], cell), 2 * length
        self._stack.append((length, cell))

    def cell(self) -> Cell:
        """The cell of all rows so far; shorter spans at the end first."""
        out = None
        for _, cell in reversed(self._stack):
            out = cell if out is None else combined(cell, out)
        return EMPTY if out is None else out


def accepted(cell: Cell) -> tuple[int, str]:
    """The least (cost, audit) that leads from nothing to nothing or to a finished pair."""
    return min(x for x in (cell[SYMBOLS.index((0, 0))], cell[SYMBOLS.index((0, 3))]) if x is not None)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of turns with seeded faults, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 removes ``[.!?]``, 3 repeats it, 4 makes it a user's.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    read = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_c"))
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_c") == 4, "user").otherwise(F.col("role"))
    return read.where("_c <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_c") == 3, 2).otherwise(1).cast("long").alias("n"))


def _faulty(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, initial, fault, n): fault of the first of n identical rows."""
    last = F.expr(r"substring(rtrim('\t\n\u000b\u000c\r ', text), -1, 1)")
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    narrow = rows.select("conv_id", "turn", "role", "key", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "n")
    again = narrow.groupBy("conv_id", "role", "key").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    seen = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("key").alias("_k"), F.col("first.turn").alias("_t"))
    same = (F.xxhash64("conv_id", "role", "key") == F.xxhash64("_c", "_r", "_k")) & F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("key") == F.col("_k"))
    late = F.col("_k").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_t")) & (F.col("fault") != BLANK)
    return narrow.join(seen, same, "left").withColumn("fault", F.when(late, DUPLICATE).otherwise(F.col("fault"))).drop("_c", "_r", "_k", "_t")


_STATS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first_initial string, last_initial string, costs array<long>, audits array<string>"
_STAT_NAMES = [x.split()[0] for x in _STATS.split(", ")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted partition: its segment's counts and cell."""
    names = ["conv_id", "first", *_STAT_NAMES]
    kinds = [pa.int64(), pa.struct([("turn", pa.int64()), ("role", pa.string()), ("key", pa.binary())]), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    out: list[list] = []
    now: list | None = None
    spans = Spans()

    def close() -> None:
        if now is not None:
            cell = spans.cell()
            out.append([*now, [-1 if x is None else x[0] for x in cell], [None if x is None else x[1] for x in cell]])

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for conv, turn, role, key, initial, fault, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "key", "initial", "fault", "n")), strict=True):
            if now is None or conv != now[0]:
                close()
                now, spans = [conv, {"turn": turn, "role": role, "key": key}, 0, 0, 0, 0, 0, None, None, initial, None], Spans()
            elif now[10] + initial not in _LEGAL:
                now[5] += 1
            now[5] += (n - 1) * (initial + initial not in _LEGAL)
            if turn is not None and turn != now[8]:
                now[6] += 1
                now[7], now[8] = turn if now[7] is None else now[7], turn
            now[10] = initial
            now[2] += n if fault == BLANK else 0
            now[3] += (fault == DUPLICATE) + (n - 1 if fault != BLANK else 0)
            now[4] += fault == CUT
            spans.add(row_cell(initial, fault))
            if n > 1:
                spans.add(deleted_cell(n - 1))
        if len(out) > 1000:
            yield batch_of()
            out.clear()
    close()
    if out:
        yield batch_of()


_REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _REPAIR.split(", ")]
    for batch in batches:
        rows = []
        for segments in batch.column("segments").to_pylist():
            sums = {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
            lows, highs = [s["low"] for s in segments if s["low"] is not None], [s["high"] for s in segments if s["high"] is not None]
            spans = Spans()
            for s, before in zip(segments, [None, *segments], strict=False):
                spans.add([None if c < 0 else (c, a) for c, a in zip(s["costs"], s["audits"], strict=True)])
                if before is not None:
                    sums["illegal"] += before["last_initial"] + s["first_initial"] not in _LEGAL
                    sums["turns"] -= s["low"] is not None and s["low"] == before["high"]
            gaps = max(highs) - min(lows) + 1 - sums["turns"] if lows else 0
            rows.append((gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["illegal"], *accepted(spans.cell())))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True))] if rows else [batch.column("conv_id"), *(pa.array([], pa.string() if n == "audit" else pa.int64()) for n in names)], ["conv_id", *names])


def identical_counted(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key, n): identical rows (conv_id, turn, role, text, n) as one, with the SHA-256 of the text."""
    return turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("key", F.unhex(F.sha2("text", 256)))


def structure_audit(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for the rows of ``identical_counted``."""
    order = ["conv_id", "turn", "role", "key"]
    placed = _faulty(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    parsed = placed.mapInArrow(_parse, f"conv_id long, first struct<turn:long,role:string,key:binary>, {_STATS}")
    segments = parsed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", *_STAT_NAMES))).alias("segments"))  # one for each partition that the conversation lies in
    return segments.mapInArrow(_join_segments, f"conv_id long, {_REPAIR}")


class Repaired:
    """Repaired turns of one conversation, given its audit, as rows come in order."""

    def __init__(self, audit: str):
        self._audit, self._at = audit, 0
        self._made, self._odd = 0, (len(audit) - audit.count("D")) % 2

    def _own(self) -> str:
        return "user" if (self._made - self._odd) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self._audit.startswith("I", self._at):
            yield self._own(), ""
            self._at += 1
            self._made += 1

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str]]:
        for _ in range(n):
            yield from self.inserted()
            edit = self._audit[self._at]
            if edit != "D":
                yield (role if edit == "K" else self._own()), text
                self._made += 1
            self._at += 1


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows (kind 0: the conversation exists, 1: its audit, 2: its rows), one row a conversation."""
    stats = [x.split()[0] for x in _REPAIR.split(", ")]
    out: list[tuple] = []
    begun, conv, found, repaired, digest, made = False, None, None, None, None, 0

    def put(turns: Iterator[tuple[str, str]]) -> None:
        nonlocal made
        for role, text in turns:
            digest.update(f"{chr(10) if made else ''}{role}:{text}".encode())
            made += 1

    def close() -> None:
        put(repaired.inserted())
        out.append((conv, *(found[s] for s in stats), digest.hexdigest()))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), *(pa.string() if s == "audit" else pa.int64() for s in stats), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *stats, "repaired_sha256"])

    for batch in batches:
        for key, kind, audit, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "repair", "role", "text", "n")), strict=True):
            if kind == 0:
                if begun:
                    close()
                begun, conv, found = True, key, {s: "" if s == "audit" else 0 for s in stats}
                repaired, digest, made = Repaired(""), sha256(), 0
            elif kind == 1:
                found, repaired = audit, Repaired(audit["audit"])
            else:
                put(repaired.row(role, text, n))
        if len(out) > 1000:
            yield batch_of()
            out.clear()
    if begun:
        close()
    if out:
        yield batch_of()


def repair(conv_ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each of conv_ids (conv_id): the counts, cost and audit of its turns (conv_id, turn, role, text, n), and the digest of the repaired ones."""
    rows = written(identical_counted(turns), "turns")
    names = [x.split()[0] for x in _REPAIR.split(", ")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("key", "binary"), ("text", "string"), ("n", "long"))]
    no_audit = F.lit(None).cast(f"struct<{_REPAIR.replace(' long', ':long').replace(' string', ':string')}>").alias("repair")
    exists = conv_ids.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(0).alias("kind"), no_audit, *none)
    audits = structure_audit(rows).select("conv_id", F.lit(1).alias("kind"), F.struct(*names).alias("repair"), *none)
    texts = rows.select("conv_id", F.lit(2).alias("kind"), no_audit, "turn", "role", "key", "text", "n")
    placed = exists.unionByName(audits).unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key")
    return placed.mapInArrow(_stream, f"conv_id long, {_REPAIR}, repaired_sha256 string")


def repaired_turns(roles: list[str], texts: list[str], audit: str) -> list[tuple[str, str]]:
    """The repaired turns of a conversation of rows in order."""
    repaired = Repaired(audit)
    out = [t for role, text in zip(roles, texts, strict=True) for t in repaired.row(role, text, 1)]
    return [*out, *repaired.inserted()]


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """``repair`` of ``damaged`` turns (conv_id, turn, role, text), a row for each conv_id of the undamaged."""
    return repair(turns, damaged(turns))
