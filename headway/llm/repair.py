"""Conversation repair: turns aligned to the alternating grammar by edit distance.

A conversation should read `(s?(ua)+)?` in its roles' initials. For each length there is one such
string, so turns are aligned to the strings of all feasible lengths by Wagner and Fischer's
tables. Counted from their ends the strings are alike, so all lengths share one table over
(turns left, symbols left), and a second one for those that still await their system turn. A greedy
repair gives the incumbent cost; Ukkonen's band holds only cells that a repair of that cost can
pass. The audits (letters of the edits) of all lengths with the least cost are traced back
side by side, and the ASCII-least wins.

Turns are streamed in order through tasks, first as one letter each, then with their texts
beside the audit; a task holds a number and a letter for each turn and one batch of texts of a
conversation, however long it is. Table rows are kept at every square root of the turns and computed again between them.
One conversation's SHA-256 is made by one task, as a hash has no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Costs of the edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: A turn's letter: its place is 4 * (place of the initial among INITIALS) + fault. DROPPED stands for a turn that isn't there.
INITIALS, DROPPED = "suax", "-"
LETTERS = "ABCDEFGHIJKLMNOP"
FINE, BLANK, DUPLICATE, CUT_OFF = range(4)
LEGAL = ("su", "ua", "au")
FAR = 1 << 30
#: Letter strings up to this long are remembered with their audits.
SHORT = 48
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> the same with dropped, after damage by the CRC-32 of `conv_id:turn` modulo 20.

    0 drops a row (it stays, marked as dropped), 1 empties its text, 2 removes its `.`, `!` and
    `?`, 3 repeats it, 4 makes its role user. A null role, text, or part of the hashed name is one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), F.concat(part("conv_id"), F.lit(":"), part("turn")).alias("name"))
    rows = named.withColumn("kind", F.crc32(F.col("name").cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def last_character(text: str) -> Column:
    """The last that isn't white space; empty where there is none."""
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def letter(end: Column, duplicate: Column) -> Column:
    """A turn's letter from its text's last character and its role."""
    fault = F.when(end == "", BLANK).when(duplicate, DUPLICATE).when(end.isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.substring(F.lit(LETTERS), place * 4 + fault + 1, F.lit(1))


def greedy_cost(rows: list[tuple[str, int]]) -> int:
    """The cost of a repair that goes through the turns once."""
    cost, state, forced = 0, "", 0
    for initial, fault in rows:
        if fault in (BLANK, DUPLICATE):
            forced += 1
            continue
        cost += TRUNCATED * (fault == CUT_OFF)
        wanted = "a" if state == "u" else "u"
        if initial == wanted or initial == "s" and state == "":
            state = initial
        elif initial in "ua":
            cost, state = cost + INSERT, initial
        else:
            cost, state = cost + REROLE, wanted
    cost += INSERT * {"s": 2, "u": 1}.get(state, 0)
    return min(cost + DELETE * forced, DELETE * len(rows))


class Tables:
    """Rows of both tables within the band; kept at every `step` turns, and computed again between.

    Cell k of row i is for k - low + free[i] symbols left, free[i] being the turns from i on that
    needn't be deleted. Table 0: cost of turning the turns from i on into the symbols. Table 1: the same
    where the first symbol is still to be a kept system turn.
    """

    def __init__(self, rows: list[tuple[str, int]]):
        self.rows, n = rows, len(rows)
        self.forced = [fault in (BLANK, DUPLICATE) for _, fault in rows]
        self.free = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            self.free[i] = self.free[i + 1] + (not self.forced[i])
        cut_off = sum(fault == CUT_OFF for _, fault in rows)
        slack = greedy_cost(rows) - DELETE * sum(self.forced) - TRUNCATED * cut_off
        # a deleted turn costs DELETE, or one more than leaving it in where it is truncated
        more = DELETE - TRUNCATED
        deletes = slack // more if slack <= more * cut_off else (slack + TRUNCATED * cut_off) // DELETE
        self.low, self.width = min(deletes, self.free[0]), min(deletes, self.free[0]) + slack // INSERT + 1
        self.offsets = np.arange(self.width) - self.low
        self.step, self.kept, self.block = max(1, isqrt(n)), {}, {}
        row = np.full((2, self.width), FAR, np.int64)
        row[0] = np.where(self.offsets >= 0, self.offsets * INSERT, FAR)
        self.kept[n] = row
        for i in range(n - 1, -1, -1):
            row = self.above(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        if self.forced[i]:
            return np.minimum(below + DELETE, FAR)
        initial, fault = self.rows[i]
        stays = TRUNCATED * (fault == CUT_OFF)
        left = self.offsets + self.free[i]
        deleted = np.full_like(below, FAR)
        deleted[:, :-1] = below[:, 1:] + DELETE
        match = (left % 2 == 1) if initial == "a" else (left % 2 == 0) if initial == "u" else np.zeros(self.width, bool)
        used = np.where(left >= 1, below[0] + stays + np.where(match, 0, REROLE), FAR)
        row = np.empty_like(below)
        best = np.minimum(deleted[0], used)
        best[left < 0] = FAR
        row[0] = np.minimum.accumulate(best - INSERT * self.offsets) + INSERT * self.offsets
        row[1] = deleted[1]
        if initial == "s":
            row[1] = np.where((left >= 3) & (left % 2 == 1), np.minimum(row[1], below[0] + stays), row[1])
        return np.minimum(row, FAR)

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            end = min(len(self.rows), (i // self.step + 1) * self.step)
            self.block, row = {}, self.kept[end]
            for j in range(end - 1, i - i % self.step, -1):
                self.block[j] = row = self.above(j, row)
        return self.block[i]

    def cost(self, waiting: bool, i: int, left: int) -> int:
        """A cell; FAR where it lies outside the band."""
        k = left - self.free[i] + self.low
        return int(self.row(i)[int(waiting), k]) if 0 <= k < self.width and left >= 0 else FAR


def audit_of(letters: str) -> tuple[str, int]:
    """The ASCII-least of the cheapest audits, and its cost; letters of turns in order, without dropped ones."""
    rows = [(INITIALS[k // 4], k % 4) for k in map(LETTERS.index, letters)]
    tables, n = Tables(rows), len(rows)
    lengths = tables.offsets + tables.free[0]
    first = tables.row(0)
    whole = [(bool(w), int(length), int(first[w, k])) for k, length in enumerate(lengths) if length >= 0 for w in [length % 2]]
    rest = cost = min(c for _, _, c in whole)
    states = {(w, length) for w, length, c in whole if c == cost}
    audit, i = [], 0
    while (False, 0) not in states or i < n:
        initial, fault = rows[i] if i < n else ("", FINE)
        stays, usable = TRUNCATED * (fault == CUT_OFF), i < n and not tables.forced[i]
        wanted = lambda left: "a" if left % 2 else "u"
        moves = [
            ("D", DELETE, 1, {s for s in states} if i < n else set()),
            ("I", INSERT, 0, {(False, left - 1) for w, left in states if not w and left}),
            ("K", stays, 1, {(False, left - 1) for w, left in states if usable and left and initial == ("s" if w else wanted(left))}),
            ("R", stays + REROLE, 1, {(False, left - 1) for w, left in states if usable and left and not w and initial != wanted(left)}),
        ]
        for name, price, on, after in moves:
            found = {s for s in after if tables.cost(s[0], i + on, s[1]) == rest - price}
            if found:
                audit.append(name)
                states, i, rest = found, i + on, rest - price
                break
        else:
            raise AssertionError("a traced cell has no successor")
    return "".join(audit), cost


remembered = lru_cache(1 << 16)(audit_of)


def findings(turns: list[int | None], letters: str) -> tuple:
    """COUNTS and the audit of a conversation's turns in order; dropped ones are passed over."""
    kept = [(t, x) for t, x in zip(turns, letters, strict=True) if x != DROPPED]
    places = [LETTERS.index(x) for _, x in kept]
    known = {t for t, _ in kept if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    faults = [p % 4 for p in places]
    initials = [INITIALS[p // 4] for p in places]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    own = "".join(x for _, x in kept)
    audit, cost = (remembered if len(own) <= SHORT else audit_of)(own)
    return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), illegal, cost, audit


class Edits:
    """The repaired turns of a conversation, one turn after another, by its audit."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.left = sum(x != "D" for x in audit)

    def role(self) -> str:
        self.left -= 1
        return "user" if self.left % 2 else "assistant"

    def inserted(self) -> list[tuple[str, str, str]]:
        out = []
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(("I", self.role(), ""))
        return out

    def turn(self, role: str, text: str) -> list[tuple[str, str, str]]:
        """What comes of the next turn: (edit, role, text) of turns inserted before it, and its own."""
        out, edit = self.inserted(), self.audit[self.at]
        self.at += 1
        if edit != "D":
            wanted = self.role()
            out.append((edit, role if edit == "K" else wanted, text))
        return out


def lettered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) -> (conv_id, turn, role, digest, nth, letter).

    nth counts a conversation's turns of one role and text, in the order of turn; those after the first
    are duplicates. Each (conversation, role, text) is searched apart, so a long conversation is spread over tasks.
    """
    rows = turns.withColumn("digest", F.sha2("text", 256))
    same = W.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.asc_nulls_first("turn"))
    small = rows.select("conv_id", "turn", "role", last_character("text").alias("end"), "digest", "dropped").withColumn("nth", F.row_number().over(same))
    own = letter(F.col("end"), F.col("nth") > 1)
    return small.select("conv_id", "turn", "role", "digest", "nth", F.when(F.col("dropped"), DROPPED).otherwise(own).alias("letter"))


def conversations_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows (values of names) of sorted batches, each with whether its conversation is another than the one before."""
    before: tuple = ()
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        for key, *rest in zip(ids, *(batch.column(n).to_pylist() for n in names), strict=True):
            yield (key, (key,) != before, *rest)
            before = (key,)


def by_turn(rows: DataFrame, first: list, last: list) -> DataFrame:
    """Rows of a conversation together, in the order of turn (nulls first), role and the SHA-256 of the text."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "digest", *last)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048, chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most `size` rows and about `chars` characters."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or n >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) -> conv_id, COUNTS and audit, a row for each conv_id."""
    rows = by_turn(lettered(turns), [], ["nth"]).select("conv_id", "turn", "letter")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        numbers, letters, last = [], [], ()
        for key, new, turn, x in conversations_of(batches, "turn", "letter"):
            if new and last:
                yield (*last, *findings(numbers, "".join(letters)))
            if new:
                numbers, letters, last = [], [], (key,)
            numbers.append(turn)
            letters.append(x)
        if last:
            yield (*last, *findings(numbers, "".join(letters)))

    kind = turns.schema["conv_id"].dataType
    id_type = arrow_type(turns, "conv_id")
    schema = pa.schema([("conv_id", id_type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])
    out = f"conv_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string"
    return rows.mapInArrow(lambda batches: batched(found(batches), schema), out)


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    """Turns that weren't dropped, each conversation led by a row that has its findings."""
    notes = found.select("conv_id", F.struct(*COUNTS, "audit").alias("found"))
    own = turns.where("not dropped").select("conv_id", "turn", "role", "text", F.sha2("text", 256).alias("digest"))
    return by_turn(own.unionByName(notes, allowMissingColumns=True), [F.col("found").isNull()], [])


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Batches of with_audits -> (conv_id, findings, (edit, role, text)) for each repaired turn, and with None at a conversation's end."""
    last = None
    for key, new, note, role, text in conversations_of(batches, "found", "role", "text"):
        if not new:
            yield from ((*last, one) for one in edits.turn(role, text))
            continue
        if last:
            yield from ((*last, one) for one in [*edits.inserted(), None])
        last, edits = (key, note), Edits(note["audit"])
    if last:
        yield from ((*last, one) for one in [*edits.inserted(), None])


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) -> conv_id, COUNTS, audit, repaired_sha256: a row for each conv_id.

    Turns are taken in the order of turn (nulls first), then role, then the SHA-256 of the text.
    A null conv_id is a conversation like others. Roles and texts mustn't be null (see damage). A
    role that is neither s, u nor a at its start can be changed or deleted, not kept. A conversation
    whose rows are all dropped has zeros, an empty audit and the hash of the empty text. No rows give none.
    """
    rows = with_audits(turns, audits(turns))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        sha, line_break = hashlib.sha256(), b""
        for key, note, one in edited(batches):
            if one:
                sha.update(line_break + f"{one[1]}:{one[2]}".encode())
                line_break = b"\n"
            else:
                yield (key, *(note[c] for c in COUNTS), note["audit"], sha.hexdigest())
                sha, line_break = hashlib.sha256(), b""

    schema = pa.schema([("conv_id", arrow_type(turns, "conv_id")), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return rows.select("conv_id", "found", "role", "text").mapInArrow(lambda batches: batched(hashed(batches), schema), out)


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) -> the repaired conversations: conv_id, position (from 0), edit (K, R or I), role, text."""
    rows = with_audits(turns, audits(turns))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at = 0
        for key, _, one in edited(batches):
            if one:
                yield (key, at, *one)
            at = at + 1 if one else 0

    schema = pa.schema([("conv_id", arrow_type(turns, "conv_id")), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    out = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position long, edit string, role string, text string"
    return rows.select("conv_id", "found", "role", "text").mapInArrow(lambda batches: batched(placed(batches), schema), out)
