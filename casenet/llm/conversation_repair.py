"""Repair of conversation structure by Wagner-Fischer alignment with a target.

Turns of a conversation, ordered by turn, are to become ``(s?(ua)+)?`` by their
role initials: nothing, or an optional system turn and then user and assistant
in alternation. Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of
an empty user or assistant turn 2; a blank or duplicate turn must be deleted,
and a truncated one that stays adds 1.

Every target ``(ua)^k`` is the end of the next longer one, so one Wagner-Fischer
table over (turns left, symbols left) aligns the turns with each feasible length
at once; a target with a system turn is such a target behind the turn that is
kept as its first. The table is kept to Ukkonen's band of the incumbent cost, that
of the alignment without shifts or of deleting all. Targets of equal cost are
compared by their audits, the initials of the edits in order: all cheapest
alignments are traced back side by side, and each step takes the least letter
that any of them offers.

Spark finds the faults with windows in a conversation and brings one character
for each turn to its alignment; texts are not gathered. The audit then goes
before the turns of its conversation in sorted order, and the turns pass by it
one at a time. So a task holds one row at a time and, of a conversation, one
character a turn and the band's rows at every root-of-n-th turn.

Edge cases: null roles and texts are one space; turns are ordered by (turn,
role, text) with null turns first, so ties have one defined order; only the first
of a turn's faults counts, of blank, duplicate, truncated; a null conv_id is a
conversation like any other; a row with a false ``present`` (where that column
exists) only names its conversation, and a conversation of such rows has zeros,
an empty audit and no repaired turn; texts of any length are taken whole; an
empty table gives an empty result; columns besides these are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casenet.plans.shared import SharedTables

BLANK = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 29
GONE = "-"  # code of a turn that must be deleted; others are s, u, a or o (another role), in capitals if truncated
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32(``conv_id:turn``) mod 20: 0 drops (``present`` is false), 1 empties, 2 removes ``[.!?]``, 3 repeats, 4 sets the role user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "present": F.col("kind") != 0})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("copy", "kind")


def examined(turns: DataFrame) -> DataFrame:
    """Each turn with its place in the conversation (from 1), fault, code, and whether its role may follow the one before."""
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("present"), F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"place": F.row_number().over(order), "__turn": F.lag("turn").over(order), "__before": F.lag(initial).over(order)})
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("place")))
    body = F.rtrim("text", F.lit(BLANK))
    fault = F.when(body == "", "blank").when(F.col("__copy") > 1, "duplicate").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", fault)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    illegal = (F.col("place") > 1) & ~F.concat("__before", initial).isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & ((F.col("place") == 1) | ~F.col("turn").eqNullSafe(F.col("__turn")))
    return rows.withColumns({"code": code, "illegal": illegal, "new_turn": new_turn}).drop("__turn", "__before", "__copy")


def summary(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``examined``: its counts, and the codes of its turns in order."""
    there = lambda c: F.when(F.col("present"), c)
    faults = {name: F.count_if(there(F.col("fault") == name)).alias(name) for name in ("blank", "duplicate", "truncated")}
    gaps = F.max(there(F.col("turn"))) - F.min(there(F.col("turn"))) + 1 - F.count_if(there(F.col("new_turn")))
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(there(F.struct("place", "code")))), lambda x: x["code"]), "")
    return rows.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *faults.values(), F.count_if(there(F.col("illegal"))).alias("illegal"), codes.alias("codes"))


class _Table:
    """Costs of the alignments of the turns from ``i`` on with the last ``t`` target symbols, for ``t`` near the number of live turns left."""

    def __init__(self, codes: str):
        self.codes, n = codes, len(codes)
        self.kind, self.extra = codes.lower(), [TRUNCATED * c.isupper() for c in codes]
        self.left = np.concatenate([np.cumsum([c != GONE for c in codes[::-1]], dtype=np.int64)[::-1], [0]])
        self.width = (self._incumbent() - DELETE * codes.count(GONE) - sum(self.extra)) // 2 + 1
        self.shift = np.arange(-self.width, self.width + 1, dtype=np.int32)
        self.step = isqrt(n) + 1
        last = np.where(self.shift >= 0, INSERT * self.shift, FAR).astype(np.int32)
        self.marks, row = {n: last}, last
        self.start = [FAR] * (n + 1)  # cost of the turns from i on, with a system turn to come
        for i in range(n - 1, -1, -1):
            self.start[i] = min(self.start[i + 1] + DELETE, (self.extra[i] + self.after_system(i, row).min(initial=FAR)) if self.kind[i] == "s" else FAR, FAR)
            row = self.row(i, row)
            if i % self.step == 0:
                self.marks[i] = row

    def _incumbent(self) -> int:
        live, sure = [c for c in self.kind if c != GONE], DELETE * self.codes.count(GONE) + sum(self.extra)

        def unshifted(kinds: list[str]) -> int:
            return sum(REROLE * (c != "ua"[k % 2]) for k, c in enumerate(kinds)) + INSERT * (len(kinds) % 2)

        found = [DELETE * len(self.codes)] + [sure + unshifted(live)] * bool(live)
        if live[:1] == ["s"]:
            found.append(sure + (unshifted(live[1:]) if live[1:] else 2 * INSERT))
        return min(found)

    def row(self, i: int, after: np.ndarray) -> np.ndarray:
        """Row ``i`` of the table from row ``i + 1``."""
        symbols = self.shift + self.left[i]
        if self.kind[i] == GONE:
            base = after + DELETE
        else:
            base = np.full_like(after, FAR)
            base[:-1] = after[1:] + DELETE
            if self.kind[i] in ROLES:
                other = (symbols & 1) == (self.kind[i] == "u")
            else:
                other = np.ones(len(symbols), dtype=bool)
            base = np.minimum(base, np.where(symbols > 0, after + self.extra[i] + REROLE * other, FAR))
        base = np.where(symbols >= 0, base, FAR)
        row = np.minimum.accumulate(base - INSERT * self.shift) + INSERT * self.shift
        return np.minimum(np.where(symbols >= 0, row, FAR), FAR).astype(np.int32)

    def after_system(self, i: int, after: np.ndarray) -> np.ndarray:
        """Costs in row ``i + 1`` of the targets that may stand behind a system turn, FAR elsewhere."""
        symbols = self.shift + self.left[i + 1]
        return np.where((symbols >= 2) & (symbols % 2 == 0), after, FAR)

    def cost(self, i: int, row: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        at = symbols - self.left[i] + self.width
        inside = (at >= 0) & (at < len(row)) & (symbols >= 0)
        return np.where(inside, row[np.clip(at, 0, len(row) - 1)], FAR)

    def cheapest(self) -> tuple[int, str]:
        n, first = len(self.codes), self.marks[0]
        symbols = self.shift + self.left[0]
        whole = np.where((symbols >= 0) & (symbols % 2 == 0), first, FAR)
        best = int(min(whole.min(), self.start[0]))
        states, system, audit = symbols[whole == best], self.start[0] == best, []
        for begin in range(0, n, self.step):
            end = min(begin + self.step, n)
            rows = {end: self.marks[end]}
            for i in range(end - 1, begin - 1, -1):
                rows[i] = self.row(i, rows[i + 1])
            i = begin
            while i < end:
                letter, states, system = self._next(i, states, system, rows[i], rows[i + 1])
                audit.append(letter)
                i += letter != "I"
        return best, "".join(audit) + "I" * int(states.max(initial=0))

    def _next(self, i: int, states: np.ndarray, system: bool, row: np.ndarray, after: np.ndarray) -> tuple[str, np.ndarray, bool]:
        """The least letter that continues one of the cheapest alignments, and those that it continues."""
        here = self.cost(i, row, states)
        gone, waits = self.cost(i + 1, after, states) + DELETE == here, system and self.start[i + 1] + DELETE == self.start[i]
        if gone.any() or waits:
            return "D", states[gone], waits
        put = (states > 0) & (self.cost(i, row, states - 1) + INSERT == here)
        if put.any():
            return "I", states[put] - 1, False
        wanted = np.where(states % 2 == 0, "u", "a")
        diagonal = np.where(states > 0, self.cost(i + 1, after, states - 1) + self.extra[i], FAR)
        kept = [states[(wanted == self.kind[i]) & (diagonal == here)] - 1]
        if system and self.kind[i] == "s":
            kept.append((self.shift + self.left[i + 1])[self.after_system(i, after) + self.extra[i] == self.start[i]])
        kept = np.unique(np.concatenate(kept))
        if len(kept):
            return "K", kept, False
        return "R", states[(wanted != self.kind[i]) & (diagonal + REROLE == here)] - 1, False


def align(codes: str) -> tuple[int, str]:
    """Least cost of a repair, and its audit (the least in ASCII order of all at that cost)."""
    return _Table(codes).cheapest() if codes else (0, "")


@lru_cache(maxsize=1 << 16)
def _short(codes: str) -> tuple[int, str]:
    return align(codes)


def _aligned(summaries: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_short(codes) if len(codes) <= 64 else align(codes) for codes in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=[*batch.schema.names[:-1], "cost", "audit"])

    return summaries.mapInArrow(run, "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def _repaired(rows: DataFrame, report: DataFrame) -> DataFrame:
    heads = report.select("conv_id", F.lit(0).alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = heads.unionByName(rows.where("present").select("conv_id", "place", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, position, last = None, "", 0, 0, ""

        def put(edit: str, role: str, text: str) -> tuple:
            nonlocal position, last
            position, last = position + 1, role[:1]
            return conv, position, edit, role, text

        def inserted() -> Iterator[tuple]:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                at += 1
                yield put("I", ROLES["a" if last == "u" else "u"], "")

        def table(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["conv_id", "position", "edit", "role", "text"])

        for batch in batches:
            out: list[tuple] = []
            for head, own, role, text in zip(*(batch.column(c).to_pylist() for c in ("place", "conv_id", "role", "text")), strict=True):
                out += inserted()
                if not head:
                    conv, audit, at, position, last = own, text, 0, 0, ""
                    continue
                edit, at = audit[at], at + 1
                if edit == "K":
                    out.append(put(edit, role, text))
                elif edit == "R":
                    out.append(put(edit, ROLES["a" if last == "u" else "u"], text))
            yield table(out)
        yield table(list(inserted()))

    return stream.mapInArrow(run, "conv_id bigint, position bigint, edit string, role string, text string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report with one row for each conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), and the repaired turns.

    ``illegal`` counts neighbours whose role initials are not su, ua or au. The
    repaired turns (conv_id, position, edit, role, text) come with all turns of
    a conversation in order in one partition.
    """
    tables = SharedTables(turns.sparkSession)
    rows = tables.write(examined(turns), "turns")
    report = tables.write(_aligned(summary(rows)), "audits")
    return report, _repaired(rows, report)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, over ``role:text`` joined by newlines, of repaired turns in the order that ``repair`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed = None, None
        for batch in batches:
            ids, sums = [], []
            for own, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
                if position == 1:
                    if hashed:
                        ids.append(conv)
                        sums.append(hashed.hexdigest())
                    conv, hashed = own, hashlib.sha256()
                hashed.update(f"{chr(10) * (position > 1)}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], names=["conv_id", "repaired_sha256"])
        if hashed:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([hashed.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def report_digests(turns: DataFrame) -> DataFrame:
    """The report of ``repair`` with the digest of each repaired conversation."""
    report, repaired = repair(turns)
    hashed = digests(repaired).withColumnRenamed("conv_id", "__id")
    joined = report.join(hashed, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    return joined.select("conv_id", *REPORT, F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
