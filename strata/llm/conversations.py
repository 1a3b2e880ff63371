"""Conversation structure repair (operator 11) by Knuth's lightest-derivation agenda.

Rows of a conversation in order of turn become symbols: the first letter of the role and the first fault
(blank, duplicate, truncated). Items (i, q) say that the first i rows are repaired and the output so far
leaves the pattern ``(s?(ua)+)?`` in state q. Deductions (edits) derive items from items: Keep (0), Rerole
(3), Delete (4) consume a row, Insert (3) does not; a truncated row that is not deleted adds 3. An item's
value is (cost, audit); every deduction adds to the cost and appends its letter, so it is a superior function:
monotone in the value and never below it. (Equal costs mean that neither audit is a prefix of the other: an
Insert costs, and each row has one letter.) The agenda therefore pops each item first with its final value,
and stops when the goal is final.

Scale. A conversation is read as a stream, sorted by Spark, ``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` of text at a
time. Between chunks at most four items live on, one per state, each with its cost, the order of its audit
among the four, and the SHA-256 of what it has written so far; so memory does not grow with the conversation
(but for its audit, a result column). Inserts stand before the row that follows them, the last ones at the end,
so chunks cut audits at rows. One conversation's hash is a chain over all its text in order: this pass over
one conversation can't be split, whatever the method. Faults are found beforehand and in parallel: the least
turn of each (conversation, role, text) by a map-side aggregate, so rows with equal text are never gathered.

Cases: null roles and texts, and null ids and turns in the damage key, count as one space; null turns come
first. Rows of equal turn are ordered by role, then by the MD5 of the text; equal rows are interchangeable. A
null conv_id is a conversation of its own. A conversation of which no row is left has zeros, an empty audit
and the hash of the empty string. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\f\r "
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK_ROWS, CHUNK_BYTES = 256, 8 << 20

#: States: nothing written; after s; after u; after a. The role that comes next in each but the first.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIAL = {USER: "u", ASSISTANT: "a"}
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANK, DUPLICATE, CUT, SOUND = "b", "d", "t", "-"
#: Symbols of an empty role, which has no initial and so may be kept anywhere, and of all roles but s, u, a.
NAMELESS, OTHER = "0", "-"

ROWS = "conv_id long, turn long, role string, text string, code int"
RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, code) after the damage: a row per copy; dropped rows stay as code 0 without text, so that
    their conversation is known."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_id, turn)])
    plain = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).cast("int").alias("code"))
    code = F.col("code")
    return plain.select(
        "conv_id", "turn", F.when(code == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(code == 0, F.lit(None)).when(code == 1, F.lit("")).when(code == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        "code", F.explode(F.when(code == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _fault(text: Column) -> Column:
    """Blank, truncated or sound (whether a row is a duplicate shows in its conversation only)."""
    body = F.rtrim(text, F.lit(SPACES))
    return F.when(body == "", F.lit(BLANK)).when(F.right(body, F.lit(1)).isin(*ENDS), F.lit(SOUND)).otherwise(F.lit(CUT))


def ordered(damaged: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order. Kind 0 marks that the row after it is the first
    with its role and text, kind 1 is a row, kind 2 a dropped one."""
    rows = damaged.withColumn("md", F.md5("text"))
    left = rows.filter("code <> 0")
    first = left.groupBy("conv_id", "role", "md").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("t"))
    marks = first.select("conv_id", F.col("t.turn").alias("turn"), "role", "md", F.lit(0).alias("kind"),
                         F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"))
    seen = left.select("conv_id", "turn", "role", "md", F.lit(1).alias("kind"), "text", _fault(F.col("text")).alias("fault"))
    gone = rows.filter("code = 0").select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("md"),
        F.lit(2).alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("fault"))
    # byte order is code-point order; nulls come first, so a dropped row stands before all others
    return marks.unionByName(seen).unionByName(gone).repartition("conv_id") \
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "md", "kind")


def _kept(state: int, role: str) -> int | None:
    """The state after a row that keeps its role; none if the pattern does not allow it there."""
    if not role:
        return state
    after = AFTER[state]
    if role[0] == INITIAL[after]:
        return after
    return SYSTEM if state == EMPTY and role[0] == "s" else None


def _symbol(role: str, fault: str) -> str:
    return (NAMELESS if not role else role[0] if role[0] in "sua" else OTHER) + fault


def _edits(state: int, symbol: str):
    """(cost, letter, next state) of the edits that consume a row."""
    initial, fault = symbol
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    after = AFTER[state]
    kept = _kept(state, "" if initial == NAMELESS else initial)
    if kept is not None:
        yield KEEP + extra, "K", kept
    yield REROLE + extra, "R", after


@lru_cache(maxsize=100_000)
def lightest(entries: tuple[tuple[int, int], ...], symbols: str, last: bool) -> dict[int, tuple[int, str, int]]:
    """Knuth's agenda over a run of rows (two letters each). ``entries`` are (state, cost) of the items before it, in the order
    of their audits. Returns {state: (cost, audit of these rows, entry)} of the items behind it; of the last run
    only the one that the goal derives from."""
    n = len(symbols) // 2
    agenda = [(cost, rank, "", 0, state) for rank, (state, cost) in enumerate(entries)]
    heapq.heapify(agenda)
    final, out = set(), {}
    goal = n + 1
    while agenda:
        cost, rank, audit, i, state = heapq.heappop(agenda)
        if i == goal:
            return {state: (cost, audit, rank)}
        if (i, state) in final:
            continue
        final.add((i, state))
        if i == n:
            if not last:
                out[state] = (cost, audit, rank)
                continue
            if state in (EMPTY, ASSISTANT):
                heapq.heappush(agenda, (cost, rank, audit, goal, state))
        heapq.heappush(agenda, (cost + INSERT, rank, audit + "I", i, AFTER[state]))
        if i < n:
            for more, letter, after in _edits(state, symbols[2 * i:2 * i + 2]):
                heapq.heappush(agenda, (cost + more, rank, audit + letter, i + 1, after))
    return out


def apply_audit(state: int, audit: str, rows):
    """(role, text) of the repaired rows, from the state before ``rows`` (role, text, fault)."""
    rows = iter(rows)
    for letter in audit:
        if letter == "I":
            state = AFTER[state]
            yield ROLE[state], ""
            continue
        role, text, _ = next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = _kept(state, role)
            yield role, text
        else:
            state = AFTER[state]
            yield ROLE[state], text


class _Conversation:
    """One conversation as it streams by."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.lo, self.hi = 0, None, None
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0, SOUND: 0}
        self.illegal, self.before, self.rows, self.size = 0, None, [], 0
        # live items, least audit first: state, cost, audit so far in parts (linked), hash of the output, whether there is any
        self.items = [(EMPTY, 0, None, hashlib.sha256(), False)]

    def add(self, turn, role, text, fault, first):
        if turn is not None and turn != self.hi:
            self.lo = turn if self.lo is None else self.lo
            self.hi, self.turns = turn, self.turns + 1
        if fault != BLANK and not first:
            fault = DUPLICATE
        self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        if fault in (BLANK, DUPLICATE):
            text = ""
        self.rows.append((role, text, fault))
        self.size += len(text)
        if len(self.rows) >= CHUNK_ROWS or self.size >= CHUNK_BYTES:
            self.settle(False)

    def settle(self, last):
        symbols = "".join(_symbol(role, fault) for role, _, fault in self.rows)
        least = min(item[1] for item in self.items)
        found = lightest(tuple((state, cost - least) for state, cost, *_ in self.items), symbols, last)
        items = []
        for after, (cost, audit, rank) in sorted(found.items(), key=lambda x: (x[1][2], x[1][1])):
            state, _, parts, digest, some = self.items[rank]
            digest = digest.copy()
            for role, text in apply_audit(state, audit, self.rows):
                digest.update((("\n" if some else "") + f"{role}:{text}").encode())
                some = True
            items.append((after, cost + least, (parts, audit), digest, some))
        self.items, self.rows, self.size = items, [], 0

    def result(self):
        self.settle(True)
        _, cost, parts, digest, _ = self.items[0]
        audit = []
        while parts is not None:
            parts, part = parts
            audit.append(part)
        gaps = 0 if self.lo is None else self.hi - self.lo + 1 - self.turns
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, cost, "".join(reversed(audit)), digest.hexdigest())


def _columns(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _repair(batches):
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, first, out = None, False, []
    for batch in batches:
        for conv_id, turn, kind, role, text, fault in _columns(batch, "conv_id", "turn", "kind", "role", "text", "fault"):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(conv_id)
            if kind == 1:
                now.add(turn, role, text, fault, first)
            first = kind == 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.result(), schema, strict=True)], schema=schema)


def repair(damaged: DataFrame) -> DataFrame:
    """A row per conversation of ``damaged`` (as ``damage`` returns it): faults, the cheapest edits and the
    hash of the repaired conversation."""
    return ordered(damaged).mapInArrow(_repair, RESULT)


def _rewrite(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    audit, at, state, place = "", 0, EMPTY, 0
    for batch in batches:
        out = []
        for conv_id, kind, role, text, edits in _columns(batch, "conv_id", "kind", "role", "text", "audit"):
            if kind == -1:
                audit, at, state, place = edits, 0, EMPTY, 0
                stop = len(audit) - len(audit.lstrip("I")) if not audit.strip("I") else 0
            elif kind == 1:
                stop = at
                while audit[stop] == "I":
                    stop += 1
                stop += 1
                if not audit[stop:].strip("I"):  # the last row takes the inserts behind it
                    stop = len(audit)
            else:
                continue
            for r, t in apply_audit(state, audit[at:stop], [(role, text, None)]):
                state = _kept(state, r)
                out.append((conv_id, place, r, t))
                place += 1
            at = stop
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def repaired_rows(damaged: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, place, role, text), from the audits of ``repair``."""
    null = F.lit(None).cast("string")
    audits = repaired.select("conv_id", F.lit(None).cast("long").alias("turn"), null.alias("role"), null.alias("md"), F.lit(-1).alias("kind"),
                             null.alias("text"), "audit")
    rows = damaged.filter("code <> 0").select("conv_id", "turn", "role", F.md5("text").alias("md"), F.lit(1).alias("kind"), "text", null.alias("audit"))
    both = audits.unionByName(rows).repartition("conv_id") \
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "md")
    return both.mapInArrow(_rewrite, "conv_id long, place long, role string, text string")
