"""Repair of conversations by the cheapest edits that give the role order ``(s?(ua)+)?``, found by iterative-deepening A*.

Rows are dealt by ranges of (conversation, turn, role, text) and sorted inside them, so each partition reads whole conversations in
order, but for those that a border cuts, and a conversation of any length is spread over as many partitions as it fills.
Whole conversations are repaired where they are read. Cut or very long ones are left open and repaired in segments: a segment's
search runs for each pair of a role state before and after it, and a short table of costs and orders, one row a segment, tells
which of these follow one another. That is exact: the last edit of a segment takes a row, so no segment's audit is the beginning
of another one's for the same rows, and least audits are put together from least parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.work import Scratch

SEGMENT = 64  # rows searched at once
HELD, HELD_CHARS = 4096, 1 << 24  # rows and code points of a conversation that is repaired where it is read
BATCH = 512
#: Costs of the edits; a truncated row that is not deleted costs 1 more.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 3, 2, 0, 2, 1
#: Role states: nothing yet, after system, after user, after assistant. What each role leads to, and where a conversation may end.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
MADE = {0: "user", 1: "user", 2: "assistant", 3: "user"}  # the role that an insertion or a new role takes in a state
REACHED = {0: (0, 1, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (2, 3)}
CLOSING = {0: "", 1: "II", 2: "I", 3: ""}  # insertions that end a conversation
WORD = re.compile(r"[^\x20\x09-\x0D]")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


@lru_cache(200_000)
def search(rows: str, entry: int = 0, goal: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``rows`` from role state ``entry``, ties to the least audit.

    A row is s, u, a or o (its role; capital: truncated) or x (must be deleted). Without ``goal`` the conversation ends here;
    with it the last edit takes the last row and leads to that state, or None where nothing does.

    Iterative deepening: the cost bound rises by one until a depth-first search in the order of the edits' letters gets through;
    so its first path is the answer. A state is a place and a role state; the table holds for each the largest rest of
    the bound with which it failed. The estimate of what is to come never exceeds it: deletions that must be, truncated
    rows, and one for each pair of neighbours out of order, as an edit costs at least one for each of the two pairs it can mend.
    """
    n = len(rows)
    if goal is not None and (goal not in REACHED[entry] or (goal == 1 and entry == 0 and "s" not in rows.lower()) or (n == 0 and goal != entry)):
        return None
    ahead, rest = ["$"] * (n + 1), [0] * (n + 1)
    legal = {("s", "u"), ("u", "a"), ("a", "u"), ("a", "$")} | ({("s", "$"), ("u", "$"), ("o", "$")} if goal is not None else set())
    for i in range(n - 1, -1, -1):
        role = rows[i].lower()
        if role == "x":
            ahead[i], rest[i] = ahead[i + 1], rest[i + 1] + DELETE
        else:
            ahead[i], rest[i] = role, rest[i + 1] + ((role, ahead[i + 1]) not in legal) + (TRUNCATED if rows[i].isupper() else 0)

    def wrong(state: int, role: str) -> bool:
        return (state, role) not in NEXT and not (role == "$" and (goal is not None or state in ENDS))

    failed: dict[tuple[int, int], int] = {}

    def through(i: int, state: int, left: int) -> str | None:
        if i == n and (state in ENDS if goal is None else state == goal):
            return ""
        if rest[i] + wrong(state, ahead[i]) > left or failed.get((i, state), -1) >= left or (i == n and goal is not None):
            return None
        made = 3 if state == 2 else 2
        tries = []
        if i < n:
            tries.append(("D", i + 1, state, DELETE))
        tries.append(("I", i, made, INSERT))
        if i < n and rows[i] != "x":
            extra, role = (TRUNCATED if rows[i].isupper() else 0), rows[i].lower()
            if (state, role) in NEXT:
                tries.append(("K", i + 1, NEXT[state, role], KEEP + extra))
            tries.append(("R", i + 1, made, REROLE + extra))
        for letter, j, after, cost in tries:
            if cost <= left and (found := through(j, after, left - cost)) is not None:
                return letter + found
        failed[i, state] = left
        return None

    bound = rest[0] + wrong(entry, ahead[0])
    while (found := through(0, entry, bound)) is None:
        bound += 1
    return bound, found


def options(rows: str) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a segment."""
    return [(a, b, *found) for a in range(4) for b in range(4) if (found := search(rows, a, b))]


def chosen(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Cost of the whole and the audit of each segment (the closing insertions last), from the options of all segments.

    From the end on: what a state costs until the end, then the options that meet it. Among options of one segment and one
    entry, audits differ where exits do, so the order of these audits decides a tie."""
    cost = {s: INSERT * len(a) for s, a in CLOSING.items()}
    ways = []
    for segment in reversed(segments):
        best = {}
        for a, b, c, audit in segment:
            if b in cost and (a not in best or (c + cost[b], audit) < best[a][:2]):
                best[a] = (c + cost[b], audit, b)
        ways.append(best)
        cost = {a: w[0] for a, w in best.items()}
    state, audits = 0, []
    for best in reversed(ways):
        _, audit, after = best[state]
        audits.append(audit)
        state = after
    return cost[0], [*audits, CLOSING[state]]


def audit_of(rows: str, segment: int = SEGMENT) -> tuple[int, str]:
    if len(rows) <= segment:
        return search(rows)
    cost, audits = chosen([options(rows[i : i + segment]) for i in range(0, len(rows), segment)])
    return cost, "".join(audits)


class Repair:
    """Counts and edits of one conversation, whose rows come in order."""

    def __init__(self) -> None:
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.state, self.digest, self.some = 0, hashlib.sha256(), False

    def symbol(self, turn: int | None, role: str, look: str, repeated: bool) -> str:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        initial = look.lower() if look != "x" else role[:1]
        initial = initial if initial in ("s", "u", "a") else "o"
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.blank += look == "x"
        self.duplicate += look != "x" and repeated
        self.truncated += look.isupper() and not repeated
        return "x" if repeated else look

    def edit(self, audit: str, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
        """The repaired (role, text), one after another."""
        at = 0
        for letter in audit:
            if letter == "I":
                role, text = MADE[self.state], ""
            else:
                role, text = rows[at]
                at += 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = MADE[self.state]
            self.state = NEXT[self.state, role[:1]]
            self.digest.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True
            yield role, text

    def report(self, cost: int, audit: str) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.digest.hexdigest()


def look_of(role: str, text: str) -> str:
    """A row's symbol but for repetition: x for blank, else its role, as a capital if its last character ends no sentence."""
    if not WORD.search(text):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else initial.upper()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows as the crc32 of ``conv_id:turn`` damages them; a dropped row has no copy."""
    kind = conversations.schema["conv_id"].dataType
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = conversations.select(F.col("conv_id").cast(kind).alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20).alias("damage"))
    text = F.when(F.col("damage") <= 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1).alias("copies"))


def intact(conversations: DataFrame) -> DataFrame:
    """The same columns of conversations as they are."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.lit(1).alias("copies"))


def _schema(kind: str) -> str:
    return f"conv_id {kind}, part int, idx long, turn long, role string, text string, copies int, look string, digest binary, seen boolean, {REPORT}"


class _Out:
    """Rows for Arrow, in batches."""

    def __init__(self, ddl: str):
        fields = [f.split() for f in ddl.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        self.names, self.kinds, self.rows, self.size = [f[0] for f in fields], [kinds[f[1]] for f in fields], [], 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if len(self.rows) >= BATCH or self.size > HELD_CHARS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.rows), self.kinds)], self.names)
        self.rows, self.size = [], 0


def _stream(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(*(c.to_pylist() for c in part.columns))


def _digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def repaired(conversations: DataFrame, turns: bool = False, size_of_segment: int = SEGMENT, most_held: int = HELD) -> DataFrame:
    """Repairs rows (conv_id, turn, role, text, copies), as ``damaged`` or ``intact`` give them.

    One report a conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; or, with ``turns``, the
    repaired turns themselves: (conv_id, place, role, text).

    Rows go by turn, nulls first; rows of one turn by role, then text (its first 64 characters, then its hash). Rows without
    copies only say that the conversation exists. Nulls: conversations without conv_id are one conversation; null roles and
    texts are one space. Very long texts stay whole. Repeated rows are duplicates. An empty table gives no rows. A conversation
    whose rows are all dropped gives zeros. Any other columns are left out. Only the digest of a long conversation's
    repaired text is taken by one task, which streams it, as SHA-256 has no other way.
    """
    session = conversations.sparkSession
    scratch = Scratch(session)
    kind = conversations.schema["conv_id"].dataType.simpleString().replace("bigint", "long")
    ddl = _schema(kind)
    if kind not in ("long", "int", "string"):
        raise ValueError("conv_id is an integer or a string")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, out = TaskContext.get().partitionId(), _Out(ddl)
        idx, first, rows, size, seen, open_, current = 0, True, [], 0, set(), True, object()

        def spill():
            nonlocal idx, rows, size
            for conv, turn, role, text, copies in rows:
                digest = _digest(role, text)
                yield from out.add((conv, number, idx, turn, role, text, copies, look_of(role, text), digest, digest in seen, *[None] * 8), len(text))
                idx += 1
                if copies:
                    seen.add(digest)
            rows, size = [], 0

        def close(last: bool):
            nonlocal rows, size, open_
            if not rows and not seen:
                return
            if open_ or last:
                yield from spill()
            else:
                yield from whole()
            rows, size, open_ = [], 0, False
            seen.clear()

        def whole():
            work, known, symbols, real = Repair(), set(), [], []
            conv = rows[0][0]
            for _, turn, role, text, copies in rows:
                look, digest = look_of(role, text), _digest(role, text)
                for _ in range(copies):
                    symbols.append(work.symbol(turn, role, look, digest in known))
                    real.append((role, text))
                    known.add(digest)
            cost, audit = audit_of("".join(symbols), size_of_segment)
            for k, (role, text) in enumerate(work.edit(audit, real)):
                if turns:
                    yield from out.add((conv, None, k, None, role, text, *[None] * 12), len(text))
            if not turns:
                yield from out.add((conv, *[None] * 9, *work.report(cost, audit)))

        for row in _stream(parts):
            if first or row[0] != current:
                if not first:
                    yield from close(False)
                    open_ = False
                first, current = False, row[0]
            rows.append(row)
            size += len(row[3])
            if len(rows) >= most_held or size >= HELD_CHARS:
                open_ = True
                yield from spill()
        yield from close(True)
        yield from out.rest()

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 64), F.xxhash64("text"), F.col("salt")]
    rows = conversations.withColumn("salt", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    saved = scratch.save(dealt.mapInArrow(read, ddl))
    result = ["conv_id", *(f.split()[0] for f in REPORT.split(", "))] if not turns else ["conv_id", F.col("idx").alias("place"), "role", "text"]
    done = saved.filter("part IS NULL").select(*result)

    # conversations that a border cuts, or too long to hold
    cut = saved.filter("part IS NOT NULL").withColumn("segment", F.floor(F.col("idx") / size_of_segment))
    asked = cut.filter("copies > 0 AND NOT seen").select("conv_id", "digest", "part")
    known = asked.groupBy("conv_id", "digest").agg(F.min("part").alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("k_conv"), F.col("digest").alias("k_digest"), "origin")
    # a key has one row a partition here, as repetitions inside a partition are marked already
    late = asked.join(known, F.col("conv_id").eqNullSafe(F.col("k_conv")) & (F.col("digest") == F.col("k_digest"))).filter("part > origin").select(F.col("conv_id").alias("l_conv"), F.col("digest").alias("l_digest"), F.col("part").alias("l_part"), F.lit(True).alias("late"))
    light = cut.select("conv_id", "part", "segment", "idx", "copies", "look", "seen", "digest")
    flagged = light.filter("seen").withColumn("again", F.lit(True)).unionByName(
        light.filter("NOT seen").join(late, F.col("conv_id").eqNullSafe(F.col("l_conv")) & (F.col("digest") == F.col("l_digest")) & (F.col("part") == F.col("l_part")), "left").select(*light.columns, F.coalesce("late", F.lit(False)).alias("again"))
    )
    symbol = F.when(F.col("again"), "x").otherwise(F.col("look"))
    symbol = F.when(F.col("copies") == 0, "").when(F.col("copies") == 1, symbol).otherwise(F.concat(symbol, F.lit("x")))
    parts = flagged.groupBy("conv_id", "part", "segment").agg(F.array_sort(F.collect_list(F.struct("idx", symbol.alias("symbol"), "again"))).alias("rows"))
    found = "entry int, exit int, cost int, audit string"
    segments = f"conv_id {kind}, part int, segment long, again binary, options array<struct<{found.replace(' int', ': int').replace(' string', ': string')}>>"

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int32()), ("audit", pa.string())]))
        for batch in batches:
            listed = batch.column("rows").to_pylist()
            ways = [[dict(zip(("entry", "exit", "cost", "audit"), o)) for o in options("".join(r["symbol"] for r in rows))] for rows in listed]
            again = [bytes(r["again"] for r in rows) for rows in listed]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("segment"), pa.array(again, pa.binary()), pa.array(ways, struct)], ["conv_id", "part", "segment", "again", "options"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The way through all segments of a conversation: bounded by a few times its audit, which is one value of the result."""
        out = _Out(f"conv_id {kind}, part int, segment long, idx long, text string, digest binary, cost long")
        held: list[tuple] = []

        def settle():
            cost, audits = chosen([[tuple(o.values()) for o in h[4]] for h in held])
            audits[-2:] = ["".join(audits[-2:])]
            for h, audit in zip(held, audits):
                yield from out.add((h[0], h[1], h[2], -1, audit, h[3], cost))

        for row in _stream(batches):
            if held and held[0][0] != row[0]:
                yield from settle()
                held = []
            held.append(row)
        if held:
            yield from settle()
        yield from out.rest()

    solved = scratch.save(parts.mapInArrow(solve, segments))
    by = [F.asc_nulls_first("conv_id"), "part", "segment"]
    ways = solved.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(follow, f"conv_id {kind}, part int, segment long, idx long, text string, digest binary, cost long")
    ways = ways.select("conv_id", "part", "segment", "idx", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), "text", F.lit(0).alias("copies"), F.lit("").alias("look"), "digest", "cost")
    texts = cut.select("conv_id", "part", "segment", "idx", "turn", "role", "text", "copies", "look", F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("cost"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, work, audits, current, any_ = _Out(ddl), Repair(), [], None, False
        audit, flags, real, cost, place = "", b"", [], 0, 0

        def segment():
            nonlocal real, place
            for role, text in work.edit(audit, real):
                if turns:
                    yield from out.add((current, None, place, None, role, text, *[None] * 12), len(text))
                place += 1
            real = []

        def close():
            yield from segment()
            if not turns:
                yield from out.add((current, *[None] * 9, *work.report(cost, "".join(audits))))

        for conv, part, seg, idx, turn, role, text, copies, look, digest, total in _stream(batches):
            if idx < 0:
                if any_ and conv == current:
                    yield from segment()
                elif any_:
                    yield from close()
                if not any_ or conv != current:
                    work, audits, current, any_, place = Repair(), [], conv, True, 0
                audit, flags, at, cost = text, digest, 0, total
                audits.append(audit)
                continue
            again = bool(flags[at])
            at += 1
            for _ in range(copies):
                work.symbol(turn, role, look, again)
                real.append((role, text))
                again = True
        if any_:
            yield from close()
        yield from out.rest()

    told = ways.unionByName(texts).repartition("conv_id").sortWithinPartitions(*by, "idx").mapInArrow(tell, ddl)
    return done.unionByName(told.select(*result))


def repair(conversations: DataFrame) -> DataFrame:
    return repaired(damaged(conversations))
