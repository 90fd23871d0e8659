"""Repair of conversation structure by depth-first branch and bound.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``: an
optional system message, then user and assistant in turn. Its messages, in order of
their turn, are edited: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert
of an empty user or assistant message 5, and a truncated message that is not deleted
5 more. Blank messages and repeats must be deleted. Of the cheapest edits those win
whose initials, in order (the audit), are least by ASCII.

A node of the search is (messages read, state of the grammar). A table of suffix
bounds, filled from the end, gives each node the least cost that is left when the
audit is ignored. The search keeps an explicit stack, takes edits in ASCII order,
and drops a prefix that cannot reach the root's bound, that cannot beat the incumbent
(cost, audit), or that comes to a node which a prefix as cheap and less by ASCII has
reached before (one number a node). When the stack is empty the incumbent is proved.

On Spark a conversation may be as long as the table. Equal messages are grouped first
(only the first of them can stay), then all messages are sorted over range partitions
and cut into blocks of bounded rows and bytes. A block that holds a whole conversation
is finished where it is. Of the others each is searched between all states at its two
ends, the bounds of the blocks are added up backwards, and the blocks are walked in
order with an audit and a digest that grow block by block; texts are never held for
more than a block.
"""
from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Bounds of a block.
BLOCK_ROWS = 2048
BLOCK_BYTES = 4 << 20
#: What counts as white space, and how a whole message ends.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
_NEVER = 1 << 60
# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, PAIR = range(4)
DONE = (START, PAIR)
_NEXT = (USER, USER, PAIR, USER)  # of a message of the role that is due
_LEGAL = {"su", "ua", "au"}


def _moves() -> dict[tuple[str, bool], list[list[tuple[str, int, int]]]]:
    """(initial, truncated) -> for each state the edits (letter, cost, next state)
    of a message, in ASCII order. Initials but s, u, a are one kind."""
    out = {}
    for initial in "sua?":
        for cut in (False, True):
            more = TRUNCATED if cut else 0
            rows = []
            for state in range(4):
                edits = [("D", DELETE, state)]
                if (initial, state) in (("s", START), ("a", USER)) or (initial == "u" and state != USER):
                    edits.append(("K", KEEP + more, SYSTEM if initial == "s" else _NEXT[state]))
                rows.append(edits + [("R", REROLE + more, _NEXT[state])])
            out[initial, cut] = rows
    return out


MOVES = _moves()


def kind_of(role: str, cut: bool) -> tuple[str, bool]:
    initial = role[:1]
    return (initial if initial in ("s", "u", "a") else "?", cut)


def suffix_bounds(steps: list, goals: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
    """For each number of steps done and each state the least cost to ``goals``.
    A step is a number of messages that must go, or a (kind, truncated)."""
    def inserted(a, b, c, d):
        c, d = min(c, INSERT + d), min(d, INSERT + c)
        return min(a, INSERT + c), min(b, INSERT + c), c, d

    low = inserted(*[0 if s in goals else _NEVER for s in range(4)])
    out = [low]
    for step in reversed(steps):
        if isinstance(step, int):
            low = tuple(DELETE * step + x for x in low)
        else:
            low = inserted(*[min([cost + low[to] for _, cost, to in edits]) for edits in MOVES[step]])
        out.append(low)
    return out[::-1]


def search(steps: list, start: int = START, goals: tuple[int, ...] = DONE, low: list | None = None) -> tuple[int, str] | None:
    """The cheapest edits from ``start`` to one of ``goals``, as (cost, audit), ties
    ASCII-least; None if there are none."""
    low = low or suffix_bounds(steps, goals)
    limit = low[0][start]
    if limit >= _NEVER:
        return None
    best = None
    table: dict[tuple[int, int], int] = {}  # cost of the best prefix that reached a node
    stack: list[tuple] = [(0, start, 0, None)]
    while stack:
        i, state, cost, path = stack.pop()
        bound = cost + low[i][state]
        if bound > limit or best is not None and bound >= best[0]:
            continue
        if table.get((i, state), _NEVER) <= cost:
            continue
        table[i, state] = cost
        if i == len(steps) and state in goals:
            best = cost, path
            continue
        # Pushed in reverse, so that D, I, K, R are taken in this order.
        if i < len(steps) and isinstance(steps[i], int):
            stack.append((i, _NEXT[state], cost + INSERT, (path, "I")))
            stack.append((i + 1, state, cost + DELETE * steps[i], (path, "D" * steps[i])))
            continue
        edits = MOVES[steps[i]][state] if i < len(steps) else []
        for letter, price, to in reversed(edits[1:]):
            stack.append((i + 1, to, cost + price, (path, letter)))
        stack.append((i, _NEXT[state], cost + INSERT, (path, "I")))
        if edits:
            stack.append((i + 1, state, cost + DELETE, (path, "D")))
    cost, path = best
    letters = []
    while path:
        letters.append(path[1])
        path = path[0]
    return cost, "".join(reversed(letters))


def apply_edits(letters: str, rows, state: int):
    """(edit, role, text) of the messages that edits leave, and the state after
    each. ``rows`` yields (role, text) for the messages in order; a number stands
    for that many that go."""
    rows = iter(rows)
    i = 0
    while i < len(letters):
        letter = letters[i]
        i += 1
        if letter == "I":
            state = _NEXT[state]
            yield "I", "assistant" if state == PAIR else "user", "", state
            continue
        row = next(rows)
        if isinstance(row, int):
            i += row - 1
        elif letter == "K":
            state = SYSTEM if row[0][:1] == "s" else _NEXT[state]
            yield "K", row[0], row[1], state
        elif letter == "R":
            state = _NEXT[state]
            yield "R", "assistant" if state == PAIR else "user", row[1], state


class _Digest:
    """SHA-256 of ``role:text`` lines with newlines between."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True


class _Block:
    """Messages in a row of one conversation."""

    def __init__(self, conv) -> None:
        self.conv, self.bytes = conv, 0
        self.steps: list = []
        self.rows: list = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.turn_lo = self.turn_hi = self.first = self.last = None

    def add(self, turn, role: str, text: str | None, n: int, blank: bool, first: bool) -> None:
        if turn is not None and turn != self.turn_hi:
            self.turn_lo = turn if self.turn_lo is None else self.turn_lo
            self.turn_hi, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in _LEGAL)
        self.first = initial if self.first is None else self.first
        self.last = initial
        gone = n
        if blank:
            self.blank += n
        else:
            gone = n - first
            self.duplicate += gone
            if first:
                cut = text.rstrip(SPACE)[-1] not in ENDS
                self.truncated += cut
                self.steps.append(kind_of(role, cut))
                self.rows.append((role, text))
                self.bytes += len(role) + 4 * len(text)
        if gone:
            if self.steps and isinstance(self.steps[-1], int):
                self.steps[-1] += gone
                self.rows[-1] += gone
            else:
                self.steps.append(gone)
                self.rows.append(gone)

    @property
    def full(self) -> bool:
        return len(self.steps) >= BLOCK_ROWS or self.bytes >= BLOCK_BYTES

    def common(self) -> dict:
        return {"conv_id": self.conv, "turn_lo": self.turn_lo, "turn_hi": self.turn_hi, "turns": self.turns, "blank": self.blank,
                "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "first": self.first, "last": self.last}

    def whole(self, messages: bool) -> dict:
        cost, audit = search(self.steps)
        digest, kept = _Digest(), []
        for edit, role, text, _ in apply_edits(audit, self.rows, START):
            digest.add(role, text)
            if messages:
                kept.append((edit, role, text))
        return self.common() | {"whole": True, "cost": cost, "audit": audit, "sha": digest.sha.hexdigest(), "messages": [
            {"edit": e, "role": r, "text": t} for e, r, t in kept] if messages else None}

    def part(self) -> dict:
        costs, audits = [], []
        low = [suffix_bounds(self.steps, (goal,)) for goal in range(4)]
        for start in range(4):
            for goal in range(4):
                found = search(self.steps, start, (goal,), low[goal])
                costs.append(found[0] if found else _NEVER)
                audits.append(found[1] if found else None)
        rows = [{"gone": r} if isinstance(r, int) else {"role": r[0], "text": r[1]} for r in self.rows]
        return self.common() | {"whole": False, "costs": costs, "audits": audits, "rows": rows}


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


_COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal"]
_MESSAGE = T.StructType([_string("edit"), _string("role"), _string("text")])
_BLOCK = [T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("whole", T.BooleanType()),
          _long("turn_lo"), _long("turn_hi"), *[_long(c) for c in _COUNTS], _string("first"), _string("last"), _long("cost"),
          _string("audit"), _string("sha"), T.StructField("messages", T.ArrayType(_MESSAGE)),
          T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())),
          T.StructField("rows", T.ArrayType(T.StructType([_long("gone"), _string("role"), _string("text")])))]


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _batches(rows, schema, size: int = 64):
    """Dictionaries as record batches; a batch closes after ``size`` rows."""
    import pyarrow as pa
    held: list = []
    for row in rows:
        held.append({f.name: row.get(f.name) for f in schema})
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _stream(batches):
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns])


def _gaps(lo, hi, turns: int) -> int:
    return 0 if lo is None else hi - lo + 1 - turns


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``
    modulo 20: 0 drops the message, 1 empties its text, 2 removes ``.``, ``!`` and
    ``?``, 3 repeats it, 4 gives it the role user. Nulls count as one space. Column
    ``copies`` says how often a message stands; 0 keeps only the conversation's name."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"))


@dataclass
class Repair:
    """Blocks of a repaired table, and what is read from them."""

    blocks: DataFrame
    with_messages: bool

    @cached_property
    def _conv(self) -> T.StructField:
        return T.StructField("conv_id", self.blocks.schema["conv_id"].dataType)

    def _walked(self, messages: bool) -> DataFrame:
        """Conversations of several blocks: a row each, or their messages."""
        conv = self._conv
        parts = self.blocks.where("not whole")
        low_schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
                                   T.StructField("after", T.ArrayType(T.LongType()))])

        def bounds(batches):
            def rows():
                now, after = (), []
                for conv_id, part, seq, costs in _stream(batches):
                    if (conv_id,) != now:
                        now, after = (conv_id,), [0, _NEVER, _NEVER, 0]
                    yield {"part": part, "seq": seq, "after": after}
                    after = [min(min(costs[4 * s + e] + after[e] for e in range(4)), _NEVER) for s in range(4)]
            yield from _batches(rows(), _arrow(low_schema), 4096)

        low = (parts.select("conv_id", "part", "seq", "costs").repartition("conv_id")
               .sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq")).mapInArrow(bounds, low_schema))
        wide = ["conv_id", "turn_lo", "turn_hi", *_COUNTS, "first", "last", "costs", "audits", "rows", "after"]
        out = T.StructType([conv, _long("position"), *_MESSAGE.fields]) if messages else T.StructType(
            [conv, _long("gaps"), *[_long(c) for c in _COUNTS[1:]], _long("cost"), _string("audit"), _string("sha")])

        def walk(batches):
            def rows():
                now = None
                for values in _stream(batches):
                    r = dict(zip(wide, values))
                    if now is None or now.conv != r["conv_id"]:
                        if now is not None and not messages:
                            yield now.row()
                        now = _Walk(r["conv_id"], r)
                    for message in now.step(r):
                        if messages:
                            yield {"conv_id": now.conv, **message}
                if now is not None and not messages:
                    yield now.row()
            yield from _batches(rows(), _arrow(out), 512 if messages else 16)

        return (parts.join(low, ["part", "seq"]).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
                .select(*wide).mapInArrow(walk, out))

    @cached_property
    def report(self) -> DataFrame:
        """One row a conversation: conv_id, gaps, blank, duplicate, truncated,
        illegal, cost, audit and sha (of the repaired ``role:text`` lines)."""
        gaps = F.when(F.col("turn_lo").isNull(), 0).otherwise(F.col("turn_hi") - F.col("turn_lo") + 1 - F.col("turns"))
        whole = self.blocks.where("whole").select("conv_id", gaps.cast("long").alias("gaps"), *_COUNTS[1:], "cost", "audit", "sha")
        return whole.unionByName(self._walked(False))

    @cached_property
    def messages(self) -> DataFrame:
        """The repaired conversations, a row a message: conv_id, position (from 0),
        edit (K, R or I), role, text."""
        if not self.with_messages:
            raise ValueError("repair(rows, messages=True) keeps the messages")
        whole = self.blocks.where("whole").select("conv_id", F.posexplode("messages").alias("position", "m")).select(
            "conv_id", F.col("position").cast("long").alias("position"), "m.*")
        return whole.unionByName(self._walked(True))


class _Walk:
    """One conversation of several blocks, followed from its first block on.

    Of the prefixes that still lead to the least cost, one that differs from the
    least by ASCII is dropped; the rest extend it by inserts alone. The common part
    is final and is given out; ``tails`` holds what each state has beyond it."""

    def __init__(self, conv, first: dict) -> None:
        self.conv = conv
        costs, after = first["costs"], first["after"]
        self.goal = min(costs[e] + after[e] for e in range(4))
        self.tails = {START: (0, "")}
        self.state, self.position = START, 0
        self.audit: list[str] = []
        self.digest = _Digest()
        self.sums = dict.fromkeys(_COUNTS, 0)
        self.lo = self.hi = self.last = None

    def step(self, r: dict):
        for c in _COUNTS:
            self.sums[c] += r[c]
        if r["turn_lo"] is not None:
            self.sums["turns"] -= r["turn_lo"] == self.hi
            self.lo, self.hi = r["turn_lo"] if self.lo is None else self.lo, r["turn_hi"]
        if r["first"] is not None:
            self.sums["illegal"] += self.last is not None and self.last + r["first"] not in _LEGAL
            self.last = r["last"]
        costs, audits, after = r["costs"], r["audits"], r["after"]
        found = [(tail + audits[4 * s + e], e, cost + costs[4 * s + e]) for s, (cost, tail) in self.tails.items()
                 for e in range(4) if cost + costs[4 * s + e] + after[e] == self.goal]
        least = min(found)[0]
        self.tails = {e: (cost, letters[len(least):]) for letters, e, cost in found if letters.startswith(least)}
        self.audit.append(least)
        rows = (x["gone"] if x["role"] is None else (x["role"], x["text"]) for x in r["rows"])
        for edit, role, text, self.state in apply_edits(least, rows, self.state):
            self.digest.add(role, text)
            yield {"position": self.position, "edit": edit, "role": role, "text": text}
            self.position += 1

    def row(self) -> dict:
        return {"conv_id": self.conv, "gaps": _gaps(self.lo, self.hi, self.sums["turns"]), **{c: self.sums[c] for c in _COUNTS[1:]},
                "cost": self.goal, "audit": "".join(self.audit), "sha": self.digest.sha.hexdigest()}


def _blank(c: str) -> Column:
    return F.btrim(F.col(c), F.lit(SPACE)) == ""


def repair(rows: DataFrame, messages: bool = False) -> Repair:
    """Repair the conversations of ``rows`` (conv_id, turn, role, text and, if there
    is one, copies: how often the message stands, 0 for a row that only names its
    conversation). ``messages`` keeps the repaired messages beside the report.

    Messages are taken by turn, nulls first; those of one turn by role and by the
    SHA-256 of role and text. A null role or text is one space, so such a text is
    blank. A null conv_id is a conversation of its own. Faults, the first that holds
    counting: blank (nothing but white space), duplicate (role and text stand
    earlier in the conversation; so do all repeated rows but one), truncated (the
    last character that is not white space is none of ``.!?``). A conversation
    without messages has zeros, an empty audit and the digest of nothing. An empty
    table has no conversations. Other columns are not looked at.

    The audit and the digest of a conversation are one string and one hash chain by
    definition: they are put together by one task, from a row for each block.
    """
    small_batches(rows.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    src = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"),
                      n.alias("n"))
    none = F.lit(None)
    live = src.where("n > 0").withColumn("digest", F.unhex(F.sha2(F.concat(
        F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # The first turn of each message, nulls first; the rest of it are duplicates.
    first = (live.groupBy("conv_id", "digest").agg(F.min("turn").alias("turn"), F.max(F.col("turn").isNull()).alias("none"))
             .select("conv_id", F.when(~F.col("none"), F.col("turn")).alias("turn"), none.cast("string").alias("role"),
                     none.cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "digest", F.lit(True).alias("first")))
    names = src.where("n <= 0").select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"),
                                       none.cast("string").alias("text"), F.lit(0).cast("long").alias("n"),
                                       none.cast("binary").alias("digest"), F.lit(False).alias("first"))
    grouped = (live.withColumn("first", F.lit(False)).unionByName(first).unionByName(names)
               .groupBy("conv_id", "turn", "digest").agg(F.sum("n").alias("n"), F.max("first").alias("first"),
                                                         F.max("role").alias("role"), F.max("text").alias("text"))
               .withColumn("blank", _blank("text"))
               .withColumn("text", F.when(F.col("first") & ~F.col("blank"), F.col("text"))))
    order = ["conv_id", "turn", "role", "digest"]
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *_BLOCK])

    def cut(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()

        def blocks():
            seq, now, outer = 0, None, True  # outer: the conversation may begin before
            opened = False
            for conv_id, turn, role, text, n, blank, first in _stream(batches):
                if now is None or conv_id != now.conv:
                    if now is not None:
                        yield {"part": part, "seq": seq, **(now.part() if outer or opened else now.whole(messages))}
                        seq, outer = seq + 1, False
                    now, opened = _Block(conv_id), False
                elif now.full:
                    yield {"part": part, "seq": seq, **now.part()}
                    seq, now, opened = seq + 1, _Block(conv_id), True
                if role is not None:
                    now.add(turn, role, text, n, blank, first)
            if now is not None:
                yield {"part": part, "seq": seq, **now.part()}

        yield from _batches(blocks(), _arrow(schema))

    cut_up = (grouped.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("conv_id", "turn", "role", "text", "n", "blank", "first").mapInArrow(cut, schema))
    return Repair(written(cut_up, "blocks"), messages)
