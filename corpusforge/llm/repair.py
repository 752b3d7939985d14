"""Conversation structure repair (operator 11).

A conversation's rows are kept, given another role, deleted, or joined by
inserted empty rows until the roles read: a system row or none, then users
and assistants in turn. The cheapest edits are found by depth-first branch
and bound with an explicit stack:

* A node is (rows consumed, role state). Branches are tried in the order of
  the edits' initials, so a path found later has a greater audit.
* Bounds: the cheapest completion of every suffix from each state, found
  backwards. They are tight, so the search starts from the least cost itself
  and cuts whatever can't reach it; the first path to end proves itself
  cheapest and, of the cheapest, ASCII-least.
* A dominance table holds the least cost that reached each node. Arriving
  again at no less cost is a worse prefix with the same suffixes.

Rows are dealt by range of (conversation, turn), so a conversation of any
length is spread like the rest. One that lies whole within a task's range
ends there. Of the others (the first and the last of a range, and any that
outgrow a task's buffer) every fragment is solved from each state it can be
entered in to each it can be left in, and the fragments are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
DAMAGE_KINDS = 20
DROP, EMPTY, UNEND, REPEAT, REROLE = range(5)

#: What a row may cost: fixed by the task.
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1

#: Role states: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
WHOLE = (START, ASSISTANT)  # where a repaired conversation may end
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_FAULTS = NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
_FAR = 1 << 60

_HELD_BYTES = 16 << 20  # of one conversation's rows in a task
_OUT_BYTES = 4 << 20
_FRAGMENTS = 1 << 32  # a task's fragments at most


def _choices(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """By state: the (edit, cost, next state) that consume such a row, in ASCII order."""
    out = []
    for state in range(4):
        found = [("D", DELETE_COST, state)]
        if fault not in (BLANK, DUPLICATE):
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            found += [("K", extra, t) for t in [_AFTER.get(initial, {}).get(state)] if t is not None]
            found += [("R", REROLE_COST + extra, _AFTER[r][state]) for r in "ua" if state in _AFTER[r]]
        out.append(found)
    return out


_CHOICES = {(i, f): _choices(i, f) for i in ("s", "u", "a", "") for f in _FAULTS}
_INSERTS = [[("I", INSERT_COST, _AFTER[r][s]) for r in "ua" if s in _AFTER[r]] for s in range(4)]

Row = tuple[str, int]  # ("s", "u", "a" or "" for another initial, fault)


def _relaxed(costs: list[int]) -> tuple[int, ...]:
    """Costs to go with inserts allowed first (two inserts lead back to the same state)."""
    start, system, user, assistant = costs
    user, assistant = min(user, assistant + INSERT_COST), min(assistant, user + INSERT_COST)
    return min(start, user + INSERT_COST), min(system, user + INSERT_COST), user, assistant


def suffix_bounds(rows: list[Row], exits: Iterable[int]) -> list[tuple[int, tuple[int, ...]]]:
    """For every suffix, (base, by state: what more than base is needed to end in ``exits``)."""
    found = [(0, _relaxed([0 if s in exits else _FAR for s in range(4)]))]
    known: dict[tuple, tuple[int, tuple[int, ...]]] = {}
    for row in reversed(rows):
        base, after = found[-1]
        step = known.get((row, after))
        if step is None:
            costs = _relaxed([min(c + after[t] for _, c, t in options) for options in _CHOICES[row]])
            least = min(costs)
            step = known[row, after] = least, tuple(c - least for c in costs)
        found.append((base + step[0], step[1]))
    return found[::-1]


def cheapest_edits(rows: list[Row], entry: int = START, exits: Iterable[int] = WHOLE) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state ``entry`` to one of
    ``exits``, of those the ASCII-least audit; None where there are none."""
    n = len(rows)
    bounds = suffix_bounds(rows, exits)
    best = bounds[0][0] + bounds[0][1][entry]  # the incumbent's cost, its audit still unknown
    if best >= _FAR:
        return None
    audit: str | None = None
    reached = [_FAR] * (4 * n + 4)  # dominance: the least cost at each node
    path = bytearray()
    stack = [(0, entry, 0, 0, "")]
    while stack:
        i, state, cost, depth, edit = stack.pop()
        base, more = bounds[i]
        lower = cost + base + more[state]
        if lower > best or (lower == best and audit is not None) or reached[4 * i + state] <= cost:
            continue
        reached[4 * i + state] = cost
        del path[depth:]
        path += edit.encode()
        if i == n and state in exits:
            best, audit = cost, path.decode()
            continue
        branches = [(i, t, cost + c, len(path), e) for e, c, t in _INSERTS[state]]
        if i < n:
            options = [(i + 1, t, cost + c, len(path), e) for e, c, t in _CHOICES[rows[i]][state]]
            branches = options[:1] + branches + options[1:]
        stack += reversed(branches)
    assert audit is not None
    return best, audit


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str, int]]:
    """(role, text, state after it) of each row that the edits leave."""
    rows = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = "assistant" if state == USER else "user"
        state = _AFTER[role[:1]][state]
        yield role, text, state


def damaged(rows: DataFrame) -> DataFrame:
    """The query's fixed damage, by the CRC-32 of ``conv_id:turn``. ``copies``
    is 0 for a dropped row (which still names its conversation), 2 for a
    repeated one. Nulls in role and text are one space."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(DAMAGE_KINDS))
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == REROLE, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == EMPTY, "").when(kind == DROP, "").when(kind == UNEND, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == DROP, 0).when(kind == REPEAT, 2).otherwise(1).alias("copies"),
    )


def _own_fault(text: str) -> int:
    end = text.rstrip(BLANKS)
    return BLANK if not end else NONE if end[-1] in ENDS else TRUNCATED


def _kind(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


class _Counts:
    """Gaps and faults of rows seen in order; fragments are added up in order."""

    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first: str | None = None
        self.last: str | None = None
        self.low: int | None = None
        self.high: int | None = None

    def _join(self, first: str, low: int | None) -> bool:
        if self.last is not None and self.last + first not in ("su", "ua", "au"):
            self.illegal += 1
        return low is not None and low == self.high

    def add(self, initial: str, turn: int | None, fault: int) -> None:
        met = self._join(initial, turn)
        self.first = initial if self.first is None else self.first
        self.last = initial
        self.faults[fault] += 1
        if turn is not None:
            self.turns += not met
            self.low = turn if self.low is None else self.low
            self.high = turn

    def extend(self, other: _Counts) -> None:
        if other.first is None:
            return
        met = self._join(other.first, other.low)
        self.first = other.first if self.first is None else self.first
        self.last = other.last
        self.faults = [x + y for x, y in zip(self.faults, other.faults, strict=True)]
        self.illegal += other.illegal
        self.turns += other.turns - met
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high

    def values(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None or self.high is None else self.high - self.low + 1 - self.turns
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal


def _whole(rows: list[tuple[int | None, str, str]]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of one conversation."""
    counts, facts, seen = _Counts(), [], set()
    for turn, role, text in rows:
        fault = _own_fault(text)
        if fault != BLANK:
            name = _digest(role, text)
            fault = DUPLICATE if name in seen else fault
            seen.add(name)
        counts.add(role[:1], turn, fault)
        facts.append((_kind(role), fault))
    cost, audit = cheapest_edits(facts)
    text = "\n".join(f"{role}:{body}" for role, body, _ in repaired(((r, t) for _, r, t in rows), audit))
    return *counts.values(), cost, audit, hashlib.sha256(text.encode()).hexdigest()


_RESULT = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [
    ("audit", pa.string()),
    ("repaired_sha256", pa.string()),
]
_PIECE = [
    ("frag", pa.int64()),
    ("pos", pa.int64()),
    ("turn", pa.int64()),
    ("initial", pa.string()),
    ("fault", pa.int32()),
    ("digest", pa.binary()),
    ("role", pa.string()),
    ("text", pa.string()),
]
_SQL = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{name} {_SQL[kind]}" for name, kind in fields)


class _Out:
    """Output rows, given on in batches of bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]) -> None:
        self.schema = pa.schema(list(zip(names, types, strict=True)))
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 200) -> None:
        self.rows.append(row)
        self.size += size

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), self.schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self.rows, self.size = [], 0


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True)


def _solve_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of rows in order: results of the conversations that lie
    whole in it, and the rows of the others in numbered fragments."""
    out = None
    fragment = TaskContext.get().partitionId() * _FRAGMENTS
    conv: tuple = ()  # of the conversation being read: (its id,)
    held: list[tuple] = []
    size, first, partial = 0, True, False

    def give_rows() -> Iterator[pa.RecordBatch]:
        """The held rows as a fragment (one without role where all were dropped)."""
        nonlocal fragment, held, size
        for pos, (turn, role, text) in enumerate(held or [(None, None, None)]):
            facts = (None, None, None) if role is None else (role[:1], _own_fault(text), _digest(role, text))
            out.add((*conv, *[None] * len(_RESULT), fragment, pos, turn, *facts, role, text), 200 + len(text or ""))
            yield from out.batches(_OUT_BYTES)
        fragment += 1
        held, size = [], 0

    def end(border: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if partial and not held:
            return  # its last row ended a fragment
        if border or partial:
            yield from give_rows()
        else:
            out.add((*conv, *_whole(held), *[None] * len(_PIECE)), 200 + len(held))
            yield from out.batches(_OUT_BYTES)
            held, size = [], 0

    for batch in batches:
        if out is None:
            fields = _RESULT + _PIECE
            out = _Out(["conv_id", *[n for n, _ in fields]], [batch.schema.types[0], *[t for _, t in fields]])
        for conv_id, turn, role, text, copies in _rows([batch]):
            if conv != (conv_id,):
                if conv:
                    yield from end(border=first)
                    first = False
                conv, partial = (conv_id,), False
            for _ in range(copies):
                held.append((turn, role, text))
                size += 200 + len(text)
            if size > _HELD_BYTES:
                yield from give_rows()
                partial = True
    if conv:
        yield from end(border=True)
        yield from out.batches()


_SOLVED = [
    ("frag", pa.int64()),
    ("faults", pa.list_(pa.int64())),
    *[(c, pa.int64()) for c in ("illegal", "turns", "low", "high")],
    ("first", pa.string()),
    ("last", pa.string()),
    ("costs", pa.list_(pa.int64())),
    ("audits", pa.list_(pa.string())),
]
_SQL |= {pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.string()): "array<string>"}


def _solve_fragment(table: pa.Table) -> pa.Table:
    """A fragment's counts, and the cheapest edits from every state to every state."""
    table = table.sort_by("pos")
    counts, facts = _Counts(), []
    for turn, initial, fault in zip(*(table.column(c).to_pylist() for c in ("turn", "initial", "fault")), strict=True):
        if initial is not None:
            counts.add(initial, turn, fault)
            facts.append((_kind(initial), fault))
    solved = [cheapest_edits(facts, entry, (leave,)) for entry in range(4) for leave in range(4)]
    found = {
        "frag": table.column("frag")[0].as_py(),
        **{c: getattr(counts, c) for c in ("faults", "illegal", "turns", "low", "high", "first", "last")},
        "costs": [None if s is None else s[0] for s in solved],
        "audits": [None if s is None else s[1] for s in solved],
    }
    columns = [table.column("conv_id").slice(0, 1).combine_chunks(), *[pa.array([found[n]], t) for n, t in _SOLVED]]
    return pa.Table.from_arrays(columns, names=["conv_id", *[n for n, _ in _SOLVED]])


#: What the joined fragments send to the digests: an edit list for each
#: fragment (pos -1), with the state it is entered in and, once, the totals.
_EDITS = [("frag", pa.int64()), ("pos", pa.int64()), ("entry", pa.int64()), ("text", pa.string()), ("totals", pa.list_(pa.int64()))]


def _join_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' solved fragments in order: the cheapest way through them."""
    out = None
    conv: tuple = ()
    counts = _Counts()
    frags: list[int] = []
    ways: dict[int, tuple[int, str, tuple]] = {}  # by state: cost, audit, (state, audit) of each fragment

    def end() -> None:
        cost, _, steps = min(ways[s] for s in WHOLE if s in ways)
        for k, (frag, (entry, audit)) in enumerate(zip(frags, steps, strict=True)):
            totals = [*counts.values(), cost] if k == 0 else None
            out.add((*conv, frag, -1, entry, audit, totals), 200 + len(audit))

    for batch in batches:
        out = out or _Out(["conv_id", *[n for n, _ in _EDITS]], [batch.schema.types[0], *[t for _, t in _EDITS]])
        for conv_id, frag, faults, illegal, turns, low, high, first, last, costs, audits in _rows([batch]):
            if conv != (conv_id,):
                if conv:
                    end()
                    yield from out.batches(_OUT_BYTES)
                conv, counts, frags, ways = (conv_id,), _Counts(), [], {START: (0, "", ())}
            part = _Counts()
            part.faults, part.illegal, part.turns = faults, illegal, turns
            part.low, part.high, part.first, part.last = low, high, first, last
            counts.extend(part)
            frags.append(frag)
            ways = {
                leave: min(
                    (cost + costs[4 * entry + leave], audit + audits[4 * entry + leave], (*steps, (entry, audits[4 * entry + leave])))
                    for entry, (cost, audit, steps) in ways.items()
                    if costs[4 * entry + leave] is not None
                )
                for leave in range(4)
                if any(costs[4 * entry + leave] is not None for entry in ways)
            }
    if conv:
        end()
        yield from out.batches()


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' edit lists, each followed by its fragment's rows: results.
    Texts go through the digest one by one and are not held."""
    out = None
    conv: tuple = ()
    totals: list[int] = []
    audits: list[str] = []
    digest, written, state, at, audit = hashlib.sha256(), False, START, 0, ""

    def write(role: str, text: str) -> None:
        nonlocal written
        digest.update(f"{chr(10) if written else ''}{role}:{text}".encode())
        written = True

    def edit(role: str | None, text: str | None) -> None:
        """Apply the fragment's edits up to the one that consumes this row (all the rest without a row)."""
        nonlocal at, state
        while at < len(audit):
            e, at = audit[at], at + 1
            if e == "I" or role is not None:
                for new, body, after in repaired([(role, text)], e, state):
                    write(new, body)
                    state = after
            if e != "I":
                return

    def end() -> None:
        edit(None, None)
        out.add((*conv, *totals, "".join(audits), digest.hexdigest()), 200 + sum(map(len, audits)))

    for batch in batches:
        out = out or _Out(["conv_id", *[n for n, _ in _RESULT]], [batch.schema.types[0], *[t for _, t in _RESULT]])
        for conv_id, _, pos, entry, role, text, found in _rows([batch]):
            if conv != (conv_id,):
                if conv:
                    end()
                    yield from out.batches(_OUT_BYTES)
                conv, audits, audit, at, digest, written = (conv_id,), [], "", 0, hashlib.sha256(), False
            if pos < 0:
                edit(None, None)  # inserts at the end of the fragment before
                audits.append(text)
                audit, at, state = text, 0, entry
                totals = found or totals
            else:
                edit(role, text)
    if conv:
        end()
        yield from out.batches()


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows(conv_id, turn, role, text, copies)``:
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows come by turn, nulls first; rows of one turn by role, then by a hash of
    the text. ``copies`` repeats a row in place, and 0 leaves it out; a
    conversation without rows has zeros, an empty audit and the empty string's
    digest. Role and text must not be null (``damaged`` makes them one space);
    roles that start with neither s, u nor a can't be kept. A null conv_id is a
    conversation like others. Rows equal in all are all duplicates but the
    first. Other columns are ignored; an empty table gives an empty result.

    Very long conversations are spread over tasks by turn, and only one thing
    of theirs passes through one task: the kept texts, row by row, through
    SHA-256, which can't be split, and the audit, which is one value."""
    scratch = Scratch(rows.sparkSession, "repair")
    conv = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", F.col("copies").cast("int").alias("copies"))
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    # the last key differs in every row, so copies of one row are spread as well
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_tie", "_row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie", "_row")
    solved = scratch.cut(dealt.mapInArrow(_solve_ranges, f"conv_id {conv}, {_ddl(_RESULT + _PIECE)}"), "solved")
    names = ["conv_id", *[n for n, _ in _RESULT]]
    whole = solved.where("frag is null").select(*names)

    pieces = solved.where("frag is not null").select("conv_id", *[n for n, _ in _PIECE])
    told = pieces.where(f"fault <> {BLANK}").groupBy("conv_id", "digest").agg(F.min(F.struct("frag", "pos")).alias("at"))
    told = told.select(F.col("at.frag").alias("f"), F.col("at.pos").alias("p"))  # where a row is said first
    facts = pieces.drop("role", "text", "digest").join(told, (F.col("frag") == F.col("f")) & (F.col("pos") == F.col("p")), "left")
    repeated = F.col("p").isNull() & (F.col("fault") != BLANK)
    facts = facts.withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("fault"))).drop("f", "p")
    facts = scratch.cut(facts.groupBy("frag").applyInArrow(_solve_fragment, f"conv_id {conv}, {_ddl(_SOLVED)}"), "fragments")
    edits = (
        facts.repartition("conv_id")
        .sortWithinPartitions("conv_id", "frag")
        .mapInArrow(_join_fragments, f"conv_id {conv}, {_ddl(_EDITS)}")
        .withColumn("role", F.lit(None).cast("string"))
    )
    said = pieces.where("role is not null").withColumns({"entry": F.lit(None).cast("bigint"), "totals": F.lit(None).cast("array<bigint>")})
    columns = ["conv_id", "frag", "pos", "entry", "role", "text", "totals"]
    joined = edits.select(*columns).union(said.select(*columns))
    late = joined.repartition("conv_id").sortWithinPartitions("conv_id", "frag", "pos")
    late = scratch.cut(late.mapInArrow(_digest_rows, f"conv_id {conv}, {_ddl(_RESULT)}"), "late")
    scratch.drop(keep=[solved, late])
    return whole.union(late)
