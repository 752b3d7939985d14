"""Conversation repair against plain search."""

import functools
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from corpusforge.llm import repair

FINAL = re.compile(r"(s?(ua)+)?\Z")


def plain_damage(rows):
    """rows: (conv_id, turn, role, text) -> {conv_id: [(turn, role, text)]} in order, repeats adjacent."""
    out = {}
    for conv, turn, role, text in rows:
        at = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        at += [(turn, role, text)] * (2 if kind == 3 else 1)
    for at in out.values():
        at.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        if not body:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Cheapest first over (cost, audit), every edit allowed everywhere."""
    faults = plain_faults(rows)
    heap, done = [(0, "", 0, ())], set()
    while True:
        cost, audit, i, made = heapq.heappop(heap)
        roles = "".join(r[:1] for r, _ in made)
        if i == len(rows) and FINAL.match(roles):
            break
        if not re.match(r"s?(ua)*u?\Z", roles) or roles.count("s") > 1:
            continue
        node = (i, roles[-1:])  # the first to come is the cheapest, then the ASCII-least
        if node in done:
            continue
        done.add(node)
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, (*made, (role, ""))))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, (*made, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + extra + 2, audit + "R", i + 1, (*made, (new, text))))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


@functools.cache
def plain_least(rows, entry=repair.START, exits=repair.WHOLE):
    """(cost, audit) by plain recursion over all edits, bounded inserts."""
    found = []
    if not rows and entry in exits:
        found.append((0, ""))

    def go(rest, state, cost, audit, inserts):
        if not rest and state in exits:
            found.append((cost, audit))
        for e, c, t in repair._INSERTS[state]:
            if inserts < 2:
                go(rest, t, cost + c, audit + e, inserts + 1)
        if rest:
            for e, c, t in repair._CHOICES[rest[0]][state]:
                go(rest[1:], t, cost + c, audit + e, 0)

    go(rows, entry, 0, "", 0)
    return min(found) if found else None


def test_search_against_all_edit_lists():
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in (repair.NONE, repair.BLANK, repair.TRUNCATED)]
    rng = random.Random(1)
    for n in range(5):
        for rows in ([tuple(rng.choice(kinds) for _ in range(n)) for _ in range(25)]):
            assert repair.cheapest_edits(list(rows)) == plain_least(rows)
            for entry in range(4):
                for leave in range(4):
                    assert repair.cheapest_edits(list(rows), entry, (leave,)) == plain_least(rows, entry, (leave,))


def conversations(seed, n_convs, longest):
    rng = random.Random(seed)
    texts = ["Hello there.", "Yes!", "no end", "", " \t", None, "Why? ", "…", "x.\n", "日本。", "long " * 50 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "umpire"]
    weights = [30, 30, 8, 1, 1, 1, 1, 1]
    rows = []
    for c in range(n_convs):
        for t in range(rng.randrange(1, longest)):
            role = rng.choices(roles, weights)[0] if rng.random() < 0.4 else ("user", "assistant")[t % 2]
            rows.append((c, t * rng.choice([1, 1, 1, 2]), role, rng.choice(texts) if rng.random() < 0.5 else f"Row {c} {t}."))
    return rows


def distinct_ties(rows):
    """Rows of one turn and role in the order that a hash gives are not for the plain version."""
    def key(c, t, r):
        return (c, t, "user" if zlib.crc32(f"{c}:{t}".encode()) % 20 == 4 else r or " ")

    return list({key(c, t, r): (c, t, r, x) for c, t, r, x in rows}.values())


def compared(spark, rows, parts=3):
    rng = random.Random(7)
    mixed = rows[:]
    rng.shuffle(mixed)
    df = spark.createDataFrame([(*r, 1, "z") for r in mixed], "conv_id long, turn long, role string, text string, cost int, audit string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(df.repartition(parts))).collect()}
    want = {c: plain_repair(x) for c, x in plain_damage(rows).items()}
    assert got == want


def test_whole_job(spark):
    rows = distinct_ties(conversations(1, 150, 12))
    rows += [(None, t, "user", "A.") for t in range(5)] + [(500, None, "user", "No turn."), (500, None, "assistant", "None?"), (500, 4, "user", "x")]
    compared(spark, rows)


def test_one_long_conversation_in_many_ranges(spark):
    """A conversation over all ranges, and copies of one row that fill several."""
    rows = distinct_ties(conversations(3, 1, 2) + [(7, *r[1:]) for c in range(300) for r in [(0, c, ("user", "assistant")[c % 2] if c % 5 else "system", f"T {c % 90}" + "." * (c % 3))]])
    rows += [(9, 3, "user", "The same.")] * 200 + [(None, None, None, None)] * 50
    compared(spark, rows)


def test_outgrown_buffers(spark, monkeypatch):
    """Fragments inside a task: the buffer holds a few rows only."""
    monkeypatch.setattr(repair, "_HELD_BYTES", 1)
    rows = distinct_ties(conversations(5, 30, 25))
    batches = []

    class Context:
        @staticmethod
        def get():
            return type("T", (), {"partitionId": staticmethod(lambda: 3)})

    monkeypatch.setattr(repair, "TaskContext", Context)
    import pyarrow as pa

    ordered = [(c, t, r, x, 1) for c, got in sorted(plain_damage(rows).items()) for t, r, x in got]
    names = ["conv_id", "turn", "role", "text", "copies"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(names, zip(*ordered[k : k + 40]), strict=True))) for k in range(0, len(ordered), 40)]
    out = [r for b in repair._solve_ranges(iter(batches)) for r in b.to_pylist()]
    assert {r["conv_id"] for r in out} == {c for c, got in plain_damage(rows).items() if got}
    frags = [r for r in out if r["frag"] is not None]
    assert len({r["frag"] for r in frags}) > 100
    assert [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in sorted(frags, key=lambda r: (r["frag"], r["pos"]))] == [x[:4] for x in ordered]


def test_empty_and_all_dropped(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(repair.damaged(none)).count() == 0
    gone = [(c, 0, "user", "Hi.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = repair.repair(repair.damaged(spark.createDataFrame(gone, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == len(gone) and gone
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("n", [3000])
def test_long_search_is_linear(n):
    rng = random.Random(2)
    kinds = [(i, f) for i in ("s", "u", "a", "") for f in (repair.NONE, repair.BLANK, repair.TRUNCATED)]
    rows = [rng.choice(kinds) for _ in range(n)]
    cost, audit = repair.cheapest_edits(rows)
    assert sum(e != "I" for e in audit) == n
    assert cost == repair.suffix_bounds(rows, repair.WHOLE)[0][0] + repair.suffix_bounds(rows, repair.WHOLE)[0][1][0]
