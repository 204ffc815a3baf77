"""Conversation repair against a plain search over all edits, also across cut conversations."""

import functools
import hashlib
import random
import re
import zlib

from actloom.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, audit int, n string, cost string"


def damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = out.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        held += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
    return {c: sorted(x, key=order) for c, x in out.items()}


def repaired_by_hand(turns):
    """All fields of a result row, by a search over edits of turns."""
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    def last(roles):
        return re.fullmatch("(s?(ua)+)?", roles) is not None

    @functools.cache
    def best(i, state, room):
        """Least (cost, audit, rows) from turn i on; state: initials so far, as far as they matter; room: inserts."""
        found = []
        if i == len(turns) and last({"": "", "s": "s", "u": "u", "a": "ua"}[state]):
            found.append((0, "", ()))
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[state]

        def add(cost, edit, role, text, j, room):
            if role[:1] and role[:1] in follows:
                rest = best(j, role[0], room)
                if rest:
                    found.append((cost + rest[0], edit + rest[1], ((role, text), *rest[2])))

        if room:
            for role in ("user", "assistant"):
                add(5, "I", role, "", i, room - 1)
        if i < len(turns):
            _, role, text = turns[i]
            rest = best(i + 1, state, 3)
            if rest:
                found.append((2 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                add(more, "K", role, text, i + 1, 3)
                for new in ("user", "assistant"):
                    add(more + 1, "R", new, text, i + 1, 3)
        return min(found) if found else None

    cost, audit, rows = best(0, "", 3)
    initials = [r[:1] for _, r, _ in turns]
    times = [t for t, _, _ in turns if t is not None]
    return (
        max(times) - min(times) + 1 - len(set(times)) if times else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest(),
    )


def conversations(seed, n):
    rng = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "s", None, "ass"])
            text = rng.choice(["Yes.", "No!", "Why? \n", "cut", "\t ", "", None, "é..", "long " * 40 + "."])
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, None, 5]), role, text))
    out += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (7, 5, "user", "Yes."), (7, 5, "user", "Yes.")]
    out += [(-4, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]
    return out


def expected(rows):
    return {c: repaired_by_hand(t) for c, t in damaged_by_hand(rows).items()}


def result(df):
    return {r[0]: tuple(r[1:]) for r in cr.repair(df).collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "c") for r in rows], SCHEMA)


def test_repair_against_brute_force(spark):
    import sys

    sys.setrecursionlimit(20_000)
    rows = conversations(1, 250)
    want, got = expected(rows), result(table(spark, rows))
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    assert cr.repair(table(spark, [])).count() == 0


def test_cut_conversations(spark, monkeypatch):
    """Every block is a segment of its own, and frequent signatures are salted."""
    rows = conversations(2, 60)
    plain = cr.map_rows
    monkeypatch.setattr(cr, "map_rows", lambda df, schema, make, rows_at_once=256: plain(df, schema, make, rows_at_once=3))
    monkeypatch.setattr(cr, "HEAVY_SHARE", 100_000)
    assert result(table(spark, rows)) == expected(rows)


def test_nodes_are_made_once():
    rng = random.Random(3)
    texts = sorted({"".join(rng.choice("suadUA") for _ in range(rng.randint(0, 7))) for _ in range(4000)})
    walk = cr.Walk()
    for t in texts:
        walk.best(t)
    assert walk.made == len({t[:i] for t in texts for i in range(1, len(t) + 1)})
