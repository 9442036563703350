"""Conversation repair against a plain dynamic program over whole strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    sp = lambda x: " " if x is None else str(x)
    for c, t, r, x in rows:
        k = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        r, x = sp(r), sp(x)
        if k == 0:
            continue
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def ordered(rows):
    sp = lambda x: " " if x is None else x
    rows = [(t, sp(r), sp(x)) for _, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def cheapest(roles, marks):
    """Least (cost, audit) over all edits, with the initials and the rows that result."""
    steps = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow what; s only as a kept row
    state = {"": (0, "", ())}

    def inserted(state):
        for _ in range(3):
            for p, (c, a, o) in list(state.items()):
                for to in steps[p].replace("s", ""):
                    way = (c + 5, a + "I", (*o, to))
                    state[to] = min(state.get(to, way), way, key=lambda w: w[:2])
        return state

    for i, (role, mark) in enumerate(zip(roles, marks)):
        new = {}
        for p, (c, a, o) in inserted(state).items():
            ways = [(p, (c + 2, a + "D", o))]
            if mark not in "bd":
                extra = 5 * (mark == "t")
                for to in steps[p]:
                    if to == role:
                        ways.append((to, (c + extra, a + "K", (*o, (i, None)))))
                    elif to != "s":
                        ways.append((to, (c + extra + 1, a + "R", (*o, (i, to)))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way, key=lambda w: w[:2])
        state = new
    return min((w for p, w in inserted(state).items() if p in ("", "a")), key=lambda w: w[:2])


def brute(rows, ids):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = {}
    for c in set(ids):
        turns = ordered(by[c])
        t = [x[0] for x in turns if x[0] is not None]
        seen, marks = set(), ""
        for _, r, x in turns:
            body = x.strip(" \t\n\x0b\x0c\r")
            marks += "b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else "-"
            seen.add((r, x))
        roles = "".join(r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in turns)
        cost, audit, new = cheapest(roles, marks)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[n]}:" if isinstance(n, str) else f"{names.get(n[1]) or turns[n[0]][1]}:{turns[n[0]][2]}" for n in new]
        illegal = sum(roles[i:i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))
        out[c] = (c, max(t) - min(t) + 1 - len(set(t)) if t else 0, marks.count("b"), marks.count("d"), marks.count("t"), illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r) for r in rows}


def test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.collect()]
    assert got(repair.digest(repair.damaged(df), df.select("conv_id"))) == brute(damage(rows), [r[0] for r in rows])


def made_up(seed, n, longest=12):
    """Conversations with many faults, odd roles, null fields, equal turns and repeated rows."""
    rng, rows = random.Random(seed), []
    texts = ["ok.", "yes!", "no", "", " \n", None, "a b?", "tail ", "x. ", "Σ \U0001f600", "why"]
    for c in [None, *range(n)]:
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "usr"])
            rows += [(c, rng.choice([t, t, t, t + 1, None]), role, rng.choice(texts) if rng.random() < 0.6 else f"row {t}.")] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("per_round", [1, 64])
def test_faults(spark, per_round):
    rows = made_up(1, 120)
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA + ", conv string, symbols string, seq int").repartition(4)
    have = got(repair.digest(df, df.select("conv_id"), per_round=per_round, rounds=4))
    assert have == brute(rows, [r[0] for r in rows])
    assert len({a for *_, a, _ in have.values()}) > 50


def test_damage(spark):
    rows = made_up(2, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(str, map(tuple, repair.damaged(df).collect()))) == sorted(map(str, damage(rows)))


def test_one_long_conversation(spark, monkeypatch):
    """A conversation over many tasks and runs: its runs' matrices compose."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["same.", f"t {t}.", f"t {t}", ""])) for t in range(3000)] + made_up(6, 5)[5:]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    monkeypatch.setattr(repair, "RUN_BITS", 5)
    made = repair.plan(df)
    assert made.runs.where("conv = 1").count() > 90
    want = brute(rows, [r[0] for r in rows])
    assert got(repair.digest(df, df.select("conv_id"))) == want
    lines = [f"{r.role}:{r.text}" for r in repair.repaired(made).where("conv = 1").orderBy("place").collect()]
    assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[1][-1]
    # the other rows keep their turns, inserted ones have none
    assert repair.repaired(made).where("turn is null and text <> '' and conv = 1").count() == 0


def test_empty_and_dropped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.")], SCHEMA)
    none = repair.digest(df.where("false"), df.select("conv_id")).collect()
    assert [tuple(r) for r in none] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.digest(df.where("false"), df.where("false").select("conv_id")).count() == 0


def test_grammar():
    """Matrices of rules are the products of their terminals', ranks those of the strings."""
    rng = np.random.default_rng(0)
    g = repair.Grammar()
    for _ in range(40):
        g.add(*(int(x) for x in rng.integers(0, len(g.cost), 2)))

    def expand(s):
        return [s] if s < repair.TERMINALS else [x for h in g.rules[s - repair.TERMINALS] for x in expand(h)]

    for s in range(repair.TERMINALS, len(g.cost)):
        flat = expand(s)
        if len(flat) > 60:
            continue
        cost, rank, mids = g.matrix(np.array(flat))
        assert (cost == g.cost[s]).all()
        strings = {}
        for p in range(4):
            for q in range(4):
                if cost[p, q] < repair._NEVER:
                    put = g.edits(np.array([s]), [], p, q)
                    assert put == g.edits(np.array(flat), mids, p, q)
                    strings[p, q] = "".join("I" * len(i) + x for i, x, _ in put)
        order = sorted(set(strings.values()))
        assert all(g.rank[s][k] == order.index(x) for k, x in strings.items())


def test_parse():
    g = repair.Grammar()
    g.add(1, 1)
    g.add(repair.TERMINALS, 2)
    assert g.parse(np.array([-1, 1, 1, 1, 2, -1, 1, 1, 2, 1])).tolist() == [-1, 9, 1, 2, -1, 10, 1]
