import functools
import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import defaultdict

import pytest

from stationspark.llm import repair

sys.setrecursionlimit(20_000)
STEP = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}


def plain_parse(kinds):
    """Rows from the last to the first by recursion: the state is the last role."""

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(kinds) and state in ("", "a") else []
        if inserted < 3:
            for role in "ua":
                if state in STEP[role]:
                    c, a = best(i, STEP[role][state], inserted + 1)
                    found.append((c + 5, "I" + a))
        if i < len(kinds):
            c, a = best(i + 1, state, 0)
            found.append((c + 2, "D" + a))
            k, more = kinds[i].lower(), 5 * kinds[i].isupper()
            if k != "x":
                for role in "ua":
                    if state in STEP[role]:
                        c, a = best(i + 1, STEP[role][state], 0)
                        found.append((c + 1 + more, "R" + a))
                if k != "o" and state in STEP[k]:
                    c, a = best(i + 1, STEP[k][state], 0)
                    found.append((c + more, "K" + a))
        return min(found, default=(10**6, ""))

    return best(0, "", 0)


def test_every_short_conversation():
    for n in range(5):
        for kinds in map("".join, itertools.product("suaoxSUA", repeat=n)):
            assert repair.parse(kinds) == plain_parse(kinds), kinds


@pytest.mark.parametrize("chart", [12, 3])
def test_long_conversations(monkeypatch, chart):
    monkeypatch.setattr(repair, "CHART", chart)
    repair.parse.cache_clear()
    rng = random.Random(chart)
    for n in [*range(5, 16), 40, 41, 150, 300]:
        for letters in ("ua", "suaoxSUAO", "uuuua", "UA"):
            kinds = "".join(rng.choice(letters) for _ in range(n))
            assert repair.parse(kinds) == plain_parse(kinds), kinds
    repair.parse.cache_clear()


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        code, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        by[conv] += []
        if code:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
            by[conv] += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, kinds, faults = [r[0] for r in held if r[0] is not None], set(), "", []
        for _, role, text in held:
            shown = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not shown else "d" if (role, text) in seen else "" if shown[-1] in ".!?" else "t")
            seen.add((role, text))
            k = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if faults[-1] in ("b", "d") else k.upper() if faults[-1] else k
        cost, audit = plain_parse(kinds)
        lines, at, last = [], 0, ""
        for e in audit:
            want = "assistant" if last == "u" else "user"
            if e in "KRI":
                role = held[at][1] if e == "K" else want
                lines.append(f"{role}:{'' if e == 'I' else held[at][2]}")
                last = role[0]
            at += e != "I"
        first = [r[1][:1] for r in held]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(x + y not in ("su", "ua", "au") for x, y in zip(first, first[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def test_equals_plain_version(spark, small):
    own = [(None, 1, "user", "a."), (None, None, None, None), (None, 2, "user", "b"), (None, 2, "user", "b"), (-1, None, "system", "s."), (-1, None, "user", "x!"), (-1, 5, "assistant", "y?\x0b "), (-1, 9, "tool", " "), (-1, 9, "", "."), (-1, 10, "assistant", "z.\n"), (-2, 0, "user", ""), (-3, None, "user", "only.")]
    rng = random.Random(1)
    own += [(k, t, rng.choice(["user", "assistant", "system", "other"]), rng.choice(["one.", "two?", "three", " ", "four! "])) for k in range(-60, -10) for t in range(rng.randint(1, 9))]
    own += [(-9, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(350)] + [(-8, 0, "user", "long " * 200_000)]
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()] + own
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, there long, rows string").repartition(4)
    got = repair.repair_digests(repair.damaged(df))
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)
    assert repair.repair_digests(repair.damaged(df.limit(0))).count() == 0


def test_repair_of_given_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "No."), (3, 0, "user", "Cut of"), (3, 1, "assistant", "Ok.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.cost, r.audit, r.repaired) for r in repair.repair(df).collect()}
    assert got[1] == (2, "DKK", "user:There.\nassistant:Yes.")
    assert got[2] == (2, "D", "")
    assert got[3] == (4, "DD", "")
