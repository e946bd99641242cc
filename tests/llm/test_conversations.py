"""Conversation repair against a plain search, with nulls, ties, repeats, long conversations over many blocks and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from trajstats.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, block int, position int"
NAMES = {"u": "user", "a": "assistant"}
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def faults(rows):
    """(role, text, fault) in order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
    out, seen = [], set()
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """(cost, audit, lines) by steps over the rows; a state is the last initial."""
    def inserted(heads):
        for _ in range(3):
            for s, (cost, audit, lines) in list(heads.items()):
                for c in "ua":
                    if (s, c) in NEXT:
                        new = (cost + 2, audit + "I", (*lines, f"{NAMES[c]}:"))
                        heads[NEXT[s, c]] = min(heads.get(NEXT[s, c], new), new)
        return heads

    heads = inserted({"": (0, "", ())})
    for role, text, fault in rows:
        out = {}
        for s, (cost, audit, lines) in heads.items():
            choices = [(s, (cost + 3, audit + "D", lines))]
            if fault in ("", "truncated"):
                more = cost + (fault == "truncated")
                choices += [(NEXT[s, role[:1]], (more, audit + "K", (*lines, f"{role}:{text}")))] if (s, role[:1]) in NEXT else []
                choices += [(NEXT[s, c], (more + 2, audit + "R", (*lines, f"{NAMES[c]}:{text}"))) for c in "ua" if (s, c) in NEXT]
            for to, new in choices:
                out[to] = min(out.get(to, new), new)
        heads = inserted(out)
    return min(h for s, h in heads.items() if s in ("", "a"))


def exhaustive(rows):
    """The same by trying all edits, up to two inserts in each gap."""
    best = None
    options = [[(x, c) for x, c in (("D", ""), ("K", r[:1]), ("R", "u"), ("R", "a")) if x == "D" or (c and f in ("", "truncated"))] for r, _, f in rows]
    fill = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    for chosen in itertools.product(*options):
        for gaps in itertools.product(fill, repeat=len(rows) + 1):
            cost, audit, initials = 0, "", ""
            for (row, (x, c)), gap in zip(zip([*rows, None], [*chosen, ("", "")]), gaps):
                cost, audit, initials = cost + 2 * len(gap), audit + "I" * len(gap), initials + "".join(gap)
                if x:
                    cost += {"D": 3, "K": 0, "R": 2}[x] + (x != "D" and row[2] == "truncated")
                    audit, initials = audit + x, initials + c
            if re.fullmatch("(s?(ua)+)?", initials):
                best = min(best or (cost, audit), (cost, audit))
    return best


def table(spark, convs):
    rows = [(c, t, r, x, "k", 1, 2) for c, v in convs.items() for t, r, x in v]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


SMALL = {
    1: [(0, "system", "Be kind."), (1, "user", "Hi."), (2, "assistant", "Yes")],
    2: [(0, "assistant", "One."), (1, "assistant", "Two."), (2, "user", "")],
    3: [(None, None, None), (3, "user", "a."), (7, "user", "a.")],
    4: [(0, "tool", "x."), (0, "tool", "x."), (0, "user", "b\n")],
    None: [(None, "", "x."), (None, "user", "ß!"), (2, "assistant", "ok?\x0b ")],
    6: [(5, "user", "Only.")],
    7: [(1, "system", "s."), (2, "system", "t."), (3, "assistant", "u.")],
}


def long_conversation(n, seed):
    draws = random.Random(seed)
    return [(draws.choice([i, i, i, None]), draws.choice(["user", "assistant", "assistant", "user", "system", "tool"]), draws.choice(["a.", f"{i}.", f"{i}", f"{i}!", " ", f"q{i}? "])) for i in range(n)]


@pytest.mark.parametrize("block", [2, 64])
def test_repair(spark, block):
    convs = SMALL | {100 + i: long_conversation(n, i) for i, n in enumerate((5, 40, 150, 300))}
    report, rows = conversations.repair(table(spark, convs), block=block)
    got = {r.conv: r for r in report.collect()}
    lines, edits = defaultdict(list), Counter()
    for r in rows.collect():
        edits[r.conv, r.edit] += 1
        if r.position is not None:
            lines[r.conv].append((r.position, f"{r.role}:{r.text}"))
    hashed = {r.conv: r.sha256 for r in conversations.digests(rows).collect()}
    assert set(got) == set(convs)
    for c, given in convs.items():
        marked = faults(given)
        cost, audit, want = cheapest(marked)
        if len(marked) < 4:
            assert exhaustive(marked) == (cost, audit)
        assert (got[c].cost, got[c].audit) == (cost, audit)
        assert sorted(lines[c]) == list(enumerate(want))
        assert hashed.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(want).encode()).hexdigest()
        assert {x: edits[c, x] for x in "KRDI"} == {x: audit.count(x) for x in "KRDI"}
        initials = [r[:1] for r, _, _ in marked]
        turns = [t for t, _, _ in given if t is not None]
        assert got[c].illegal == sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        assert got[c].gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert [got[c][f] for f in ("blank", "duplicate", "truncated")] == [sum(f == x for _, _, x in marked) for f in ("blank", "duplicate", "truncated")]


def test_damage_and_empty(spark):
    convs = SMALL | {200 + i: long_conversation(9, i) for i in range(30)}
    want = Counter()
    for c, rows in convs.items():
        for t, r, x in rows:
            show = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
            if kind:
                row = (c, t, "user" if kind == 4 else show(r), "" if kind == 1 else re.sub("[.!?]", "", show(x)) if kind == 2 else show(x))
                want[row] += 2 if kind == 3 else 1
    assert Counter(tuple(r) for r in conversations.damaged(table(spark, convs)).collect()) == want
    report, rows = conversations.repair(table(spark, SMALL).limit(0))
    assert report.count() == 0 and rows.count() == 0 and conversations.digests(rows).count() == 0


def test_query_keeps_conversations_without_rows(spark, tmp_path):
    gone = next(i for i in itertools.count() if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "a."), (None, 1, "user", "b.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and got[None].audit == "KI"


def test_grammar():
    seen = {""}
    for word in map("".join, itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(7))):
        stack = conversations.STACKS[0]
        for c in word:
            stack = stack and conversations.advance(stack, c)
        if stack and stack[0] in conversations.ACCEPT:
            seen.add(word)
    assert seen == {w for n in range(7) for w in map("".join, itertools.product("sua", repeat=n)) if re.fullmatch("(s?(ua)+)?", w)}
