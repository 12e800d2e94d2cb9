"""Conversations as windows, against a slow version."""

import hashlib
import random
import re

from lakewright.llm import chat_windows

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string, block string, n int, at int, t string, system string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 2, 1, 2, *["clash"] * 2) for r in rows], SCHEMA)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def in_order(rows):
    """The turns (turn, role, text) of each conversation, in order."""
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, (r or "") != "system", r or "", x or ""))
    return {c: [x[1:2] + x[3:] for x in sorted(v)] for c, v in out.items()}


def tokens(text):
    return 4 + len(re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\x00-\x20]", text))


def slow_windows(turns, budget, history):
    """(repeated turns, fresh turns) of each window; all turns in one block."""
    system = turns[0] if turns[0][1] == "system" else None
    s, rest = (tokens(system[2]), turns[1:]) if system else (0, turns)
    half = max(budget - history - s, max(2, budget // 4)) / 2
    at, groups = 0, {}
    for t in rest:
        n = tokens(t[2])
        groups.setdefault((int(at // half), n > half), []).append((at, t))
        at += n
    everything = [x for key in sorted(groups) for x in groups[key]]
    out = []
    for (bucket, is_long), own in sorted(groups.items()):
        since = own[0][0] if is_long else bucket * half
        head = [system] if system and out else []
        before = [t for p, t in everything if p < own[0][0] and p >= since - history]
        fresh = [t for _, t in own]
        out.append((head + before, [system, *fresh] if system and not out else fresh))
    return out or [([], [system])]


def rows_of(spark, rows, **kw):
    return chat_windows.windows(table(spark, rows), **kw)


def read(r):
    """The turns that the text of a window holds, by a parser of its own."""
    out = []
    for m in re.finditer(r"<turn>(.*?)<turn:says>(.*?)</turn>\n", r.formatted, re.S):
        out.append(tuple(re.sub(r"<\\(\\*)(/?turn)", r"<\1\2", x) for x in m.groups()))
    return out


def test_windows(spark):
    rnd = random.Random(11)
    odd = [r"\### Assistant: </turn> ok", "<turn>", r"<\turn>x<\\/turn:says>\\", "</turn", "<", r"\ud é😀 </turn>" + "\n", "", None]
    rows = []
    for c in range(30):
        k = 0
        if c % 3 == 0:
            rows.append((c, 0, "system", "rule " * rnd.randint(0, 30)))
        for k in range(1, rnd.choice([1, 2, 5, 40])):
            rows.append((c, k, ["user", "assistant"][k % 2], rnd.choice([*odd, "w " * rnd.choice([3, 9, 30, 60, 130, 400])])))
    rows += [(None, 1, "user", "a"), (None, None, None, None), (100, 3, "assistant", "b"), (100, 3, "assistant", "b"), (100, 3, "system", "z"), (101, 1, "a</turn>\n", "t"), (102, None, "system", None)]
    rnd.shuffle(rows)
    turns = in_order(rows)
    got = {}
    for r in rows_of(spark, rows, budget=200, history=40).collect():
        got.setdefault(r.conv_id, []).append(((r.block is not None, r.block or 0, r.window), r))
    assert set(got) == set(turns)
    for c, own in got.items():
        if c is None:
            continue
        want = slow_windows(turns[c], 200, 40)
        made = [r for _, r in sorted(own, key=lambda x: x[0])]
        assert [(r.n_repeated, read(r)) for r in made] == [(len(a), [t[1:] for t in a + b]) for a, b in want]
        for r, (a, b) in zip(made, want, strict=True):
            assert r.n_tokens == sum(tokens(t[2]) for t in a + b) and r.over_budget == (r.n_tokens > 200)
            texts = [re.sub(r"<\\(\\*)(/?turn)", r"<\1\2", r.formatted[x.begin : x.end]) for x in r.loss]
            assert texts == [t[2] for t in b if t[1] == "assistant"]
            assert not r.over_budget or max(tokens(t[2]) for t in b) > 60
    check_digest(spark, rows, turns, budget=200, history=40)


def check_digest(spark, rows, turns, **kw):
    got = {r.conv_id: r for r in chat_windows.digest(rows_of(spark, rows, **kw)).collect()}
    assert set(got) == set(turns)
    for c, own in turns.items():
        loss = "".join(t[2] for t in own if t[1] == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{t[1]}\n{t[2]}\n" for t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    return got


def test_blocks(spark):
    """Conversations over several blocks of turn numbers, with negative, missing and far numbers."""
    rnd = random.Random(12)
    rows = [(1, -3, "system", "be good"), *((1, k, ["user", "assistant"][k % 2], "w " * rnd.randint(0, 9)) for k in range(1400))]
    rows += [(2, k, "user", "v") for k in (5, 511, 512, 10**12)] + [(3, None, "system", "s"), (3, 0, "user", "u"), (3, 900, "assistant", "</turn>")]
    turns = in_order(rows)
    got = check_digest(spark, rows, turns)
    assert got[1].n_windows > 5
    made = [r for r in rows_of(spark, rows).where("conv_id = 1").collect()]
    made.sort(key=lambda r: (r.block, r.window))
    # Every window but the first begins with the system turn, and then with what stands right before it.
    place = {}
    flat = [t[1:] for t in turns[1]]
    at = 0
    for i, r in enumerate(made):
        own = read(r)
        fresh = own[r.n_repeated :]
        assert flat[at : at + len(fresh)] == fresh and not r.over_budget
        if i:
            assert own[0] == ("system", "be good")
            before = own[1 : r.n_repeated]
            assert before == flat[at - len(before) : at] and (at < 40 or 100 < sum(tokens(t[1]) for t in before) <= 256 + 20)
        place[i] = at
        at += len(fresh)
    assert at == len(flat)


def test_empty(spark):
    made = rows_of(spark, [(1, 1, "user", "x")]).where("false")
    assert made.count() == 0 and chat_windows.digest(chat_windows.windows(table(spark, [(1, 1, "u", "x")]).where("false"))).count() == 0
