import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from gridmine.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, pos long, digest string, code string"
FORM = re.compile(r"(s?(ua)+)?\Z")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cheapest_edits(rows):
    """(cost, edits, repaired) by a search over prefixes of the rows and of the form; rows are (role, text, must_go, truncated)."""
    best = {"": (0, "", [])}  # by what the initials so far ask for next

    def state(initials):
        return "" if not initials else initials if initials == "s" else "u" if initials[-1] == "u" else "a"

    def insert(now):
        for _ in range(3):
            for s, (c, e, done) in list(now.items()):
                role = "assistant" if s == "u" else "user"
                key = state((s or "") + role[0])
                new = (c + 2, e + "I", [*done, (role, "")])
                if key not in now or new[:2] < now[key][:2]:
                    now[key] = new
        return now

    best = insert(best)
    for role, text, must_go, truncated in rows:
        after = {}

        def offer(key, new):
            if key not in after or new[:2] < after[key][:2]:
                after[key] = new

        for s, (c, e, done) in best.items():
            offer(s, (c + 3, e + "D", done))
            if must_go:
                continue
            want = "assistant" if s == "u" else "user"
            offer(state(s + want[0]), (c + 2 + truncated, e + "R", [*done, (want, text)]))
            if role[:1] == want[0] or (s == "" and role[:1] == "s"):
                offer(state(s + role[0]), (c + truncated, e + "K", [*done, (role, text)]))
        best = insert(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        w = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not w else "duplicate" if (role, text) in seen else "truncated" if w[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def audit(conv, rows):
    """rows are (turn, role, text) of one conversation, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    plain = [(r, t) for _, r, t in rows]
    faults = faults_of(plain)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    cost, edits, repaired = cheapest_edits([(r, t, f in ("blank", "duplicate"), f == "truncated") for (r, t), f in zip(plain, faults)])
    assert FORM.match("".join(r[0] for r, _ in repaired))
    return (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, sha("\n".join(f"{r}:{t}" for r, t in repaired)))


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def by_conversation(rows, ids=()):
    out = {c: [] for c in ids}
    for conv, *row in rows:
        out.setdefault(conv, []).append(tuple(row))
    return sorted((audit(c, r) for c, r in out.items()), key=str)


def chats(seed, n, length):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "User", ""]
    texts = ["Yes.", "No!", "why?", "well", " ", "", None, "a b", "Fine. \n", "é…", "end.\t"]
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(draw.randint(1, length)):
            turn += draw.choice([0, 1, 1, 1, 1, 2])
            text = draw.choice(texts) if draw.random() < 0.5 else f"says {draw.random()}."
            rows.append((None if conv == 3 else conv * 7, None if draw.random() < 0.03 else turn, draw.choice(roles), text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("span", [512, 3])
def test_against_a_search(spark, monkeypatch, span):
    monkeypatch.setattr(R, "SPAN", span)
    rows = chats(1, 120, 14)
    got = sorted((tuple(r) for r in R.repair_digest(frame(spark, rows)).collect()), key=str)
    assert got == by_conversation(damage(rows), {r[0] for r in rows})


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(R, "SPAN", 16)
    rows = [(1, k, r, t) for k, (_, _, r, t) in enumerate(chats(2, 80, 14))] + chats(3, 5, 6)
    got = sorted((tuple(r) for r in R.repair_digest(frame(spark, rows)).collect()), key=str)
    assert got == by_conversation(damage(rows), {r[0] for r in rows})


def test_empty_and_lost_conversations(spark):
    assert R.repair_digest(frame(spark, [])).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    got = [tuple(r) for r in R.repair_digest(frame(spark, [(5, gone, "user", "Hi.")])).collect()]
    assert got == [(5, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_repaired_turns(spark):
    rows = [(1, 1, "system", "Be kind."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Hi?"), (1, 3, "user", "Hi?"), (1, 4, "assistant", "cut"), (2, 1, "tool", "x.")]
    got = sorted(tuple(r) for r in R.repaired_turns(frame(spark, rows)).collect())
    assert got == [
        (1, 0, "K", "system", "Be kind."),
        (1, 1, "I", "user", ""),
        (1, 2, "K", "assistant", "Hello."),
        (1, 3, "K", "user", "Hi?"),
        (1, 4, "K", "assistant", "cut"),
    ]  # to drop the only row of conversation 2 is cheaper than to rerole it and add an answer


def test_one_split_gives_what_all_splits_give():
    """Full CYK over every span and split, and every edit string of short conversations."""
    draw = random.Random(8)
    for _ in range(60):
        codes = "".join(draw.choice("suaSUA.X-") for _ in range(draw.randint(1, 12)))
        n = len(codes)
        table = {(i, i + 1): R.row_cell(c) for i, c in enumerate(codes)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                table[i, i + size] = R._least(pair for k in range(i + 1, i + size) for pair in R.combine(table[i, k], table[k, i + size]).items())
        assert R.parse(codes, {}) == table[0, n]
    for codes in ("sa", "us", "a-u", "UU", "sXa", ".", "-", "au"):
        best = None
        for length in range(len(codes) + 4):
            for edits in map("".join, product("DIKR", repeat=length)):
                if len(edits.replace("I", "")) != len(codes):
                    continue
                rows = iter([("t" if c in ".X" else c.lower(), c) for c in codes])
                faulty = [c for c, e in zip(codes, edits.replace("I", "")) if c == "-" and e != "D"]
                cost = 2 * edits.count("I") + 3 * edits.count("D") + 2 * edits.count("R") + sum(c.isupper() and e != "D" for c, e in zip(codes, edits.replace("I", "")))
                try:
                    initials = "".join(role[0] for _, role, _ in R.apply_edits(edits, rows))
                except (KeyError, StopIteration, RuntimeError):
                    continue
                if not faulty and FORM.match(initials) and (best is None or (cost, edits) < best):
                    best = (cost, edits)
        assert R.cheapest(R.parse(codes, {})) == best
