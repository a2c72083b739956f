"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict
from functools import cache
from zlib import crc32

import pytest

from specimen_spark.llm import conversations
from specimen_spark.llm.common import table

SF = "/root/testdata/sf0.01"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            yield from [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)


def cheapest(roles, faults):
    """The least (cost, audit), from the last row to the first."""

    @cache
    def least(i, q, inserted):
        found = [(0, "")] if i == len(roles) and q in "-a" else []
        follow = {"-": "su", "s": "u", "u": "a", "a": "u"}[q]
        if inserted < 3:
            found += [(3 + c, "I" + a) for x in "ua" if x in follow for c, a in [least(i, x, inserted + 1)]]
        if i < len(roles):
            c, a = least(i + 1, q, 0)
            found.append((4 + c, "D" + a))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if roles[i] and roles[i][0] in follow:
                    c, a = least(i + 1, roles[i][0], 0)
                    found.append((more + c, "K" + a))
                found += [(3 + more + c, "R" + a) for x in "ua" if x in follow for c, a in [least(i + 1, x, 0)]]
        return min(found, default=(10**9, ""))

    return least(0, "-", 0)


def repaired_by(audit, rows):
    out, left = [], list(rows)
    for sign in audit:
        role, text = (None, "") if sign == "I" else left.pop(0)
        if sign in "IR":
            role = "assistant" if out and out[-1][0][0] == "u" else "user"
        if sign != "D":
            out.append((role, text))
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    return "\n".join(f"{r}:{t}" for r, t in out)


def brute(original, rows):
    groups = {conv: [] for conv, *_ in original}
    for conv, *row in rows:
        groups[conv].append(row)
    out = []
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            shown = VISIBLE.findall(text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest([r for _, r, _ in own], faults) if own else (0, "")
        text = repaired_by(audit, [r[1:] for r in own])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("block", [2, 10])
def test_tables(spark, block, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK_BITS", block)
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows, list(damaged(rows)))
    assert len({x[7] for x in want}) > 20 and all(sum(x[i] for x in want) for i in (1, 2, 3, 4, 5, 6))
    assert got(conversations.op12_conversation_repair(spark, SF)) == want


def faulty(seed, n, convs):
    rng = random.Random(seed)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "sys"], ["A b.", "What?", "cut", "", " \x0b\n", "no stop", "Right! ", "one\xa0", None]
    return [(rng.choice([*range(convs), None]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice([*texts, f"t{rng.random()}."])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "block", "fan"), [(1, 1, 1), (2, 3, 2), (3, 10, 10)])
def test_any_rows_in_any_blocks(spark, seed, block, fan, monkeypatch):
    """Long and short conversations, repeated turns, odd roles, nulls everywhere; parts are put together in many rounds."""
    monkeypatch.setattr(conversations, "BLOCK_BITS", block)
    monkeypatch.setattr(conversations, "FAN_BITS", fan)
    rows = faulty(seed, 150, 25) + [(99, i, r, t) for i, (_, _, r, t) in enumerate(faulty(seed + 10, 200, 1))]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, key string, pos int").repartition(4)
    want = brute(rows, list(damaged(rows)))
    assert got(conversations.repair_report(df, conversations.damage(df))) == want
    lines = defaultdict(list)
    for r in conversations.repaired(conversations.damage(df)).collect():
        lines[r["key"]].append((r["place"], f"{r['role']}:{r['text']}"))
    assert {k: hashlib.sha256("\n".join(t for _, t in sorted(x)).encode()).hexdigest() for k, x in lines.items()} == {"" if w[0] is None else f"={w[0]}": w[8] for w in want if set(w[7]) - {"D"}}


def test_every_audit_of_short_conversations():
    """Against all audits of up to three rows and three inserted ones."""
    for n in range(4):
        for roles in itertools.product("suat", repeat=n):
            for faults in itertools.product("-bt", repeat=n):
                found = []
                for k in range(n + 4):
                    for audit in itertools.product("DIKR", repeat=k):
                        if len(audit) - audit.count("I") != n:
                            continue
                        out, i, cost = [], 0, 0
                        for sign in audit:
                            nxt = "a" if out and out[-1] == "u" else "u"
                            if sign == "I":
                                out.append(nxt)
                                cost += 3
                                continue
                            if sign != "D":
                                cost += 3 * (sign == "R") + 3 * (faults[i] == "t") + 1000 * (faults[i] == "b")
                                out.append(roles[i] if sign == "K" else nxt)
                            else:
                                cost += 4
                            i += 1
                        if re.fullmatch("(s?(ua)+)?", "".join(out)):
                            found.append((cost, "".join(audit)))
                edges = conversations.edits_of("".join(roles).replace("t", "-"), "".join(faults))
                (best,) = conversations.lightest(0, edges, n, conversations.GOALS).values()
                assert best[:2] == min(found)


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = spark.createDataFrame([], schema)
    assert conversations.repair_report(empty, conversations.damage(empty)).count() == 0
    drop = next((c, t) for c in range(100) for t in range(1) if crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*drop, "user", "Hello."), (500, None, None, None), (501, 10**17, "user", "long " * 40_000 + "."), (501, 10**17 + 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, schema)
    want = brute(rows, list(damaged(rows)))
    assert want == got(conversations.repair_report(df, conversations.damage(df)))
    assert (drop[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want
