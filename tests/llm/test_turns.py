import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tidebook.llm import turns as T

WHITE = r"[\x20\x09-\x0D]"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def cheapest(turns):
    """Of all edits, tried one after the other: the cost and the least audit. turns: (initial, must go, truncated)."""

    @lru_cache(None)
    def best(i, state, inserts):
        """State: what was last given, "" at the start."""
        options = [(0, "")] if i == len(turns) and state in ("", "a") else []
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if inserts < 3:
            cost, audit = best(i, after, inserts + 1)
            options.append((cost + 2, "I" + audit))
        if i < len(turns):
            initial, must_go, cut = turns[i]
            cost, audit = best(i + 1, state, 0)
            options.append((cost + 3, "D" + audit))
            if not must_go:
                cost, audit = best(i + 1, after, 0)
                options.append((cost + 2 + cut, "R" + audit))
                if initial == after or initial == "s" and state == "":
                    cost, audit = best(i + 1, initial, 0)
                    options.append((cost + cut, "K" + audit))
        return min(options, default=(10**6, ""))

    return best(0, "", 0)


def brute(rows):
    result = []
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        digest = lambda x: hashlib.md5(x.encode()).digest()
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r[3])))
        seen, faults = set(), []
        for _, _, role, text in own:
            shown = re.sub(f"{WHITE}+$", "", text)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(tuple((r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults, strict=True)))
        numbers = {r[1] for r in own} - {None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        lines, state, rest = [], "", list(own)
        for letter in audit:
            _, _, role, text = rest.pop(0) if letter != "I" else (None, None, "", "")
            if letter == "D":
                continue
            state = role[0] if letter == "K" else "a" if state == "u" else "u"
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
        result.append((conv, gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(result, key=str)


def got(rows):
    return sorted((tuple(r[c] for c in ("conv_id", *T.COUNTS, "audit", "repaired_sha256")) for r in T.repair_report(T.damaged(rows), rows).collect()), key=str)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_cheapest_edits(monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(1500):
        turns = tuple((rng.choice("suuaat"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(0, 9)))
        codes = bytes("?sua".find(r) % 5 % 4 | T.MUST_GO * go | T.CUT * (cut and not go) for r, go, cut in turns)
        turns = tuple((r, go, cut and not go) for r, go, cut in turns)
        cost, audit = T.repair(codes)
        assert (cost, audit.decode()) == cheapest(turns), turns


def test_long_conversation(monkeypatch):
    codes = bytes(random.Random(2).choice([1, 2, 3, 2, 3, 6, 10, 0]) for _ in range(50_000))
    cost, audit = T.repair(codes)
    monkeypatch.setattr(T, "BLOCK", 1 << 20)
    assert T.repair(codes) == (cost, audit)
    assert len(audit) - audit.count(b"I") == len(codes)


def test_conversations(spark, small_dir):
    rows = spark.read.parquet(f"{small_dir}/conversations.parquet")
    assert got(rows) == brute([tuple(r) for r in rows.collect()])


def test_odd_rows(spark):
    rng = random.Random(7)
    text = lambda: rng.choice([None, "", " \t", "Yes.", "No!", "cut off", "Ünï?", "same.", "same.", "x" * 70_000 + "."])
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice([None, "", "user", "assistant", "system", "tool", "u2"]), text()) for _ in range(120)]
    rows += [(99, turn, "user", "Again.") for turn in range(8)] + rows[:5] + [(-1, None, "user", "Hi.")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, copy string, digest string").repartition(4)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again, cut"), (2, 0, "assistant", "Hi."), (2, 5, "assistant", "Bye."), (3, 0, "assistant", "Be kind.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    audit = T.audits(df)
    assert {r.conv_id: (r.audit, r.cost, r.gaps, r.illegal) for r in audit.collect()} == {1: ("KR", 3, 0, 1), 2: ("RK", 2, 4, 1), 3: ("IK", 2, 0, 0)}
    out = sorted((r.conv_id, r.place, r.role, r.text, r.edit) for r in T.repaired(df, audit).collect())
    assert [x[2:] for x in out[:2]] == [("user", "Hello.", "K"), ("assistant", "Again, cut", "R")]
    assert [(x[2], x[4]) for x in out[2:]] == [("user", "R"), ("assistant", "K"), ("user", "I"), ("assistant", "K")]
