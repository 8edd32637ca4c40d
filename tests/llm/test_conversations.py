"""Audits against an exhaustive search over edit strings, and against planted damage."""

import hashlib
import heapq
import random
import re

import pytest

from tesserae.llm.conversations import PIECE, audit_conversations, join_pieces, repair_conversations, solve
from tesserae.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn int, role string, text string, audit string, kind int, at long, ways string"


def search(signature):
    """Cheapest edits by Dijkstra over (row, roles so far), ties by the audit."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles) in seen:
            continue
        seen.add((i, roles))
        if i == len(signature) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        if i < len(signature):
            c = signature[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles))
            if c != "x":
                more = 3 if c.isupper() else 0
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + c.lower()))
                for r in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + r))
        for r in "ua":
            if len(roles) < 2 * len(signature) + 4:
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + r))
    raise AssertionError


def forward(signature):
    """The same by one pass over rows, each of which follows any edited beginning; for long signatures."""
    reached = {"": (0, "")}
    for c in signature:
        then = {}
        for state, (cost, audit) in reached.items():
            for k in range(3):
                s = state if not k else "u" if (k == 1) == (state != "u") else "a"
                after = {"": "u", "s": "u", "u": "a", "a": "u"}[s]
                ways = [(s, 4, "D")]
                if c != "x":
                    more = 3 if c.isupper() else 0
                    ways.append((after, 3 + more, "R"))
                    if s + c.lower() in ("s", "u", "su", "ua", "au"):
                        ways.append((c.lower(), more, "K"))
                for t, price, edit in ways:
                    way = (cost + 3 * k + price, audit + "I" * k + edit)
                    then[t] = min(then.get(t, way), way)
        reached = then
    close = {"": "", "s": "II", "u": "I", "a": ""}
    return min((cost + 3 * len(close[s]), audit + close[s]) for s, (cost, audit) in reached.items())


def test_pieces_give_the_cheapest_and_least_audit():
    rng = random.Random(5)
    for _ in range(400):
        s = "".join(rng.choice("suaouauaSUAOx") for _ in range(rng.randrange(9)))
        want = search(s)
        assert join_pieces([solve(s)]) == want == forward(s)
        k = rng.randrange(len(s) + 1)
        assert join_pieces([solve(s[:k]), solve(s[k:])]) == want


def brute(rows):
    """Per conversation: gaps, faults, illegal, cost, audit, digest; and the repaired rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in (y[:4] for y in rows) if c == conv))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, signs, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            r = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signs += "x" if fault in ("blank", "duplicate") else r.upper() if fault else r
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit = search(signs) if len(signs) < 10 else forward(signs)
        done, i = [], 0
        for e in audit:
            following = {"": "user", "s": "user", "u": "assistant", "a": "user"}[done[-1][0][:1] if done else ""]
            if e == "I":
                done.append((following, "", e))
                continue
            if e != "D":
                done.append((following if e == "R" else own[i][2], own[i][3], e))
            i += 1
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in done).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, digest), done
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 5, 8])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No", "Why?\n", " \t", "", None, f"Text {rng.randrange(9)}!", "Ünï…", "x" * 5000 + "."])
            rows += [(conv, rng.choice([turn, turn, turn * 2, None]), role, text, "a", 1, 2, "w")] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_audits_equal_search(spark, seed):
    rows = conversations(seed)
    want = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.conv_id: tuple(r)[1:] for r in audit_conversations(docs).collect()} == {c: w for c, (w, _) in want.items()}
    got = {}
    for r in sorted(repair_conversations(docs).collect(), key=lambda r: r.nth):
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.edit))
    assert got == {c: done for c, (_, done) in want.items() if done}


def test_a_long_conversation_is_cut_into_pieces(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"Text {rng.randrange(4000)}" + rng.choice([".", ""]), "", 0, 0, "") for t in range(9 * PIECE)]
    want = brute(rows)[7]
    r = audit_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert tuple(r)[1:] == want[0]


def test_empty_table(spark):
    assert audit_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_keeps_conversations_whose_rows_all_go(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(300) for t in range(1)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op11_conversation_repair(spark, str(tmp_path)).collect()
    empty = [r for r in got if r.audit == ""]
    assert len(got) == 300 and empty and all(tuple(r)[1:7] == (0,) * 6 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in empty)
