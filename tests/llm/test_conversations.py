import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from ledgerline.llm import conversations
from ledgerline.llm.queries import QUERIES
from tests.llm.util import write_tables

SPACE = " \t\n\v\f\r"
ROLE = {2: "user", 3: "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "good")
        seen.add((role, text))
    return out


def price(audit, rows, kinds):
    """Cost and repaired lines of an audit tried on the rows, None if it doesn't fit."""
    at, cost, lines, initials = 0, 0, [], ""
    for letter in audit:
        due = "assistant" if initials.endswith("u") else "user"
        if letter == "I":
            cost += 5
            lines.append(f"{due}:")
            initials += due[0]
            continue
        if at == len(rows):
            return None
        _, role, text = rows[at]
        kind, at = kinds[at], at + 1
        if letter == "D":
            cost += 2
            continue
        if kind in ("blank", "duplicate"):
            return None
        cost += (letter == "R") + 5 * (kind == "truncated")
        lines.append(f"{role if letter == 'K' else due}:{text}")
        if letter == "K" and not role:
            return None
        initials += role[0] if letter == "K" else due[0]
    if at < len(rows) or not re.fullmatch("(s?(ua)+)?", initials):
        return None
    return cost, lines


def brute(rows):
    """Cheapest and then least audit by trying all of them."""
    kinds, best = faults(rows), None
    for inserts in range(3):
        for n in [len(rows) + inserts]:
            for audit in itertools.product("DIKR", repeat=n):
                if audit.count("I") == inserts and (found := price(audit, rows, kinds)):
                    best = min(best or (10**9, ""), (found[0], "".join(audit)))
    return best


def test_all_audits_of_short_conversations():
    rnd = random.Random(1)
    for _ in range(120):
        rows = [(k, rnd.choice(["user", "assistant", "system", "tool", "s", ""]), rnd.choice(["a.", "b", "", "c!", "d. \n"])) for k in range(rnd.randint(0, 4))]
        marks = [(r[:1], f) for (_, r, _), f in zip(rows, faults(rows))]
        want = brute(rows)
        assert conversations.lightest_to(marks, conversations.ACCEPT, (conversations.START,))[conversations.START] == want
        for cut in range(1, len(rows)):  # the same from two segments
            ways = conversations.combined(conversations.segment_table(marks[:cut], True, False), conversations.segment_table(marks[cut:], False, True))
            assert [(w["cost"], w["audit"]) for w in ways] == [want]


def table(seed=2, n=60):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.choice([1, 2, 3, 5, 8, 30])):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.2 else "system" if not t and rnd.random() < 0.5 else ["user", "assistant"][t % 2]
            rows.append((c, t * rnd.choice([1, 1, 1, 2]) or None, role, rnd.choice(["one.", "two?", "three", " \t", "", "four! ", "five 5", "è."]) if rnd.random() < 0.7 else f"text {rnd.random()}."))
    rows += [(900, 0, "user", None), (900, None, None, "x."), (901, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (902, 1, "tool", "z " * 50000 + "."), (903, 1, "", "no role.")]
    rows += [(904, 1, "user", "again.")] * 40 + [(904, 2, "assistant", "yes.")]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_summary_and_rows(spark, tmp_path, monkeypatch, small):
    if small:
        monkeypatch.setattr(conversations, "SEGMENT", 3)
        monkeypatch.setattr(conversations, "FAN", 2)
    rows = table()
    folder = write_tables(spark, tmp_path, conversations=([(*r, 1, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, seg int, audit string"))
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    held = defaultdict(list)
    for c, t, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        held[c]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held[c] += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert set(got) == set(held)
    for c, own in held.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        kinds, turns = faults(own), [t for t, _, _ in own if t is not None]
        cost, audit = got[c][5:7]
        found = price(audit, own, kinds)
        assert found and found[0] == cost
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        assert got[c][:5] == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], pairs)
        assert got[c][7] == hashlib.sha256("\n".join(found[1]).encode()).hexdigest()
        if len(own) <= 5:
            assert (cost, audit) == brute(own)
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    fixed = defaultdict(list)
    for r in conversations.repair(turns).collect():
        fixed[r.conv_id].append((r.place, r.role, r.text, r.edit))
    for c, lines in fixed.items():
        lines.sort()
        assert [p for p, *_ in lines] == list(range(len(lines)))
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, role, _, _ in lines))
    assert {t for lines in fixed.values() for _, _, t, e in lines if e != "I"} <= {" " if t is None else t for _, _, _, t in rows}
    assert conversations.repair(turns.limit(0)).count() == 0 and conversations.summary(turns.limit(0)).count() == 0
