"""Pairing: golden cases, random inputs against a sequential model, slicing, partition independence."""
import dataclasses
import datetime as dt
import random

import pytest

from ledgerline.operators import matching
from ledgerline.operators.matching import pair_rows, with_job
from ledgerline.plans.reconcile import reconcile
from ledgerline.schema import TXN, as_txn
from ledgerline.settings import Settings

DAY = dt.date(2026, 8, 1)
CFG = Settings(tolerance_deposit=120, tolerance_withdraw=120)


def rows(spark, items, side):
    out = []
    for i, o in enumerate(items):
        out.append({"job_date": DAY, "job_company": o.get("job", "C"), "row_no": i + 1, "date": DAY, "sec": o["sec"],
                    "amount": float(o.get("amount", 100)), "direction": o.get("dir", "deposit"), "account": o.get("account", "A"),
                    "company": o.get("company", "C"), "subco": o.get("subco"), "bank": "SCB", "username": "u", "ref": "r",
                    "descr": o.get("descr", ""), "raw": "raw", "cross_day": o.get("cross_day", False),
                    "late_night": o.get("late_night", False), "no_time": o.get("no_time", False),
                    "minute_precision": o.get("coarse", False), "cust_bank": o.get("cust_bank"), "cust_account": o.get("cust_account")})
    ddl = ("job_date date, job_company string, row_no int, date date, sec int, amount double, direction string, account string, "
           "company string, subco string, bank string, username string, ref string, descr string, raw string, cross_day boolean, "
           "late_night boolean, no_time boolean, minute_precision boolean, cust_bank string, cust_account string")
    names = [p.strip().split()[0] for p in ddl.split(",")]
    return as_txn(spark.createDataFrame([tuple(r[n] for n in names) for r in out], ddl), side)


GOLDEN = [
    ("exact", [dict(sec=3600)], [dict(sec=3630)], 1, []),
    ("time_diff", [dict(sec=3600)], [dict(sec=3800)], 0, ["time_diff"]),
    ("amount_diff", [dict(sec=3600)], [dict(sec=3610, amount=105)], 0, ["amount_diff"]),
    ("missing_bo", [dict(sec=100, amount=50)], [], 0, ["missing_bo"]),
    ("missing_stm", [dict(sec=1000)], [dict(sec=1000), dict(sec=2000, amount=200)], 1, ["missing_stm"]),
    ("direction", [dict(sec=3600)], [dict(sec=3610, dir="withdraw")], 0, ["missing_bo", "missing_stm"]),
    ("withdraw", [dict(sec=3600, dir="withdraw")], [dict(sec=3630, dir="withdraw")], 1, []),
    ("greedy", [dict(sec=3400), dict(sec=3650)], [dict(sec=3600)], 1, ["missing_bo"]),
    ("far_apart", [dict(sec=32400)], [dict(sec=32400), dict(sec=54000)], 1, ["missing_stm"]),
    ("duplicate", [dict(sec=1000)], [dict(sec=1000), dict(sec=1030)], 1, ["duplicate"]),
    ("no_time", [dict(sec=0, no_time=True)], [dict(sec=50000)], 1, []),
    ("no_time_control", [dict(sec=0)], [dict(sec=50000)], 0, ["missing_bo", "missing_stm"]),
    ("no_time_pairs", [dict(sec=0, no_time=True, amount=50)] * 2, [dict(sec=10, amount=50), dict(sec=70000, amount=50)], 2, []),
    ("order", [dict(sec=100), dict(sec=110)], [dict(sec=108), dict(sec=200)], 2, []),
    ("wrong_bank", [dict(sec=1, descr="จาก GSB X3463 นาย")], [dict(sec=1, cust_bank="KBANK", cust_account="0001113463")], 1, ["wrong_bank"]),
    ("wrong_tail", [dict(sec=1, descr="จาก KPLUS x3463")], [dict(sec=1, cust_bank="KBANK", cust_account="000-111-9999")], 1, ["wrong_account"]),
]


@pytest.fixture(scope="module")
def golden(spark):
    """All cases as jobs of one run: one plan, many jobs."""
    stm = [dict(o, job=name) for name, a, _, _, _ in GOLDEN for o in a]
    bo = [dict(o, job=name) for name, _, b, _, _ in GOLDEN for o in b]
    run = reconcile(rows(spark, stm, "stm"), rows(spark, bo, "bo"), cfg=CFG)
    return ([r.job_company for r in run.matched().collect()],
            [(r.job_company, r.type, r.amount_diff) for r in run.exceptions.collect()])


@pytest.mark.parametrize("case", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden(golden, case):
    name, _, _, matched, types = case
    assert golden[0].count(name) == matched
    assert sorted(t for j, t, _ in golden[1] if j == name) == sorted(types)
    if name == "amount_diff":
        assert [d for j, _, d in golden[1] if j == name] == [5]


def test_sub_company_and_age(spark):
    stm = rows(spark, [dict(sec=3600, company="BANK", subco="SUB", amount=50)], "stm")
    none = spark.createDataFrame([], TXN)
    row = reconcile(stm, none, cfg=CFG).exceptions.collect()[0]
    assert (row.company, row.age_hours, row.id, row.severity, row.sla_hours) == ("SUB", 24, "EX-3001", "high", 8)
    later = dataclasses.replace(CFG, as_of="2026-08-01 05:00:00")
    assert reconcile(stm, none, cfg=later).exceptions.collect()[0].age_hours == 4


# ------------------------------------------------------------------ sequential model
def limit(s, b, cfg):
    if s["no_time"] or b["no_time"]:
        return 86400
    base = cfg.tolerance_withdraw if s["dir"] == "withdraw" else cfg.tolerance_deposit
    return max(base, cfg.minute_tolerance) if s["coarse"] or b["coarse"] else base


def model(stm, bo, cfg, by_time):
    order = sorted(range(len(bo)), key=lambda i: (bo[i]["sec"], i)) if by_time else range(len(bo))
    used, out = set(), []

    def best(s, same_amount):
        found = None
        for i in order:
            b = bo[i]
            if i in used or b["job"] != s["job"] or b["account"] != s["account"]:
                continue
            if same_amount and b["amount"] != s["amount"]:
                continue
            if s["dir"] and b["dir"] and s["dir"] != b["dir"]:
                continue
            yield_dt = abs(b["sec"] - s["sec"])
            if same_amount == "exact" and yield_dt > limit(s, b, cfg):
                continue
            if found is None or yield_dt < found[0]:
                found = (yield_dt, i)
        return found

    rest = list(range(len(stm)))
    for name, rule, accept in (("exact", "exact", lambda s, f: True), ("late", "any", lambda s, f: f[0] < 3600),
                               ("amount", None, lambda s, f: f[0] <= limit(s, bo[f[1]], cfg))):
        left = []
        for j in rest:
            f = best(stm[j], rule)
            if f and accept(stm[j], f):
                used.add(f[1])
                out.append((name, j + 1, f[1] + 1, f[0]))
            else:
                left.append(j)
        rest = left
    return sorted(out)


def world(seed, n, untimed):
    rnd = random.Random(seed)
    make = lambda: dict(sec=rnd.randrange(0, 9000), amount=rnd.choice([10, 20]), account=rnd.choice(["A", "B"]),
                        dir=rnd.choice(["deposit", "withdraw", None]), coarse=rnd.random() < .2, job=rnd.choice(["J", "K"]),
                        no_time=untimed and rnd.random() < .1)
    return [make() for _ in range(n)], [make() for _ in range(n)]


@pytest.mark.parametrize("seed,untimed,by_time,cap", [(1, True, False, 10**6), (2, False, True, 10**6), (3, False, False, 20), (4, True, True, 15), (5, False, False, 1)])
def test_against_sequential_model(spark, seed, untimed, by_time, cap):
    stm, bo = world(seed, 220, untimed)
    cfg = Settings(unit_rows=cap)
    got = with_job(pair_rows(rows(spark, stm, "stm").repartition(7), rows(spark, bo, "bo").repartition(3), cfg, by_time)).collect()
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == model(stm, bo, cfg, by_time)


def test_conservation(spark):
    stm, bo = world(9, 300, True)
    run = reconcile(rows(spark, stm, "stm"), rows(spark, bo, "bo"), cfg=CFG)
    s = run.summary().collect()
    assert sum(r.stm_count for r in s) == 300 and sum(r.bo_count for r in s) == 300
    pairs = run.pairs.count()
    assert run.pairs.select("job_company", "bo_seq").distinct().count() == pairs
    left = run.bo_left.count()
    assert left + pairs == 300


def mixed(seed, bank_untimed, office_untimed, n=150):
    """One account: rows without time stand at midnight, as statements give them."""
    rnd = random.Random(seed)
    both = rnd.random() < 0.5

    def make(untimed):
        late = rnd.random() < untimed
        return dict(sec=0 if late else rnd.choice([0, 60, 300, 30000]) + rnd.randrange(0, 1500), amount=rnd.choice([10, 20]), account="A", job="J", no_time=late,
                    dir=rnd.choice(["deposit", "withdraw", None] if both else ["deposit", "withdraw"]), coarse=rnd.random() < .2)

    return [make(bank_untimed) for _ in range(n)], [make(office_untimed) for _ in range(n + 20)]


@pytest.mark.parametrize("seed,bank,office", [(1, 0.3, 0), (2, 0.02, 0), (3, 0.9, 0), (4, 0, 0.1), (5, 0.3, 0.1)])
def test_untimed_rows_walk_along_units(spark, seed, bank, office):
    stm, bo = mixed(seed, bank, office)
    got = with_job(pair_rows(rows(spark, stm, "stm").repartition(5), rows(spark, bo, "bo"), Settings(unit_rows=12), seed % 2 == 0)).collect()
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == model(stm, bo, Settings(), seed % 2 == 0)


@pytest.mark.parametrize("by_time", [False, True])
def test_untimed_hot_group_is_zipped(spark, by_time):
    """A statement without times: exact without a unit of the whole day."""
    rnd = random.Random(11)
    side = lambda timed: dict(sec=rnd.randrange(0, 80000) if timed else 0, amount=rnd.choice([10, 20]), account="A", job="J", no_time=not timed,
                              dir=rnd.choice(["deposit", "withdraw"]), coarse=True)
    stm, bo = [side(False) for _ in range(70)], [side(True) for _ in range(60)]
    got = with_job(pair_rows(rows(spark, stm, "stm"), rows(spark, bo, "bo"), Settings(unit_rows=10), by_time)).collect()
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == model(stm, bo, Settings(), by_time)


@pytest.mark.parametrize("seed,bank,office", [(1, 0.3, 0), (4, 0, 0.1), (5, 0.3, 0.1)])
def test_units_are_joined_up_to_a_limit(spark, seed, bank, office):
    """Joined once, then rows without time walk on along the longer units."""
    stm, bo = mixed(seed, bank, office)
    got = with_job(pair_rows(rows(spark, stm, "stm"), rows(spark, bo, "bo"), Settings(unit_rows=6, walk_rows=30), seed % 2 == 0)).collect()
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == model(stm, bo, Settings(), seed % 2 == 0)


def test_untimed_rows_pass_many_units_in_few_rounds(spark, monkeypatch):
    """Earlier bank rows hold all but the last back-office rows, so rows without time pass 70 units; each took a round."""
    at = lambda sec, late=False: dict(sec=sec, amount=10, account="A", job="J", no_time=late, dir="deposit", coarse=False)
    bo = [at(400 * i) for i in range(1, 81)]
    stm = [at(400 * i + 7) for i in range(1, 71)] + [at(0, True) for _ in range(8)]
    staged, stage = [], matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name, *rest: staged.append(name) or stage(df, name, *rest))
    got = with_job(pair_rows(rows(spark, stm, "stm"), rows(spark, bo, "bo"), Settings(unit_rows=2))).collect()
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == model(stm, bo, Settings(), False)
    assert staged.count("moved") <= 8


@pytest.mark.parametrize("seed,bank,office", [(1, 0.3, 0), (3, 0.9, 0), (4, 0, 0.1), (5, 0.3, 0.1)])
def test_untimed_rows_walk_along_lanes_longer_than_a_unit(spark, seed, bank, office):
    """Lanes of more than ``walk_rows`` rows keep their units."""
    stm, bo = mixed(seed, bank, office)
    got = with_job(pair_rows(rows(spark, stm, "stm"), rows(spark, bo, "bo"), Settings(unit_rows=12, walk_rows=12), seed % 2 == 0)).collect()
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == model(stm, bo, Settings(), seed % 2 == 0)


def test_lanes_of_one_unit_take_no_rounds(spark, monkeypatch):
    """Rows without time in both directions: passes 1a and 1b took rounds of units."""
    rnd = random.Random(21)

    def make(untimed):
        late = rnd.random() < untimed
        return dict(sec=0 if late else rnd.randrange(0, 20000), amount=rnd.choice([10, 10, 20, 30]), account="A", job="J", no_time=late,
                    dir=rnd.choice(["deposit", "withdraw"]), coarse=False)

    stm, bo = [make(0.3) for _ in range(120)], [make(0) for _ in range(110)]
    staged, stage = [], matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name, *rest: staged.append(name) or stage(df, name, *rest))
    got = with_job(pair_rows(rows(spark, stm, "stm"), rows(spark, bo, "bo"), Settings(unit_rows=6))).collect()
    want = model(stm, bo, Settings(), False)
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == want
    assert {w[0] for w in want} == {"exact", "late", "amount"}
    assert staged[:staged.index("first-pairs")].count("moved") == 0


def test_chain_along_many_units_takes_two_rounds(spark, monkeypatch):
    """Every bank row finds its nearest row taken by the one before, along 80 units; longer units took a round each time they grew."""
    at = lambda sec: dict(sec=sec, amount=10, account="A", job="J", no_time=False, dir="withdraw", coarse=False)
    bo = [at(150 * i) for i in range(1, 82)]
    stm = [at(150)] + [at(150 * i + 70) for i in range(1, 81)]
    staged, stage = [], matching.stage
    monkeypatch.setattr(matching, "stage", lambda df, name, *rest: staged.append(name) or stage(df, name, *rest))
    got = with_job(pair_rows(rows(spark, stm, "stm"), rows(spark, bo, "bo"), Settings(unit_rows=2))).collect()
    want = model(stm, bo, Settings(), False)
    assert sorted((r["pass"], r.stm_seq, r.bo_seq, r.dt_sec) for r in got) == want and len(want) == 81
    assert staged.count("moved") == 2
