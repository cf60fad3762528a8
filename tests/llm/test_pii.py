import random
import re
import time

from ledgerline.llm import pii
from ledgerline.llm.queries import QUERIES
from tests.llm.util import write_tables


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def card(rnd, n=16):
    body = "".join(rnd.choice("0123456789") for _ in range(n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def run(spark, texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in pii.with_pseudonyms(df, key, found="found").collect()}
    return [out[i].text for i in range(len(texts))], [[(f.kind, f.text) for f in out[i].found] for i in range(len(texts))]


def mod97(x):
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def test_each_kind_keeps_its_format(spark):
    rnd = random.Random(1)
    c = card(rnd)
    texts = [f"a {c} b", f"a {c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]}, b", "mail Bob.49x@mail7.example.com.", "ip 30.142.124.66, x", "on 2024-02-29 it", "born 31.12.1969!", "us 12/31/1969", "ssn 123-45-6789",
             "call +1 (617) 555-7013 now", "call +49 30 1234567", "iban DE89 3704 0044 0532 0130 00 ok", "iban GB82WEST12345698765432"]
    new, found = run(spark, texts)
    assert [f[0][0] for f in found] == ["card", "card", "email", "ip", "date", "date", "date", "ssn", "phone", "phone", "iban", "iban"]
    digit = lambda s: re.sub(r"\d", "0", s)
    for t, n, f in zip(texts, new, found):
        assert t != n and (digit(t) == digit(n) or f[0][0] in ("email", "ip"))
    d = [re.sub(r"\D", "", x) for x in new[:2]]
    assert d[0] == d[1] and luhn(d[0]) and d[0][0] == c[0]
    m = re.fullmatch(r"mail ([A-Z][a-z]{2}\.\d\d[a-z])@mail7\.example\.com\.", new[2])
    assert m and m[1] != "Bob.49x"
    assert all(int(o) < 256 for o in re.search(r"[\d.]+\d", new[3])[0].split("."))
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4} now", new[8])
    assert all(mod97(re.sub(" |iban|ok", "", n)) == 1 for n in new[10:])
    again, _ = run(spark, texts)
    other, _ = run(spark, texts, "another key")
    assert again == new and all(a != b for a, b in zip(new, other))
    same_day, _ = run(spark, ["2001-05-06", "06.05.2001"])
    assert same_day[0].split("-") == same_day[1].split(".")[::-1]


def test_different_values_stay_different_and_valid(spark):
    rnd = random.Random(2)
    dates = [f"{1930 + i // 365:04d}-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(3000)]
    ssns = [f"{a:03d}-{rnd.randint(1, 99):02d}-{rnd.randint(1, 9999):04d}" for a in range(1, 900) if a != 666]
    ips = [f"{i // 256}.{i % 256}.7.{i * 7 % 256}" for i in range(0, 60000, 29)]
    for values, kind in ((dates, "date"), (ssns, "ssn"), (ips, "ip"), ([card(rnd, 13 + i % 7) for i in range(600)], "card")):
        new, found = run(spark, values)
        assert all(f == [(kind, v)] for f, v in zip(found, values))
        assert len(set(new)) == len(set(values))
        assert all(f == [(kind, v)] for f, v in zip(run(spark, new)[1], new))


def test_invalid_candidates_and_plain_text_stay(spark):
    rnd = random.Random(3)
    c = card(rnd)
    wrong = c[:-1] + str((int(c[-1]) + 1) % 10)
    texts = [f"x {wrong} y", "300.1.1.1", "1.2.3.4.5", "2023-02-29", "000-12-3456", "DE89 3704 0044 0532 0130 01", "", None, "no data 12345 é", "1" * 30, "word " * 30000 + "a@b.de"]
    new, found = run(spark, texts)
    assert new[:10] == texts[:10]
    assert new[10] != texts[10] and new[10].startswith("word word ") and len(new[10]) == len(texts[10])


def test_query_and_clashing_columns(spark, tmp_path):
    rows = [(1, "ip 30.142.124.66", "p"), (1, "ip 30.142.124.66", "p"), (None, "a@b.de", "q"), (3, None, "r")]
    folder = write_tables(spark, tmp_path, documents=(rows, "doc_id bigint, text string, found string"))
    got = QUERIES["op5_pii_pseudonyms"](spark, folder).collect()
    assert len(got) == 4 and sum(r.n_ip for r in got) == 2 and sum(r.n_email for r in got) == 1 and [r.text for r in got if r.doc_id == 3] == [None]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert pii.with_pseudonyms(docs, "k").columns == docs.columns and pii.with_pseudonyms(docs.limit(0), "k").count() == 0


def test_values_before_numbers_and_capitals_are_found(spark):
    c, at, be, de = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201", "BE68 5390 0754 7034", "DE89 3704 0044 0532 0130 00"
    card_, iban = (lambda x: ("card", x)), (lambda x: ("iban", x))
    cases = [(f"{c} 12/27", [card_(c)]), ("4111111111111111 123", [card_("4111111111111111")]), (f"pay {c}-123.", [card_(c)]), (f"{at} BIC BKAUATWW", [iban(at)]), (f"{be} EUR 5", [iban(be)]),
             (f"{at} {be}", [iban(at), iban(be)]), (f"{at} INVOICE {c} 123 {de} X", [iban(at), card_(c), iban(de)]), (f"no 12 {c}", [card_(c)]), (f"{be} {c}", [iban(be), card_(c)]),
             ("4111111111111111 123-45-6789", [card_("4111111111111111"), ("ssn", "123-45-6789")]), ("AT61 1904 3002 3457 3202 BIC", []), (f"é {c} 77 " * 1300, [card_(c)] * 1300)]
    new, found = run(spark, [t for t, _ in cases])
    for (t, want), n, f in zip(cases, new, found):
        assert f == want, (t[:80], f[:3])
        assert len(n) == len(t) and all(v not in n for _, v in want)
        same = t
        for _, v in want:
            same = same.replace(v, "#" * len(v), 1)
        assert all(a == "#" or a == b for a, b in zip(same, n))


def test_dates_of_both_orders_never_meet(spark):
    rnd = random.Random(4)
    days = [(rnd.randint(1930, 2029), rnd.randint(1, 12), rnd.randint(1, 28)) for _ in range(1500)]
    values = sorted({w for y, m, d in days for w in (f"{d:02d}/{m:02d}/{y}", f"{m:02d}/{d:02d}/{y}", f"{y}/{m:02d}/{d:02d}")})
    new, found = run(spark, values)
    assert all(f == [("date", v)] for f, v in zip(found, values))
    assert len(set(new)) == len(values)
    back = dict(zip(values, new))
    for y, m, d in days:
        if d > 12:  # one date in every order
            a, b, c = back[f"{d:02d}/{m:02d}/{y}"].split("/"), back[f"{m:02d}/{d:02d}/{y}"].split("/"), back[f"{y}/{m:02d}/{d:02d}"].split("/")
            assert a == [b[1], b[0], b[2]] == c[::-1] and int(a[0]) > 12


def test_dotted_runs_and_long_names_take_linear_time(spark):
    run(spark, ["a@b.de"])
    start = time.time()
    dots, name = "a." * 60_000, "ab.c-1" * 2000
    new, found = run(spark, [dots, f"x {name}@mail.example.com y", f"{dots} .j.doe@example.org"])
    assert time.time() - start < 60
    assert new[0] == dots and found[0] == [] and [k for k, _ in found[1]] == ["email"] and found[2][-1] == ("email", ".j.doe@example.org")
    assert new[1] != f"x {name}@mail.example.com y" and len(new[1]) == len(name) + 21
