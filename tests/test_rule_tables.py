"""Rule tables, renormalising by fingerprint and link history on small tables."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import link_history, reports
from ledgerline.operators.renormalize import fingerprints, renormalize
from ledgerline.rule_tables import DEFAULT, RuleError, compile_rows, compile_table, rows_of, table_of
from ledgerline.settings import Settings

T = dt.datetime


def test_rules_survive_a_table(spark):
    assert compile_table(table_of(spark)) == DEFAULT
    more = compile_rows([*rows_of(), ("header", "date", ["fecha"], 1), ("report", "extra:aux", ["a", "b"], 50)])
    assert "fecha" in dict(more.headers)["date"] and more.reports[-1] == ("extra", "aux", ("a", "b"))
    assert [k for k, _ in more.headers] == [k for k, _ in DEFAULT.headers]


@pytest.mark.parametrize("row,word", [(("colour", "x", ["a"], 1), "unknown kind"), (("header", "date", [], 1), "no words"), (("bank", "B", [" "], 99), "no words"), (("header", "shoe", ["a"], 99), "logical column"),
                                      (("report", "x", ["a"], 99), "code:side"), (("report", "x:up", ["a"], 99), "code:side"), (("bank", "B", ["b"], 0), "taken"), (("bank", None, ["b"], 9), "no result")])
def test_faulty_rules_are_named(row, word):
    with pytest.raises(RuleError, match=word):
        compile_rows([*rows_of(), row])


def _files(spark, items):
    rows = [(f, i + 1, cells) for f, lines in items.items() for i, cells in enumerate(lines)]
    files = [(f, f"scb_stm_{f}.csv", 0, dt.date(2026, 8, 1), "C") for f in items]
    return (spark.createDataFrame(rows, "file_id string, row_no int, cells array<string>"),
            spark.createDataFrame(files, "file_id string, file_name string, file_seq int, job_date date, job_company string"))


def test_only_changed_files_are_read_again(spark):
    head = ["วันที่", "เวลา", "ถอน", "ฝาก", "เลขที่บัญชี"]
    line = lambda amount: ["1/8/2026", "10:00:00", "", amount, "SCB-1"]
    base = {"a": [head, line("5"), line("6")], "b": [head, line("7")], "c": [head, line("8")], "d": [head]}
    asked = []

    def normalize(rows, files, cfg):
        asked.append(sorted(r.file_id for r in files.select("file_id").collect()))
        return reports.normalize(rows, files, cfg)

    first, redo, _ = renormalize(*_files(spark, base), None, normalize)
    first = spark.createDataFrame(first.collect(), first.schema)
    assert asked == [["a", "b", "c", "d"]] and {r.why for r in redo.collect()} == {"new"}
    now = {"a": [head, line("6"), line("5")], "b": base["b"], "d": base["d"], "e": [head, line("9")]}
    second, redo, _ = renormalize(*_files(spark, now), first, normalize)
    assert asked[1] == ["a", "d", "e"]  # a's rows have changed places; d has no rows to be known by
    assert {r.file_id: r.why for r in redo.collect()} == {"a": "changed", "c": "gone", "d": "new", "e": "new"}
    amounts = lambda df: sorted((r.file_id, str(r.amount)) for r in df.collect())
    assert amounts(second) == [("a", "5.00"), ("a", "6.00"), ("b", "7.00"), ("e", "9.00")]
    marks = lambda cfg: {tuple(r) for r in fingerprints(*_files(spark, base), cfg).collect()}
    assert marks(Settings()) == marks(Settings(dup_window_sec=1)) and not marks(Settings()) & marks(Settings(filter_carry_forward=False))


def test_link_history_is_closed_open(spark):
    links = spark.createDataFrame([("l1", "u0", "UP"), ("l2", "v0", "DOWN"), ("l3", "w0", "UP")], "link_id string, url string, last_status string")
    inc = spark.createDataFrame([(1, "l1", T(2026, 1, 1)), (2, "l1", T(2026, 1, 3)), (3, "l2", T(2026, 1, 2)), (4, "nowhere", T(2026, 1, 2)), (5, "l1", T(2026, 1, 3, 5))], "incident_id int, link_id string, detected_at timestamp")
    acts = spark.createDataFrame([
        (1, T(2026, 1, 2), 1, "admin_update", " u1 ", None), (1, T(2026, 1, 3), 2, "admin_update", "u2", None), (1, T(2026, 1, 3), 3, "admin_update", "u3", None), (2, T(2026, 1, 4), 1, "it_resolve", "ignored", "b1"),
        (3, T(2026, 1, 2), 1, "it_resolve", None, "b2"), (3, T(2026, 1, 5), 1, "close", "x", "y"), (3, T(2026, 1, 5), 2, "admin_update", "", None), (4, T(2026, 1, 5), 2, "admin_update", "z", None)],
        "incident_id int, at timestamp, seq int, action string, new_url string, backup_url string")
    changes = link_history.link_changes(inc, acts)
    assert changes.count() == 6
    versions = {(r.link_id, r.url, r.backup_url, r.valid_from, r.valid_to) for r in link_history.link_history(links, changes).collect()}
    assert versions == {("l1", "u0", None, None, T(2026, 1, 2)), ("l1", "u1", None, T(2026, 1, 2), T(2026, 1, 3)), ("l1", "u2", None, T(2026, 1, 3), T(2026, 1, 3)), ("l1", "u3", None, T(2026, 1, 3), T(2026, 1, 4)),
                        ("l1", "u3", "b1", T(2026, 1, 4), None), ("l2", "v0", None, None, T(2026, 1, 2)), ("l2", "v0", "b2", T(2026, 1, 2), None), ("l3", "w0", None, None, None)}
    at = {r.incident_id: (r.url, r.backup_url) for r in link_history.links_at(links, changes, inc, "detected_at").collect()}
    assert at == {1: ("u0", None), 2: ("u3", None), 3: ("v0", "b2"), 4: (None, None), 5: ("u3", None)}
    now = {r.link_id: (r.url, r.backup_url, r.last_status) for r in link_history.links_written_back(links, changes).collect()}
    assert now == {"l1": ("u3", "b1", "UNKNOWN"), "l2": ("v0", "b2", "DOWN"), "l3": ("w0", None, "UP")}
    assert link_history.link_history(links.limit(0), changes).count() == 0 and link_history.links_at(links, changes.limit(0), inc.filter(F.col("incident_id") == 1), "detected_at").collect()[0].url == "u0"


def test_deep_pages_read_their_partitions_only(spark):
    from ledgerline.operators.paging import ranked

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 9).alias("g"))
    table = ranked(df, F.col("g").desc_nulls_last(), F.col("k"), parts=16)
    want = [tuple(r) for r in df.orderBy(F.col("g").desc_nulls_last(), "k").collect()]
    assert table.count == 1000
    for size in (1, 12, 400):
        for n in {0, 1, 5, 999 // size, 1000 // size, 2000}:
            assert [tuple(r) for r in table.page(n, size).collect()] == want[n * size:(n + 1) * size]
    assert all(len(table.parts_of(12 * n, 12 * n + 12)) <= 2 for n in range(80)) and len(table.parts) > 8
    assert re.search(r"PartitionFilters: \[[^\]]*__part", table.page(40, 12)._jdf.queryExecution().toString())
    assert ranked(df.limit(0), F.col("k")).page(0, 5).count() == 0


def test_search_opens_parts_that_can_match(spark):
    from ledgerline.operators.text_search import indexed

    rows = [(i, f"https://site{i // 50}.example/Page-{i}", "note ÄÖ é" if i == 77 else None) for i in range(1000)] + [(1000, None, ""), (1001, "ab", "x")]
    index = indexed(spark.createDataFrame(rows, "id int, url string, note string"), ["url", "note"], [F.col("url")], parts=20)
    for word in ("SITE7.", "page-123", "äö", "é", "ab", "", "nowhere", "te ÄÖ"):
        want = sorted(i for i, u, n in rows if not word or any(word.lower() in (x or "").lower() for x in (u, n)))
        assert sorted(r.id for r in index.search(word).collect()) == want, word
    assert index.parts_for("nowhere") == [] and index.parts_for("ab") is None
    assert 1 <= len(index.parts_for("site7.")) <= 4 and len(index.parts_for("example")) > 15
    assert re.search(r"PartitionFilters: \[[^\]]*__part", index.search("site7.")._jdf.queryExecution().toString())
    assert indexed(spark.createDataFrame([], "id int, url string"), ["url"]).search("abc").count() == 0
