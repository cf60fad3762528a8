"""Registry, job state, incidents, sinks and streams on small tables."""
import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import incidents, jobs, registry
from ledgerline.plans.reconcile import reconcile
from ledgerline.sources import sinks
from ledgerline.streaming.ingest import completeness_stream
from ledgerline.streaming.deltas import _versions_schema, completeness_deltas, completeness_so_far, newer_versions, signed_shares
from ledgerline.streaming.epochs import compact, read_epochs, write_epoch
from ledgerline.streaming.probes import PART_SECONDS, _Runs, incidents_so_far, probe_incidents_stream
from tests.test_matching import CFG, rows

T = dt.datetime


def test_registry_self_match(spark):
    """Every generated account is found by its own file name, never by another's."""
    acc = [(f"10000000{i:02d}", ["SCB", "KBANK", "KTB"][i % 3], f"นาย ชื่อ{i:02d} สกุล{i:02d}", "bank", None, None, f"B{i}", i) for i in range(30)]
    acc += [("", "", "", "pm", p, p, f"Q{i}X8", 100 + i) for i, p in enumerate(["MYPAY", "AZPAY", "12PAY"])]
    a = spark.createDataFrame(acc, "account string, bank string, name string, source string, provider string, channel string, subco string, ord int")
    files = [(r[0] or r[6], f"{r[1]} ชื่อ{r[7]:02d} สกุล{r[7]:02d} ถอน-ฝาก 05-06-2026.pdf" if r[3] == "bank" else f"{r[6]} {r[4].lower()} ฝาก.csv") for r in acc]
    got = {r.file_id: r for r in registry.match_files(spark.createDataFrame(files, "file_id string, file_name string"), a).collect()}
    assert all((got[r[0]].account == r[0]) if r[3] == "bank" else (got[r[6]].subco == r[6]) for r in acc)
    odd = spark.createDataFrame([("s", "q0x mypay ถอน.csv"), ("n", "รายการ mypay.csv"), ("u", "hello.csv"), ("t", "SCB ไม่มี.pdf")], "file_id string, file_name string")
    got = {r.file_id: r for r in registry.match_files(odd, a).collect()}
    assert got["s"].subco == "Q0X8" and got["s"].direction == "withdraw"
    assert got["n"].ambiguous and got["u"].reason and got["t"].account is None


BATCH = "id string, business_date date, company string, business_system string"
FILE = "batch_id string, id string, file_name string, kind string, parsed boolean, parse_error string, company string, storage_path string, ingested_at timestamp"
REQ = "company string, required_groups array<array<string>>, close_time string, close_day_offset int, active boolean"


def test_completeness_stream(spark, tmp_path):
    """A job waits, becomes ready, and a late file after completion marks it; alerts are sent once."""
    day = dt.date(2026, 8, 1)
    batches = spark.createDataFrame([("b1", day, "C", None)], BATCH)
    req = spark.createDataFrame([("*", [["stm_pdf"], ["bo_main"]], "10:00:00", 1, True)], REQ)
    src, out = tmp_path / "in", str(tmp_path / "out")
    now = F.lit("2026-09-01 00:00:00").cast("timestamp")

    def push(n, items):
        spark.createDataFrame([("b1", f"f{n}{i}", name, kind, False, None, None, f"p{n}{i}", T(2026, 8, 1, n)) for i, (name, kind) in enumerate(items)], FILE).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(FILE).parquet(str(src))
        completeness_stream(stream, lambda: batches, req, out, str(tmp_path / "ck"), now).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{out}/jobs").collect()

    first = push(1, [("stm.pdf", "unknown")])
    assert [(r.status, r.file_count) for r in first] == [("needs_review", 1)]
    second = push(2, [("BO x.xlsx", "unknown")])
    assert [(r.status, r.file_count, r.late_file) for r in second] == [("ready", 2, False)]
    done = spark.createDataFrame([(day, "C", "completed", 2, 1, False)], "business_date date, company string, status string, file_count bigint, attempt_count int, late_file boolean")
    files = spark.read.parquet(f"{out}/files").drop("business_date")
    more = files.unionByName(files.limit(1).withColumn("id", F.lit("x")))
    late = jobs.refresh_jobs(batches, more, req, done, now).collect()[0]
    assert (late.status, late.late_file, late.attempt_count) == ("ready", True, 0)
    assert spark.read.parquet(f"{out}/alerts").count() == 1


def test_parked_files_and_late_reruns(spark, tmp_path):
    """A file that comes before its mail is parked and placed later; a late file reruns its job."""
    day = dt.date(2026, 8, 1)
    mails = [("b1", day, "C", None)]
    req = spark.createDataFrame([("*", [["stm_pdf"], ["bo_main"]], "10:00:00", 1, True)], REQ)
    src, out, late = tmp_path / "in", str(tmp_path / "out"), []
    now = F.lit("2026-09-01 00:00:00").cast("timestamp")

    def push(n, batch, name):
        spark.createDataFrame([(batch, f"f{n}", name, "unknown", False, None, None, f"p{n}", T(2026, 8, 1, n))], FILE).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(FILE).parquet(str(src))
        completeness_stream(stream, lambda: spark.createDataFrame(mails, BATCH), req, out, str(tmp_path / "ck"), now,
                            rerun=lambda j: late.extend(map(tuple, j.collect()))).trigger(availableNow=True).start().awaitTermination()
        return {(r.id, r.business_date) for r in spark.read.schema(FILE + ", business_date date").parquet(f"{out}/files").collect()}

    assert push(1, "b2", "stm.pdf") == {("f1", None)}
    assert push(2, "b1", "stm.pdf") == {("f1", None), ("f2", day)}
    mails.append(("b2", day, "C", None))
    assert push(3, "b1", "BO x.xlsx") == {("f1", day), ("f2", day), ("f3", day)}
    jobs_now = spark.read.parquet(f"{out}/jobs")
    assert [(r.status, r.file_count) for r in jobs_now.collect()] == [("ready", 3)] and not late
    done = [r.asDict() | {"status": "completed"} for r in jobs_now.collect()]
    spark.createDataFrame(done, jobs_now.schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("business_date").parquet(f"{out}/jobs")
    push(4, "b1", "stm 2.pdf")
    assert late == [(day, "C")]


def test_incidents_stream_equals_batch(spark, tmp_path):
    import random
    rnd = random.Random(3)
    data = [(rnd.choice("ab"), i, T(2026, 1, 1 + i // 40, i % 24, i % 40), rnd.choice(["UP", "DOWN", "DOWN"])) for i in range(160)]
    data.sort(key=lambda r: (r[2], r[1]))
    p = "link_id string, probe_id bigint, ts timestamp, status string"
    want = {tuple(r) for r in incidents.incident_intervals(spark.createDataFrame(data, p)).collect()}
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (data[40:80], data[120:], data[:40], data[80:120], data[80:120]):  # late parts, and one that comes twice
        spark.createDataFrame(part, p).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(p).parquet(src)
        probe_incidents_stream(stream, out, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in incidents_so_far(spark, out).collect()]
    assert len(got) == len(want) and set(got) == want
    parts = lambda rows: {(r[0], int(r[2].replace(tzinfo=dt.timezone.utc).timestamp()) // PART_SECONDS) for r in rows}
    for epoch, part in enumerate((data[40:80], data[120:], data[:40], data[80:120], [])):  # only parts with new probes are written
        wrote = spark.read.schema("link_id string, part bigint").parquet(f"{out}/runs/epoch={epoch}").collect()
        assert {(r.link_id, r.part) for r in wrote} == parts(part)


def test_signed_changes_equal_the_newest_versions(spark, tmp_path):
    """Files move between mails, change kind and get parsed, in any order of their versions; mails come late."""
    import random
    rnd = random.Random(8)
    day = lambda i: dt.date(2026, 8, 1 + i % 3)
    mails = [(f"b{i}", day(i), rnd.choice(["C", "D", None]), None) for i in range(12)]
    versions = [(f"b{rnd.randrange(14)}", f"f{p}", rnd.choice(["stm.pdf", "BO x.xlsx", "x.txt"]), rnd.choice(["unknown", "bo_main"]), rnd.random() < 0.5, rnd.choice([None, "bad"]), rnd.choice([None, None, "E"]), f"p{p}", T(2026, 8, 1, v))
                for p in range(40) for v in range(rnd.randint(1, 4))]
    versions.append(versions[0])
    rnd.shuffle(versions)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.createDataFrame(versions[k::4], FILE).coalesce(1).write.mode("append").parquet(src)
        completeness_deltas(spark.readStream.schema(FILE).parquet(src), out, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    batches = spark.createDataFrame(mails, BATCH)
    newest = jobs.upsert_latest(spark.createDataFrame([], FILE), spark.createDataFrame(versions, FILE), ["storage_path"], "ingested_at").select(*[c.split()[0] for c in FILE.split(", ")])
    want = sorted(map(str, jobs.job_completeness(batches, newest).collect()))
    assert sorted(map(str, completeness_so_far(spark, out, batches).select(*jobs.job_completeness(batches, newest).columns).collect())) == want and len(want) > 4


def test_state_of_probes_is_read_and_written_once_a_batch():
    class Value:
        calls, held = 0, None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    class Handle:
        def __init__(self):
            self.value = Value()

        def getValueState(self, name, schema):  # noqa: N802
            return self.value

    runs, handle = _Runs(), Handle()
    runs.init(handle)
    probe = lambda at, i, status: {"at": at, "probe_id": i, "status": status}
    push = lambda rows: [(r.seen, [tuple(x) for x in r.runs]) for r in runs.handleInputRows(("a", 7), iter(rows), None)]
    assert push([probe(k, k, "UP") for k in range(500)]) == [(500, [(0, 0, "UP")])] and handle.value.calls == 2
    assert push([probe(3, 3, "DOWN"), probe(-2, 900, "DOWN"), probe(3, 4, "DOWN"), probe(3, 4, "UP")]) == [(502, [(-2, 900, "DOWN"), (0, 0, "UP"), (3, 4, "DOWN"), (4, 4, "UP")])]
    assert push([probe(3, 3, "DOWN")]) == []


def test_common_holder_words_cost_no_row_for_each_account(spark):
    """Scores, ties and the first account are those of comparing every file with every account."""
    import random
    rnd = random.Random(4)
    words = ["somchai", "somsri", "chai", "yai", "dee", "ngam", "boon", "kaew", "thong", "suk"]
    owner = [(f"{i:04d}", rnd.choice(["SCB", "KTB"]), "นาย " + " ".join(rnd.choices(words, k=rnd.choice([1, 2, 2, 3, 8]))), "bank", f"S{i % 5}", None, None, i // 2 if i % 9 == 0 else i) for i in range(150)]
    owner += owner[:3] + [(*owner[4][:2], "นาย dee dee", *owner[4][3:])]
    accounts_ = spark.createDataFrame(owner, "account string, bank string, name string, source string, subco string, provider string, channel string, ord int")
    names = [(f"f{i}", f"{rnd.choice(['SCB', 'KTB'])} {' '.join(rnd.choices(words, k=rnd.choice([0, 1, 2, 3, 9])))}.pdf") for i in range(60)]
    names += [names[0], ("f1", "SCB dee suk.pdf"), ("f2", "KTB yai.pdf")]
    files = spark.createDataFrame(names, "file_id string, file_name string")
    f = registry.describe_names(files).filter("provider is null and bank is not null")
    spelled = accounts_.select("bank", "account", "subco", "ord", F.explode(F.transform(X.name_words("name"), X.name_norm)).alias("word")).filter("length(word) >= 2")
    scored = f.join(spelled, (f["bank"] == spelled["bank"]) & F.contains("raw", "word")).groupBy("file_id", "account", "subco", "ord").agg(F.count(F.lit(1)).alias("score")).collect()
    want = {}
    for name in {r.file_id for r in scored}:
        mine = [r for r in scored if r.file_id == name]
        best = max(r.score for r in mine)
        tied = [r for r in mine if r.score == best]
        first = min(r.ord for r in tied)
        want[name] = (best, {r.account for r in tied if r.ord == first}, len(tied), ",".join(sorted({r.account for r in tied})) if len(tied) > 1 else None)
    got = {r.file_id: r for r in registry._best_holders(f, accounts_.filter("source = 'bank'")).collect()}
    assert set(got) == set(want) and any(w[2] > 5 for w in want.values())
    for name, (best, first, ties, tied) in want.items():
        r = got[name]
        assert (r.score, r.ties, r.tied) == (best, ties, tied) and r.m.account in first


def test_signed_changes_ask_no_state_for_each_file(spark, tmp_path, monkeypatch):
    """Micro-batches of many files are compared with the known versions in a join, and folding leaves the sums as they are."""
    monkeypatch.setattr("ledgerline.streaming.deltas.FOLD_EVERY", 3)
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    file = lambda p, v, mail: (mail, f"f{p}", "stm.pdf", "unknown", v % 2 == 0, None, "C", f"p{p}", T(2026, 8, 1, v))
    mails = spark.createDataFrame([("a", dt.date(2026, 8, 1), "C", None), ("b", dt.date(2026, 8, 2), "C", None)], BATCH)
    counts = lambda: {r.business_date.day: (r.file_count, r.parsed_count) for r in completeness_so_far(spark, out, mails).collect()}
    for v in range(5):  # each version moves every file to the other mail
        spark.createDataFrame([file(p, v, "ab"[v % 2]) for p in range(40)], FILE).coalesce(1).write.mode("append").parquet(src)
        query = completeness_deltas(spark.readStream.schema(FILE).parquet(src), out, ck).trigger(availableNow=True).start()
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
        if v in (0, 1, 4):
            assert counts() == ({1: (40, 40)} if v % 2 == 0 else {2: (40, 0)})
    assert (tmp_path / "ck" / "newest" / "markers" / "upto=2").exists()
    old = newer_versions(spark.createDataFrame([file(1, 3, "b"), file(2, 4, "c"), file(99, 0, "a")], FILE), read_epochs(spark, f"{ck}/newest", _versions_schema("string")))
    assert sorted(map(tuple, signed_shares(old).select("batch_id", "sign").collect())) == [("a", -1), ("a", 1), ("c", 1)]


def test_epochs_are_folded_behind_a_marker(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k string, n bigint"
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n")).filter("k <> 'old'")
    total = lambda: {r.k: r.n for r in read_epochs(spark, folder, schema).groupBy("k").agg(F.sum("n").alias("n")).collect()}
    assert total() == {}
    for epoch in range(6):
        write_epoch(spark.createDataFrame([("a", 1), ("b", epoch), ("old", 7)], schema), folder, epoch)
        write_epoch(spark.createDataFrame([("a", 1), ("b", epoch), ("old", 7)], schema), folder, epoch)  # a repeated micro-batch
        if epoch:
            compact(spark, folder, schema, fold, epoch - 1)
        assert total() == {"a": epoch + 1, "b": epoch * (epoch + 1) // 2, "old": 7 if epoch else 7}
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert len([n for n in names if n.startswith(("epoch", "base"))]) <= 4 and "base=4" in names
    spark.createDataFrame([("a", 99)], schema).write.parquet(f"{folder}/base=5")  # a compaction that died before its marker
    assert total()["a"] == 6


def test_outage_needs_two_checkpoints(spark):
    rows_ = [("d", c, reg, T(2026, 1, 1, 0, i), i, ok, 9) for i, (c, reg, ok) in enumerate(
        [("x", "TH", False), ("x", "TH", False), ("y", "TH", False), ("y", "TH", False), ("z", "SG", True), ("z", "SG", True)])]
    p = spark.createDataFrame(rows_, "domain string, checkpoint string, region string, ts timestamp, probe_id int, ok boolean, ssl_days_left int")
    r = incidents.outage_class(incidents.confirmed_outage(p)).collect()[0]
    assert (r.confirmed, r.th_fail, r.foreign_fail, r.severity) == (True, 2, 0, "P2")
    assert incidents.confirmed_outage(p.filter("checkpoint <> 'y'")).collect()[0].confirmed is False


def test_a_rerun_without_exceptions_leaves_none(spark, tmp_path):
    folder = str(tmp_path)
    bad = reconcile(rows(spark, [dict(sec=100, job="A"), dict(sec=100, job="B")], "stm"), rows(spark, [dict(sec=5000, job="A"), dict(sec=5000, job="B")], "bo"), cfg=CFG)
    good = reconcile(rows(spark, [dict(sec=100, job="A")], "stm"), rows(spark, [dict(sec=100, job="A")], "bo"), cfg=CFG)
    sinks.write_run(bad, folder, created_at=T(2026, 1, 1, 1))
    sinks.write_run(good, folder, created_at=T(2026, 1, 1, 2))
    runs = spark.read.parquet(f"{folder}/runs")
    assert runs.count() == 3 and runs.select("id").distinct().count() == 3
    known = runs.select("business_date", "company").distinct().withColumn("id", F.concat_ws("/", F.col("business_date").cast("string"), "company"))
    latest = jobs.latest_run_per_job(known.withColumns({"status": F.lit("running"), "claimed_at": F.lit(None).cast("timestamp")}), runs)
    done = known.join(latest.select(F.col("job_id").alias("id"), F.col("run_id").alias("last_run_id")), "id").withColumn("status", F.lit("completed"))
    live = jobs.current_exceptions(done, spark.read.parquet(f"{folder}/exceptions")).collect()
    assert sorted((r.run_id.split("/")[1], r.ex_type) for r in live) == [("B", "missing_bo"), ("B", "missing_stm")]


def test_rows_without_job_are_paired_and_reported_once(spark):
    run = reconcile(rows(spark, [dict(sec=100)], "stm").withColumn("job_date", F.lit(None).cast("date")), rows(spark, [dict(sec=110)], "bo").withColumn("job_date", F.lit(None).cast("date")), cfg=CFG)
    assert [(r.matched, r.exception_count) for r in run.summary().collect()] == [(1, 0)]


def test_csv_report(spark, tmp_path):
    sinks.write_csv_report(spark.createDataFrame([("x", 'a"b')], "k string, v string").coalesce(1), str(tmp_path / "r"))
    body = next((tmp_path / "r").glob("*.csv")).read_bytes()
    assert body == '﻿"k","v"\r\n"x","a""b"\r\n'.encode() or body == '"﻿k","v"\r\n"x","a""b"\r\n'.encode()
