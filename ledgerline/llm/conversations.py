"""Repair of conversation structure by lightest derivations.

Rows of a conversation, in order, are kept, given another role, deleted, or joined by inserted empty rows until the roles read
``(s?(ua)+)?``.  The states of that pattern are :data:`START`, after a system row, after a user row and after an assistant row.  Items are
"rows i to the end of a segment, entered in state p", and a deduction puts one edit before such an item.  Values are (cost, rows
covered, audit): each deduction adds to the cost or covers one row more, so the functions are superior, and items that compete cover the
same rows, so among them the order is that of (cost, audit).

A conversation may be of any length.  All rows are put in order by a range partitioning and cut into segments of bounded size.  Each
segment yields its lightest (cost, audit) from every state to every state; neighbouring segments are combined, a bounded number at a
time, by deductions with two antecedents, in as many rounds as the longest conversation needs.  Equal costs over the same rows never
come with one audit the beginning of the other (it would lack an insertion and so cost less), so the least audit of a whole is made of
least audits of its parts.  The states chosen at the borders then tell each segment its edits.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, map_groups, stage
from ledgerline.llm.derivation import lightest

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Prices of the edits, and of a truncated row that stays.
PRICE = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_PRICE = 5
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ACCEPT = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
#: Stands for any accepted state after the last row.
END = 4
#: The state that a user or assistant row leads to, by the state before it: the pattern leaves no choice.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
INITIAL, ROLE = {SYSTEM: "s", USER: "u", ASSISTANT: "a"}, {USER: "user", ASSISTANT: "assistant"}
#: Rows of a segment, and segments combined at a time.
SEGMENT, FAN = 512, 64

#: Initials of neighbouring roles that are in order.
LEGAL = ("su", "ua", "au")
GOOD, BLANK, DUPLICATE, TRUNCATED = "good", "blank", "duplicate", "truncated"
#: White space, and a text whose last other character ends a sentence.
_SOLID, _ENDED = r"[^\x20\x09-\x0D]", r"(?s)[.!?][\x20\x09-\x0D]*\z"
_TABLE = "array<struct<p: int, q: int, cost: bigint, audit: string, states: string>>"


# ------------------------------------------------------------------------------------------ derivations
def edits(initial: str, fault: str, state: int):
    """Edits of a row in a state: letter, price and next state."""
    stay = TRUNCATED_PRICE if fault == TRUNCATED else 0
    yield DELETE, PRICE[DELETE], state
    if fault in (BLANK, DUPLICATE):
        return
    if initial == INITIAL[NEXT[state]]:
        yield KEEP, PRICE[KEEP] + stay, NEXT[state]
    elif initial == INITIAL[SYSTEM] and state == START:
        yield KEEP, PRICE[KEEP] + stay, SYSTEM
    yield REROLE, PRICE[REROLE] + stay, NEXT[state]


def lightest_to(rows: list[tuple[str, str]], exits: tuple[int, ...], goals: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) by entry state over ``rows`` (initial, fault) that ends in one of ``exits``; only for ``goals``, if given."""
    n = len(rows)
    before = [[[] for _ in STATES] for _ in range(n)]  # edits of a row by the state they lead to
    for i, (initial, fault) in enumerate(rows):
        for p in STATES:
            for letter, price, q in edits(initial, fault, p):
                before[i][q].append((p, price, letter))
    comes_from = [[p for p in STATES if NEXT[p] == q] for q in STATES]

    def deductions(item, value, _):
        i, q = item
        cost, covered, audit = value
        if i:
            for p, price, letter in before[i - 1][q]:
                yield (i - 1, p), (cost + price, covered + 1, letter + audit)
        for p in comes_from[q]:
            yield (i, p), (cost + PRICE[INSERT], covered, INSERT + audit)

    final = lightest([((n, q), (0, 0, "")) for q in exits], deductions, {(0, p) for p in goals})
    return {p: (final[0, p][0], final[0, p][2]) for p in goals or STATES if (0, p) in final}


def segment_table(rows: list[tuple[str, str]], first: bool, last: bool) -> list[dict]:
    """Lightest way through a segment from each state to each state; a first segment is entered in one state, a last one ends in :data:`END`."""
    entries = (START,) if first else STATES
    found = {END: lightest_to(rows, ACCEPT, entries)} if last else {q: lightest_to(rows, (q,)) for q in STATES}
    return [{"p": p, "q": q, "cost": cost, "audit": audit, "states": str(p)} for q, ways in found.items() for p, (cost, audit) in ways.items() if p in entries]


def combined(left: list[dict], right: list[dict]) -> list[dict]:
    """Lightest ways through two neighbouring spans: each deduction has one way of either as antecedents."""
    best: dict[tuple[int, int], tuple] = {}
    for a in left:
        for b in right:
            if a["q"] == b["p"]:
                value = (a["cost"] + b["cost"], a["audit"] + b["audit"], a["states"] + b["states"])
                if (a["p"], b["q"]) not in best or value < best[a["p"], b["q"]]:
                    best[a["p"], b["q"]] = value
    return [{"p": p, "q": q, "cost": c, "audit": t, "states": s} for (p, q), (c, t, s) in best.items()]


# ------------------------------------------------------------------------------------------ rows
def key_of(conv: Column | str) -> Column:
    """A text that is never NULL and differs by conversation."""
    conv = F.col(conv) if isinstance(conv, str) else conv
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("none"))


def ordered_rows(turns: DataFrame) -> DataFrame:
    """``conv``, ``conv_id``, ``turn``, ``role``, ``text``, ``seg`` and ``at`` (place in the segment) of each row, staged.

    Rows go by turn (NULL first), role and a hash of the text; NULL roles and texts are one space.  ``seg`` grows along a conversation.
    """
    spark = turns.sparkSession
    rows = turns.select(key_of("conv_id").alias("conv"), "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")).withColumn("digest", F.md5("text")).withColumn("id", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "digest", "id"]  # equal rows differ in id, so no key is too large to be split
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("id")

    def run(batches):
        conv, seg, at = None, -1, 0
        for batch in arrow_rows(batches):
            segs, places = [], []
            for c in batch.column(0).to_pylist():
                seg, at = (seg, at + 1) if c == conv and at + 1 < SEGMENT else (seg + 1, 0)
                conv = c
                segs.append(seg)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segs, pa.int64()), pa.array(places, pa.int32())], [*batch.schema.names, "seg", "at"])

    kind = dict(rows.dtypes)["conv_id"]
    rows = rows.mapInArrow(run, f"conv string, conv_id {kind}, turn bigint, role string, text string, digest string, seg bigint, at int")
    return stage(rows.withColumn("seg", F.col("seg") + F.shiftleft(F.spark_partition_id().cast("bigint"), 40)), "conversation-rows")


def _segments(rows: DataFrame) -> DataFrame:
    """One row for each segment with its figures, the initial and fault of each of its rows, and its table."""
    fault = F.when(~F.col("text").rlike(_SOLID), BLANK).when(~F.col("text").rlike(_ENDED), TRUNCATED).otherwise(GOOD)
    slim = rows.select("seg", "at", F.lit(0).alias("what"), "conv", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    note = lambda of, seg, at, what: of.select(seg.alias("seg"), at.alias("at"), F.lit(what).alias("what"), F.lit("").alias("conv"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("initial"), F.lit("").alias("fault"))
    seen = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("seg", "at")).alias("own"))
    ends = rows.groupBy("conv").agg(F.min("seg").alias("head"), F.max("seg").alias("tail"))
    zero = F.lit(0)
    notes = note(seen, F.col("own.seg"), F.col("own.at"), 1).unionByName(note(ends, F.col("head"), zero, 2)).unionByName(note(ends, F.col("tail"), zero, 3))

    def solve(key, held):
        firsts, marks = {r[0] for r in held if r[1] == 1}, {r[1] for r in held}
        own = sorted((r for r in held if r[1] == 0), key=lambda r: r[0])
        faults = [f if f == BLANK or at in firsts else DUPLICATE for at, _, _, _, _, f in own]
        initials = [r[4] for r in own]
        turns = sorted({r[3] for r in own if r[3] is not None})
        wrong = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        ways = segment_table(list(zip(initials, faults)), 2 in marks, 3 in marks)
        yield (*key, own[0][2], faults, initials, len(turns), turns[0] if turns else None, turns[-1] if turns else None, wrong, ways)

    schema = f"seg bigint, conv string, faults array<string>, initials array<string>, turns bigint, low bigint, high bigint, wrong bigint, ways {_TABLE}"
    return stage(map_groups(slim.unionByName(notes), ["seg"], ["at", "what", "conv", "turn", "initial", "fault"], solve, schema), "conversation-segments")


def _whole(parts: DataFrame) -> DataFrame:
    """``conv``, ``cost``, ``audit`` and ``states`` (entry state of each segment) from ``conv``, ``at`` (from 0) and ``ways`` of the segments."""

    def combine(key, held):
        _, ways, most = min(held, key=lambda r: r[0])
        rest = sorted(held, key=lambda r: r[0])[1:]
        for _, more, _ in rest:
            ways = combined(ways, more)
        yield (*key, most, ways)

    while True:
        most = parts.agg(F.max("at")).first()[0] or 0
        if not most:
            break
        groups = parts.select("conv", F.floor(F.col("at") / FAN).cast("bigint").alias("group"), "at", "ways", F.lit(0).alias("n"))
        done = groups.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv", "group")))
        alone = done.filter("n = 1").select("conv", F.col("group").alias("at"), "ways")
        more = map_groups(done.filter("n > 1"), ["conv", "group"], ["at", "ways", "n"], combine, f"conv string, at bigint, n int, ways {_TABLE}").select("conv", "at", "ways")
        parts = stage(alone.unionByName(more), "conversation-combined")
    way = F.col("ways")[0]  # from the only entry state to the end
    return parts.select("conv", way["cost"].alias("cost"), way["audit"].alias("audit"), way["states"].alias("states"))


def derive(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in order, segments with the way chosen for them (``p``, ``own``), and whole conversations."""
    rows = ordered_rows(turns)
    along = Window.partitionBy("conv").orderBy("seg")
    segments = _segments(rows).withColumn("n", (F.row_number().over(along) - 1).cast("bigint"))  # a window over segments, not rows
    whole = stage(_whole(segments.select("conv", F.col("n").alias("at"), "ways")), "conversation-whole")
    state = lambda at: F.substring("states", at, F.lit(1)).try_cast("int")
    chosen = segments.join(whole.select("conv", "states"), "conv").withColumns({"p": state((F.col("n") + 1).cast("int")), "q": F.coalesce(state((F.col("n") + 2).cast("int")), F.lit(END))})
    chosen = chosen.withColumn("own", F.filter("ways", lambda w: (w["p"] == F.col("p")) & (w["q"] == F.col("q")))[0]["audit"]).drop("ways", "states", "q")
    return rows, stage(chosen, "conversation-chosen"), whole


def edit_list(chosen: DataFrame) -> DataFrame:
    """``conv``, ``seg``, ``step``, ``at`` (NULL: inserted), ``edit``, ``new_role`` (NULL: unchanged) and ``fault`` of each edit."""

    def run(batches):
        for batch in arrow_rows(batches):
            out = []
            for conv, seg, p, audit, initials, faults in zip(*(c.to_pylist() for c in batch.columns)):
                at, state = 0, p
                for step, letter in enumerate(audit):
                    inserted = letter == INSERT
                    if letter == KEEP:
                        state = SYSTEM if initials[at] == INITIAL[SYSTEM] else NEXT[state]
                    elif letter != DELETE:
                        state = NEXT[state]
                    out.append((conv, seg, step, None if inserted else at, letter, ROLE[state] if letter in (REROLE, INSERT) else None, None if inserted else faults[at]))
                    at += not inserted
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = zip(*out) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "seg", "step", "at", "edit", "new_role", "fault"])

    return chosen.select("conv", "seg", "p", "own", "initials", "faults").mapInArrow(run, "conv string, seg bigint, step int, at int, edit string, new_role string, fault string")


def apply_edits(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``conv``, ``seg``, ``step``, ``turn``, ``role``, ``text``, ``edit`` and ``fault`` of every row, deleted ones included."""
    given = rows.select(F.col("seg").alias("__seg"), F.col("at").alias("__at"), "turn", "role", "text")
    done = edit_list(chosen).join(given, (F.col("seg") == F.col("__seg")) & (F.col("at") == F.col("__at")), "left")
    return done.select("conv", "seg", "step", "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit", "fault")


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 0), ``turn``, ``role``, ``text``, ``edit`` and ``fault`` of the rows of repaired conversations.

    ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``.  Rows go by turn (NULL first), then role and a hash of the text; NULL roles and texts count as
    one space, a NULL id is a conversation of its own, and repeated rows are duplicates of the first.  A role of no characters fits
    nowhere, like one with another initial.  Texts are never cut.  Inserted rows have no turn and an empty text.  Other columns are
    ignored; an empty table gives no row, and a conversation that is deleted as a whole none either.
    """
    rows, chosen, _ = derive(turns)
    names = rows.groupBy("conv").agg(F.min("conv_id").alias("conv_id"))
    begins = chosen.select("seg", (F.length("own") - F.length(F.regexp_replace("own", DELETE, ""))).alias("gone"), "conv", "n", F.length("own").alias("steps"))
    begins = begins.withColumn("begin", F.sum(F.col("steps") - F.col("gone")).over(Window.partitionBy("conv").orderBy("n")) - F.col("steps") + F.col("gone"))
    left = apply_edits(rows, chosen).filter(F.col("edit") != DELETE)
    inside = Window.partitionBy("conv", "seg").orderBy("step")
    left = left.withColumn("nth", F.row_number().over(inside) - 1).join(begins.select("seg", "begin"), "seg").join(names, "conv")
    return left.select("conv_id", (F.col("begin") + F.col("nth")).alias("place"), "turn", "role", "text", "edit", "fault")


def _hashes(left: DataFrame) -> DataFrame:
    """``conv`` and ``repaired_sha256`` of the repaired rows; a running hash in order, so that no conversation is held whole."""

    def run(batches):
        conv, state = None, None
        for batch in arrow_rows(batches):
            out = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if c != conv:
                    if conv is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                    state.update(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], ["conv", "repaired_sha256"])
        if conv is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([state.hexdigest()])], ["conv", "repaired_sha256"])

    rows = left.select("conv", "role", "text", "seg", "step").repartition("conv").sortWithinPartitions("conv", "seg", "step")
    return rows.mapInArrow(run, "conv string, repaired_sha256 string")


def summary(turns: DataFrame) -> DataFrame:
    """``conv`` (see :func:`key_of`), ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` and ``repaired_sha256`` by conversation.

    The hash is that of the repaired ``role:text`` lines.  It and the audit are one value for a conversation, so a conversation of
    very many rows passes through one task as a stream of rows for the one and as one letter a row for the other.
    """
    rows, chosen, whole = derive(turns)
    along = Window.partitionBy("conv").orderBy("n")
    edge = chosen.withColumns({"then": F.lead("low").over(along), "follows": F.lead(F.col("initials")[0]).over(along)})
    of = lambda kind: F.size(F.filter("faults", lambda f: f == kind)).cast("bigint")
    across = F.when(F.col("follows").isNotNull() & ~F.concat(F.element_at("initials", -1), "follows").isin(*LEGAL), 1).otherwise(0)
    facts = edge.groupBy("conv").agg((F.max("high") - F.min("low") + 1 - F.sum("turns") + F.count_if(F.col("then") == F.col("high"))).alias("gaps"),
                                     *[F.sum(of(k)).alias(k) for k in (BLANK, DUPLICATE, TRUNCATED)], F.sum(F.col("wrong") + across).alias("illegal"))
    hashes = _hashes(apply_edits(rows, chosen).filter(F.col("edit") != DELETE))
    out = facts.join(whole.select("conv", "cost", "audit"), "conv").join(hashes, "conv", "left")
    return out.select("conv", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), BLANK, DUPLICATE, TRUNCATED, F.col("illegal").cast("bigint").alias("illegal"), "cost", "audit",
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# ------------------------------------------------------------------------------------------ trial damage
def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults chosen by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's; NULLs become one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
