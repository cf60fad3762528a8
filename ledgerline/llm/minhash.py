"""Near-duplicate documents by weighted Jaccard similarity of their five-word shingles.

1. Each text gets a BagMinHash signature; equal texts share one class and go on as one.
2. Bands of the signature give buckets.  In each bucket the member that meets most others leads; every text is compared with the
   leader it shares most buckets with.  That joins the bulk of each group of copies by as many comparisons as there are texts.
3. What is left are components that share a bucket.  Buckets are cut into blocks of bounded size; each pair of blocks compares
   signatures inside one task and names only enough pairs of components to connect all those whose estimates are within reach of the
   threshold.  Components so connected form a cluster.
4. The multisets of a cluster are compared exactly, again in pairs of blocks of bounded bytes, by products of incidence matrices; each
   task gives only enough verified links to connect what it found connected.  Neither step makes a row for each pair.

A pair at the threshold is missed in all bands with a probability below 1e-7, and by its estimate with one of 0.02 %, unless other
texts bring the two into one cluster.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.bagminhash import COMPONENTS, mix, signatures
from ledgerline.llm.common import arrow_rows, block_pairs, map_groups, stage, text_slices
from ledgerline.llm.components import components

WORDS, SIMILARITY = 5, 0.8
#: Bands of the signature, components of a band.
BANDS, ROWS = 32, 4
#: Share of equal components from which a pair is verified: 3.5 standard deviations under the threshold.
REACH = 0.8 - 3.5 * (0.8 * 0.2 / COMPONENTS) ** 0.5
#: Texts of a block of a bucket or cluster, bytes of the multisets of a block of a cluster, and shingles of an incidence matrix; a
#: task holds two blocks at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 8_000_000, 2048
#: Words kept in a Python worker.
CACHE_WORDS = 250_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


_hashes = _WordHashes()


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the whole text, and how often each occurs.  A text of fewer words is one shingle; no word, none."""
    if len(_hashes) > CACHE_WORDS:
        _hashes.clear()
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(len(words) - WORDS + 1, 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out = mix(out * _FACTOR + h[k : k + n])
    return np.unique(out, return_counts=True)


def multiset(text: str | None) -> np.ndarray:
    """Sorted hashes of (shingle, how many before it), so that the overlap of two multisets is that of two sets."""
    element, count = shingles(text)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.sort(mix(np.repeat(element, count) + place.astype(np.uint64) * _FACTOR)).astype("<u8")


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``digest`` (of the text) and ``sig`` (NULL without a word) of each row; copies in a batch are signed once."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in arrow_rows(batches):
            texts, digests = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            first = {d: i for i, d in reversed(list(enumerate(digests)))}
            order = sorted(first.values())
            sig = {}
            for a, b in text_slices([texts[i] for i in order]):
                own = order[a:b]
                parts = [shingles(texts[i]) for i in own]
                owner = np.repeat(np.arange(len(own)), [len(e) for e, _ in parts])
                got = [None] * len(own) if not len(owner) else signatures(owner, np.concatenate([e for e, _ in parts]), np.concatenate([c for _, c in parts]), len(own))
                sig |= {digests[i]: s.tobytes() if len(e) else None for i, s, (e, _) in zip(own, got, parts)}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sig[d] for d in digests], pa.binary())], ["doc_id", "digest", "sig"])
        _hashes.clear()  # the worker goes on to other work

    return docs.select("doc_id", _digest(), "text").mapInArrow(run, f"doc_id {kind}, digest binary, sig binary")


def _digest():
    return F.unhex(F.md5("text")).alias("digest")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose multisets overlap enough."""
    left = bags.select(F.col("digest").alias("a"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("digest").alias("b"), F.col("bag").alias("bag_b"))

    def run(batches):
        for batch in arrow_rows(batches, 2000):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                small, large = sorted((len(x), len(y)))
                keep.append(small >= SIMILARITY * large and (n := len(np.intersect1d(x, y, assume_unique=True))) >= SIMILARITY * (len(x) + len(y) - n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a binary, b binary")


class _Joined:
    """Numbers 0 to n - 1 in groups."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def _numbered(values: tuple) -> tuple[np.ndarray, list]:
    code = {v: k for k, v in enumerate(dict.fromkeys(values))}
    return np.array([code[v] for v in values], np.int64), list(code)


def _across(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare with each other: one block with another, or a block with itself."""
    every = np.arange(len(side))
    return (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() else (every, every)


def _connecting(root: np.ndarray, roots: int, left: np.ndarray, right: np.ndarray, near, step: int):
    """Pairs of rows, at most one less than there are roots, that connect all roots joined by near pairs, as stars so that no long chain
    has to be followed later; ``step`` rows of ``left`` at a time."""
    joined = _Joined(roots)
    for at in range(0, len(left), step):
        own = left[at : at + step]
        group = np.array([joined.top(r) for r in range(roots)])
        i, j = np.nonzero(near(own) & (group[root[own]][:, None] != group[root[right]][None, :]))
        for pair in np.unique(group[root[own[i]]] * roots + group[root[right[j]]]).tolist():
            joined.join(*divmod(pair, roots))
    some = np.zeros(roots, np.int64)
    some[root] = np.arange(len(root))
    for r in range(roots):
        if (top := joined.top(r)) != r:
            yield int(some[top]), int(some[r])


def _root_links(members: DataFrame) -> DataFrame:
    """Enough pairs of components to connect those with near signatures.  ``members``: ``band``, ``key``, ``digest``, ``root``, ``sig``, ``blocks``."""

    def compare(key, rows):
        side, roots, sigs = zip(*rows)
        side = np.array(side)
        if len(rows) < 2 or key[2] != key[3] and not 0 < side.sum() < len(side):
            return
        root, names = _numbered(roots)
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), COMPONENTS)
        left, right = _across(side)

        def near(own):
            return (sig[own][:, None, :] == sig[right][None, :, :]).sum(axis=2, dtype=np.uint8) >= np.ceil(COMPONENTS * (REACH + (1 - REACH) / 256))

        yield from ((names[root[i]], names[root[j]]) for i, j in _connecting(root, len(names), left, right, near, max(1, 2_000_000 // (len(right) * COMPONENTS))))

    placed = block_pairs(members, ["band", "key"], "digest", ["root", "sig"])
    return map_groups(placed, ["band", "key", "x", "y"], ["side", "root", "sig"], compare, "a binary, b binary")


def _overlaps(bags: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common elements of each bag of ``left`` with each of ``right``."""
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    _, element, count = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1  # an element of one bag only can't be common
    keep = count[element] > 1
    owner, element = owner[keep], column[element[keep]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(element[-1]) + 1 if len(element) else 0, COLUMNS):
        a, b = np.searchsorted(element, [at, at + COLUMNS])
        held = np.zeros((len(bags), COLUMNS), np.float32)
        held[owner[a:b], element[a:b] - at] = 1
        out += held[left] @ held[right].T
    return out


def _verified_links(members: DataFrame) -> DataFrame:
    """Pairs of components that are connected by verified links, enough to connect all that are.  ``members``: ``cluster``, ``digest``, ``root``, ``bag``, ``blocks``."""

    def compare(key, rows):
        side, roots, bags = zip(*rows)
        side = np.array(side)
        if len(rows) < 2 or key[1] != key[2] and not 0 < side.sum() < len(side):
            return
        root, names = _numbered(roots)
        if len(names) < 2:
            return
        bags = [np.frombuffer(b, "<u8") for b in bags]
        size = np.array([len(b) for b in bags], np.float64)
        left, right = _across(side)
        both = _overlaps(bags, left, right)
        place = np.zeros(len(bags), np.int64)
        place[left] = np.arange(len(left))

        def near(own):
            common = both[place[own]]
            return common >= SIMILARITY * (size[own][:, None] + size[right][None, :] - common)

        yield from ((names[root[i]], names[root[j]]) for i, j in _connecting(root, len(names), left, right, near, 128))

    placed = block_pairs(members, ["cluster"], "digest", ["root", "bag"])
    return map_groups(placed, ["cluster", "x", "y"], ["side", "root", "bag"], compare, "a binary, b binary")


def near_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts with their group, and the rows of each class.

    First: ``digest`` and ``root`` (a digest) of each class that has a near copy.  Second: ``doc_id`` and ``digest`` of each row; the
    digest is NULL if the text has no word.
    """
    signed = stage(_signed(docs), "minhash-rows")
    classes = stage(signed.filter("sig is not null").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.any_value("sig").alias("sig")), "minhash-classes")
    bands = classes.select("digest", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.substring("sig", b * ROWS + 1, F.lit(ROWS)))).alias("band", "key"))
    shared = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stage(bands.join(shared, ["band", "key"]), "minhash-members")
    meets = stage(members.groupBy("digest").agg(F.sum("size").alias("meets")), "minhash-involved")
    bags = _bags(docs, classes.join(meets, "digest", "left_semi"))
    ranked = members.join(meets, "digest")
    leaders = ranked.groupBy("band", "key").agg(F.max(F.struct("meets", "digest")).alias("lead"))
    to_lead = (members.join(leaders, ["band", "key"]).filter(F.col("lead.digest") != F.col("digest"))
               .groupBy("digest", "lead").agg(F.count(F.lit(1)).alias("bands"))
               .groupBy(F.col("digest").alias("a")).agg(F.max(F.struct("bands", "lead")).alias("best")).select("a", F.col("best.lead.digest").alias("b")))
    links = stage(_verified(to_lead, bags), "minhash-links")
    roots = components(links).select(F.col("node").alias("digest"), "root")
    rooted = stage(members.join(roots, "digest", "left").select("band", "key", "digest", F.coalesce("root", "digest").alias("root")), "minhash-rooted")
    mixed = (rooted.groupBy("band", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
             .filter("low <> high").select("band", "key", F.ceil(F.col("size") / BLOCK).alias("blocks")))
    left = rooted.join(mixed, ["band", "key"]).join(classes.select("digest", "sig"), "digest")
    near = components(stage(_root_links(left), "minhash-near-roots")).select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    clustered = meets.select("digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")).join(near, "root")
    clustered = stage(clustered.join(bags, "digest"), "minhash-clusters")
    size = clustered.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("bag")) / BLOCK_BYTES)).alias("blocks"))
    more = stage(_verified_links(clustered.join(size, "cluster")), "minhash-links")
    top = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))  # a graph of components, not of texts
    joined = roots.join(top, "root", "left").select("digest", F.coalesce("top", "root").alias("root"))
    alone = top.join(roots.select(F.col("digest").alias("root")), "root", "left_anti").select(F.col("root").alias("digest"), F.col("top").alias("root"))
    return joined.unionByName(alone), signed.select("doc_id", F.when(F.col("sig").isNotNull(), F.col("digest")).alias("digest"))


def _bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``digest`` and ``bag`` of the wanted classes, from one row of each class."""

    def run(batches):
        for batch in arrow_rows(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([multiset(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["digest", "bag"])
        _hashes.clear()

    picked = wanted.select(F.col("digest").alias("__d"), F.col("doc").alias("__i"))
    rows = docs.select("doc_id", _digest(), "text")
    one = rows.join(picked, (rows["digest"] == picked["__d"]) & rows["doc_id"].eqNullSafe(picked["__i"]), "left_semi").select("digest", "text")
    return stage(one.mapInArrow(run, "digest binary, bag binary").dropDuplicates(["digest"]), "minhash-bags")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id with this text), ``component_id`` (smallest id reachable by links) and ``kept`` of each row.

    Equal texts are one class.  Rows whose text is NULL, empty or without a word link with nothing.  NULL ids take part but never
    name a class or group unless all its ids are NULL.  Repeated rows are all kept if their id names the group.
    """
    groups, rows = near_groups(docs)
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(groups, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = classes.join(classes.groupBy("root").agg(F.min("class_id").alias("component_id")), "root").select("digest", "class_id", "component_id")
    own = lambda c: F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    out = rows.join(stage(named, "minhash-named"), "digest", "left").select("doc_id", own("class_id"), own("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near copies: of each group the row with the smallest id stays.

    A NULL id stays only where a group has no other; of equal rows one stays.  Rows whose text has no word all stay.
    """
    groups, rows = near_groups(docs)
    rows = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = rows.join(groups, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("no_id"), "first", "digest")).alias("best"))
    best = stage(best.select(F.col("best.digest").alias("__d"), F.col("best.first").alias("__i")), "minhash-best")
    tagged = docs.withColumn("__digest", _digest())
    kept = tagged.join(best, (F.col("__digest") == F.col("__d")) & F.col("doc_id").eqNullSafe(F.col("__i")), "left_semi")
    one = Window.partitionBy("__digest").orderBy("doc_id")
    kept = kept.withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n", "__digest")
    bare = docs.filter(F.coalesce(~F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True)))
    return kept.unionByName(bare)
