"""Packing of documents into training sequences under a token mixture.

Every source is a queue of documents.  A window is one round of deficit round-robin: each queue gives its quantum, its target
share of the window's tokens; what is due but not a whole token is carried to the next window as the queue's deficit.  A document
may be cut, so a queue serves exactly what is due, and the state of every queue before any window follows from running sums: round
``r`` of a queue with quantum ``q`` holds its tokens floor(q*r) to floor(q*(r+1)) - 1.  The running sums are blocked aggregates, so
partitions need not be visited in order and deficits carry across them.  The windows, laid end to end, are cut into sequences;
only the last sequence has padding.
"""
from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_rows, crc, tokenizer_path
from ledgerline.session import staging_path

SEQUENCE = 1024
#: Tokens of a window.
WINDOW = 64 * SEQUENCE
END_ID = 0
#: Blocks of a queue, rounds of a block, and the fixed-point bits of a quantum.
QUEUE_BLOCKS, ROUND_BLOCK, FRACTION = 4096, 256, 10
#: Words kept in a Python worker between batches, and the longest word kept.
CACHE_WORDS, CACHE_CHARS = 400_000, 40

#: A space between two white-space characters, or between one and the end; else no token spans the place before a space.
_JOINED = re.compile(r"\s (?:\s|\Z)")


class ByteTokens(dict):
    """Ids of ``" " + word`` by word, as unsigned 16-bit integers.

    Gives what the ``tokenizers`` library gives for the JSON file of the same vocabulary: texts are cut at its added tokens first, and
    what lies between is encoded with the rank file, whose encoder is faster.  No token of the split pattern spans a space after
    another character, so words are encoded once.
    """

    def __init__(self, path: str, json_path: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_path, "rb") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take white space or stand alone only are not supported")
        self.added = {t["content"]: array("H", [t["id"]]).tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        if max([*ranks.values(), *(t["id"] for t in added)]) > 65535:
            raise ValueError("ids must fit in 16 bits")
        self.encode_plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def raw(self, text: str) -> bytes:
        return array("H", self.encode_plain(text)).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.raw(" " + word)
        if len(word) <= CACHE_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if self.cut is not None and self.cut.search(text):
            return b"".join(self.added[part] if k % 2 else self._plain(part) for k, part in enumerate(self.cut.split(text)) if part)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _JOINED.search(text):
            return self.raw(text)
        first, *words = text.split(" ")
        return self.raw(first) + b"".join(map(self.__getitem__, words))


@lru_cache(maxsize=2)
def tokens(path: str, json_path: str) -> ByteTokens:
    return ByteTokens(path, json_path)


def tokenize_documents(docs: DataFrame, path: str | None = None, json_path: str | None = None) -> DataFrame:
    """``doc_id``, ``source`` (NULL: empty), ``ids`` (unsigned 16-bit, end id included) and ``n``.

    ``path`` is the rank file and ``json_path`` the file that names the added tokens of the same vocabulary.
    """
    path, json_path = path or tokenizer_path("byte_bpe_50k.tiktoken"), json_path or tokenizer_path("byte_bpe_50k.json")
    end = array("H", [END_ID]).tobytes()

    def run(batches):
        for batch in arrow_rows(batches):
            ids = [(tokens(path, json_path).encode(t) if t else b"") + end for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], ["doc_id", "source", "ids", "n"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, ids binary, n bigint")


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("bigint"))


def schedule(lengths: DataFrame, mixture: dict[str, float] | None = None, window: int = WINDOW) -> DataFrame:
    """``row``, ``start``, ``length``, ``round``, ``source`` and ``position`` (in the whole stream) of each run of a document's tokens.

    ``lengths`` has ``row`` (unique), ``doc_id``, ``source`` and ``n``.  ``mixture`` gives target proportions; a source it does not
    name gets its share of all tokens, which is also the default for all.  A queue that has run dry gives nothing more.
    """
    total = lengths.agg(F.sum("n")).first()[0] or 1
    lengths = lengths.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "row"), F.lit(QUEUE_BLOCKS)))
    queue = Window.partitionBy("source")
    share = F.col("held") / F.lit(float(total))
    if mixture:
        target = F.create_map(*[x for k, v in mixture.items() for x in (F.lit(k), F.lit(float(v)))])
        share = F.coalesce(F.try_element_at(target, F.col("source")), share)
    blocks = (lengths.groupBy("source", "block").agg(F.sum("n").alias("in_block"))
              .withColumn("before", F.sum("in_block").over(queue.orderBy("block")) - F.col("in_block"))
              .withColumn("held", F.sum("in_block").over(queue))
              .select("source", "block", "before", F.greatest(F.lit(1), F.round(share * float(window << FRACTION)).cast("bigint")).alias("quantum")))
    inside = Window.partitionBy("source", "block").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = (lengths.withColumn("upto", F.sum("n").over(inside)).join(blocks, ["source", "block"])
              .withColumn("first", F.col("before") + F.col("upto") - F.col("n")))
    due = lambda r: F.shiftright(F.col("quantum") * r, FRACTION)
    round_of = lambda k: _div((k + 1) * (1 << FRACTION) - 1, F.col("quantum"))
    last = F.col("first") + F.col("n") - 1
    runs = (placed.withColumn("round", F.explode(F.sequence(round_of(F.col("first")), round_of(last))))
            .withColumn("from", F.greatest(F.col("first"), due(F.col("round"))))
            .withColumn("to", F.least(last + 1, due(F.col("round") + 1)))
            .filter("to > from")
            .select("row", "source", "round", (F.col("from") - F.col("first")).alias("start"), (F.col("to") - F.col("from")).alias("length"), (F.col("from") - due(F.col("round"))).alias("within")))
    rounds = runs.groupBy("round", "source").agg(F.sum("length").alias("given")).withColumn("group", _div(F.col("round"), ROUND_BLOCK))
    groups = rounds.groupBy("group").agg(F.sum("given").alias("sum"))
    groups = groups.select("group", (F.sum("sum").over(Window.orderBy("group")) - F.col("sum")).alias("base"))
    along = Window.partitionBy("group").orderBy("round", "source").rowsBetween(Window.unboundedPreceding, 0)
    rounds = rounds.withColumn("at", F.sum("given").over(along) - F.col("given")).join(groups, "group").select("round", "source", (F.col("at") + F.col("base")).alias("at"))
    return runs.join(rounds, ["round", "source"]).select("row", "start", "length", "round", "source", (F.col("at") + F.col("within")).alias("position"))


def pack_documents(docs: DataFrame, mixture: dict[str, float] | None = None, window: int = WINDOW, sequence: int = SEQUENCE, path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row per piece of a document: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``source``, ``round``.

    A NULL or empty text is the end id alone; a NULL source is the empty one; repeated rows and NULL ids are packed like any
    others; other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    ids = tokenize_documents(docs, path, json_path).withColumn("row", F.monotonically_increasing_id())
    place = staging_path(spark, "packing-ids")
    ids.write.option("compression", "zstd").parquet(place)
    ids = spark.read.schema(ids.schema).parquet(place)
    runs = schedule(ids.select("row", "doc_id", "source", "n"), mixture, window)
    end = F.col("position") + F.col("length")
    pieces = (runs.withColumn("sequence_id", F.explode(F.sequence(_div(F.col("position"), sequence), _div(end - 1, sequence))))
              .withColumn("low", F.greatest("position", F.col("sequence_id") * sequence))
              .withColumn("high", F.least(end, (F.col("sequence_id") + 1) * sequence))
              .select("row", F.struct((F.col("start") + F.col("low") - F.col("position")).alias("start"), (F.col("high") - F.col("low")).alias("length"), "sequence_id",
                                      (F.col("low") - F.col("sequence_id") * sequence).alias("offset"), "round").alias("piece"))
              .groupBy("row").agg(F.collect_list("piece").alias("pieces")))  # as many as the document is long

    def digest(batches):
        for batch in arrow_rows(batches, 500):
            out = []
            for doc, source, raw, cut in zip(*(batch.column(i).to_pylist() for i in range(4))):
                wide = np.frombuffer(raw, "<u2").astype("<u4")
                out += [(doc, p["start"], p["length"], crc(wide[p["start"] : p["start"] + p["length"]].tobytes()), len(wide), p["sequence_id"], p["offset"], source, p["round"]) for p in cut]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "round"]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)], names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string, round bigint"
    return ids.join(pieces, "row").select("doc_id", "source", "ids", "pieces").mapInArrow(digest, schema)
