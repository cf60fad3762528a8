"""Secrets in whole texts: keyword automaton, anchored patterns near its hits, checksums embedded in tokens.

One Aho-Corasick pass over the lower-cased text finds the places where a keyword starts; patterns run anchored there only.
Hexadecimal runs have no keyword and are found by their own run pattern.  Tokens whose last characters are a checksum of the rest
count only if it is right.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import arrow_rows, lower_in_place

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm")

# Keywords and token formats that are searched for.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile("AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile("[0-9a-f]{24,}")
CHECKED = {"github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile("gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z_])")),
           "npm": (("npm_",), re.compile("npm_([0-9A-Za-z]{36})(?![0-9A-Za-z_])"))}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), *((k, w) for k, (w, _) in CHECKED.items())):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of the kind in :data:`KINDS`, end) of each secret, in order; code points, end exclusive.

    Spans of a kind do not overlap; the leftmost is taken first, and a match that is too short still uses up its characters.
    """
    if not text:
        return []
    spans, free = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - size + 1, kind) for end, (kind, size) in _automaton().iter(lower_in_place(text)))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m is not None and len(m[2]) >= ASSIGN_LEAST
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m is not None and m.end() - start >= ACCESS_LEAST
        else:
            m = CHECKED[kind][1].match(text, start)
            good = m is not None and m[1][30:] == checksum62(m[1][:30])
        if m is not None:
            free[kind] = m.end()
            if good:
                spans.append((start, KINDS.index(kind), m.end()))
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end) of each row.

    A NULL or empty text has no span; NULL ids and repeated rows are kept; other columns are ignored; an empty table gives no row.
    """
    kind = dict(docs.dtypes)["doc_id"]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in arrow_rows(batches):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def brute_spans(text: str | None) -> str:
    """The base kinds by plain scans of the whole text; what tests compare with."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return joined(sorted(spans))


def base_digest(text_spans: str) -> str:
    return hashlib.sha256(text_spans.encode()).hexdigest()
