"""SentencePiece encoding and decoding of whole documents."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import arrow_rows, text_slices, tokenizer_path
from ledgerline.llm.piece_bpe import model

DEFAULT_MODEL = "piece_bpe_32k.model"


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` (little-endian unsigned 32-bit, with begin and end ids) and ``n_tokens`` of each row.

    A NULL or empty text gives the begin and end ids only; repeated rows and NULL ids are kept; other columns are ignored; an
    empty table gives no row.  Texts are encoded whole, in slices of bounded size.
    """
    path = model_path or tokenizer_path(DEFAULT_MODEL)

    def run(batches):
        for batch in arrow_rows(batches):
            texts = batch.column(1).to_pylist()
            ids = [x for a, b in text_slices(texts) for x in model(path).encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint")


def decode_documents(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """``doc_id`` and decoded ``text`` of the rows of :func:`encode_documents`; NULL ids decode to an empty text."""
    path = model_path or tokenizer_path(DEFAULT_MODEL)

    def run(batches):
        for batch in arrow_rows(batches):
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_decode(path, raw), pa.string())], ["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digest_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per row: ``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, with encoding and decoding in one pass over the text."""
    path = model_path or tokenizer_path(DEFAULT_MODEL)

    def run(batches):
        for batch in arrow_rows(batches):
            texts = batch.column(1).to_pylist()
            ids, back = [], []
            for a, b in text_slices(texts):
                part = model(path).encode(texts[a:b])
                ids += [(len(x) // 4, hashlib.sha256(x).hexdigest()) for x in part]
                back += [hashlib.sha256(x.encode()).hexdigest() for x in _decode(path, part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in ids], pa.int64()), pa.array([h for _, h in ids], pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _decode(path: str, raw: list[bytes]) -> list[str]:
    lengths = np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw))
    return model(path).decode(np.frombuffer(b"".join(raw), "<u4"), lengths)
