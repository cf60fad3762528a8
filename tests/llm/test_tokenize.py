import hashlib
import random
import time

import numpy as np
import pytest
import sentencepiece

from ledgerline.llm import tokenize
from ledgerline.llm.common import tokenizer_path
from ledgerline.llm.piece_bpe import model

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n, seed=3):
    rnd = random.Random(seed)
    plain = "ab  ▁\n\t\x00éñ中文ЖعKſ😀’=#*AKIA09 the ing aaa"
    wide = lambda: chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0xA0, 0x24FF), rnd.randint(0x3000, 0x9FFF), rnd.randint(0x10000, 0x1F9FF)]))
    return ["".join(rnd.choice(plain) if i % 2 else wide() for _ in range(rnd.randint(0, 60))) for i in range(n)]


EDGE = ["", " ", "  ", "▁", "a" * 3000, " " * 100, " " * 37 + "x" + " " * 16, "=" * 500, "中文" * 500, "the the  the", "<s>", "</s>", "<0x0A>", "word " * 20000]


def test_ids_and_text_equal_the_library(library):
    texts = EDGE + random_texts(3000)
    got = [np.frombuffer(x, "<u4").tolist() for x in model(PATH).encode(texts)]
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert got == want
    back = model(PATH).decode(np.array([i for x in want for i in x]), np.array([len(x) for x in want]))
    assert back == [library.decode(x) for x in want]


def test_decoding_any_ids_equals_the_library(library):
    rnd = random.Random(5)
    for _ in range(400):
        ids = [rnd.choice([rnd.randint(0, 31999), rnd.randint(0, 258)]) for _ in range(rnd.randint(0, 14))]
        assert model(PATH).decode(np.array(ids, np.int64), np.array([len(ids)])) == [library.decode(ids)]


def test_query_rows(spark, library):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "y"), (None, "abc", "z"), (3, None, None), (4, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(map(tuple, tokenize.digest_documents(docs).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert tokenize.digest_documents(docs.limit(0)).count() == 0
    back = tokenize.decode_documents(tokenize.encode_documents(docs)).collect()
    assert sorted((r.text for r in back)) == sorted(t or "" for _, t, _ in rows)


def test_very_long_words_in_time_that_grows_with_them(library):
    rnd = random.Random(6)
    letters = lambda n, of: "".join(rnd.choice(of) for _ in range(n))
    long = ["the" * 70_000, letters(200_000, "abcdefghijklmnopqrstuvwxyz"), "x " + letters(5000, "theing") + " " + letters(2047, "the") + " y", letters(3000, "中ЖaKſ😀\n▁"), "=" * 9000, letters(2049, "aé")]
    start = time.time()
    got = [np.frombuffer(x, "<u4").tolist() for x in model(PATH).encode(long)]
    assert time.time() - start < 30
    assert got == library.encode(long, add_bos=True, add_eos=True)
