import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import tokenizers

from ledgerline.llm import packing
from ledgerline.llm.common import tokenizer_path
from tests.llm.test_tokenize import EDGE, random_texts


def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_ids_equal_the_library():
    texts = [t for t in EDGE + random_texts(4000) + ["a  b", "a   b", "a\n b", "a \nb", "a\n \nb", "x \t y ", "it's we'll", "<|endoftext|> a", "\n ", " \n",
                                                    "hello <|endoftext|> x", "a<|endoftext|><|endoftext|>  b", "<|endoftext|>", "<|endoftext| >", "x\n <|endoftext|>\n", "<|endoftext|>  "] if t]
    own = packing.tokens(tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_path("byte_bpe_50k.json"))
    got = [np.frombuffer(own.encode(t), "<u2").tolist() for t in texts]
    assert got == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, window, sequence, target=None):
    lib, want = library(), Counter()
    ids_of = {}
    for i, t, s in docs:
        ids = (lib.encode(t, add_special_tokens=False).ids if t else []) + [0]
        want[i] += 1
        ids_of[i] = (np.array(ids, "<u4"), s or "")
    by_doc, by_seq, given = defaultdict(list), defaultdict(list), defaultdict(Counter)
    for r in rows:
        ids, source = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids) and r.source == source
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
        given[r.round][source] += r.length
    for i, parts in by_doc.items():
        cover = Counter(k for a, n in parts for k in range(a, a + n))
        assert cover == Counter({k: want[i] for k in range(len(ids_of[i][0]))})
    assert set(by_doc) == set(want)
    total = sum(n for parts in by_doc.values() for _, n in parts)
    for s, parts in by_seq.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == sequence or s == max(by_seq) and at == total - s * sequence
    assert sorted(by_seq) == list(range(len(by_seq)))
    held = Counter()
    for i, k in want.items():
        held[ids_of[i][1]] += k * len(ids_of[i][0])
    for s, n in held.items():  # every window up to a queue's end has its share, to a token
        q, done = window * (target or {}).get(s, n / total), 0
        for r in range(max(given) + 1):
            done += given[r][s]
            assert abs(done - min(n, q * (r + 1))) <= 2 + q * 1e-2, (s, r)


def test_every_token_once_and_mixture_held(spark):
    rnd = random.Random(2)
    words = ["alpha", "beta,", "gamma", "é", "\n", "x1", "delta.", ""]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 40, 900]))), rnd.choice(["hot", "hot", "hot", "b", "c", None])) for i in range(150)]
    docs += [(150, None, "b"), (None, "no id", "c"), (151, "same", "hot"), (151, "same", "hot"), (152, "z " * 6000, "b"), (153, "end <|endoftext|> of <|endoftext|>", "b")]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id bigint, text string, source string, length int")
    check(packing.pack_documents(df, window=512, sequence=128).collect(), docs, 512, 128)
    mix = {"hot": 0.2, "b": 0.6}
    check(packing.pack_documents(df, mix, window=512, sequence=128).collect(), docs, 512, 128, mix)
    assert packing.pack_documents(df.limit(0)).count() == 0
