import base64
import random
import time
import zlib

import numpy as np
import pytest
import sentencepiece

from slabscan.llm import queries
from slabscan.llm.sentencepiece_codec import Codec, encode

TEXTS = ["", None, " ", "   ", "  Hello  world\n\n foo\tbar é ﬁ ① ", "a▁b", "日本語 text 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "z" * 3000, "The internationalisation of antidisestablishmentarianism."]


def test_same_as_library(spark):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [t or "" for t in [*TEXTS, *more]]
    for _ in range(2):
        for text, ids in zip(texts, codec.encode(texts), strict=True):
            assert ids.tolist() == sp.encode(text)
            assert codec.decode(ids.tolist()) == sp.decode(ids.tolist())


def test_cases(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (1, None, 1)], "doc_id long, text string, ids int")
    rows = encode(docs, queries.tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(rows) == len(TEXTS) + 2 and all(r.round_trip for r in rows)
    assert encode(docs.limit(0), queries.tokenizer_file("piece_bpe_32k.model")).collect() == []
    assert np.array(next(r.ids for r in rows if r.doc_id == 0)).size == 0


RANDOM = random.Random(1)
LONG = {
    "all characters": "".join(map(chr, (x for x in range(32, 0x20000) if not 0xD800 <= x < 0xE000))),
    "no spaces": base64.b64encode(RANDOM.randbytes(3_000_000)).decode(),
    "ideographs": "".join(chr(RANDOM.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000)),
    "one letter": "z" * 100_000,
    "common letters": "".join(RANDOM.choice("etaoinshrdlu") for _ in range(200_000)),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_long_words(name):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    start = time.time()
    ids = codec.encode([LONG[name]])[0].tolist()
    assert time.time() - start < 30
    assert ids == sp.encode(LONG[name])


def test_random_strings():
    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp, codec = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdeinrst ▁é日\n.") for _ in range(rng.randrange(2000))) for _ in range(200)]
    assert [i.tolist() for i in codec.encode(texts)] == [sp.encode(t) for t in texts]


def test_query(spark):
    """Every row of the query against the library."""
    sf = "/root/testdata/sf0.01"
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(sp.encode(texts[r.doc_id]), "<i4")
        assert (r.n_ids, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(ids.tobytes()), True)
