import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from slabscan.llm import queries
from slabscan.llm.packing import CAPACITY, ODD, TokenIds, cuts, differencing, pack, pack_block

TEXTS = ["", None, "a b", " lead", "trail ", "two  spaces", "x \n y", "a b  c", "it's <|endoftext|> here", "tab\t x", "naïve 日本 語 🙂 x", "word " * 9000, "z" * 50_000]


def reference(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("ranks", [None, "byte_bpe_50k.tiktoken"])
def test_ids(spark, ranks):
    ids_of = TokenIds(queries.tokenizer_file("byte_bpe_50k.json"), ranks and queries.tokenizer_file(ranks))
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    odd = ["a\x85b \x1c c", "\u200b x\u3000y", "½ ² x²", "don't 'S 'll", "a\xa0b", "ǅ ʰ ª º µ", "\r\n\r\n x"]
    texts = [*TEXTS, *more, *odd]
    for text, ids in zip(texts, ids_of([t or "" for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text)[:-1]


def test_differencing_is_close_to_equal():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 700)
    place = differencing(sizes, 90)
    sums = np.bincount(place, weights=sizes, minlength=90)
    assert sums.max() - sums.min() < 40 and sums.sum() == sizes.sum()


@pytest.mark.parametrize("sizes", [[], [5], [2048] * 3, [1025] * 7, [2047, 1, 1, 2047], [1] * 5000])
def test_pack_block(sizes):
    place = pack_block(np.array(sizes, dtype=np.int64))
    assert len(place) == len(sizes) and (not sizes or np.bincount(place, weights=sizes).max() <= CAPACITY)


def check_pieces(rows, ids_of):
    """Each id of each document in one piece; sequences gapless and within the capacity."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, pieces in docs.items():
        ids, at = ids_of(doc), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= CAPACITY
    return docs, sequences


def test_pack(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, _row int").repartition(3)
    rows = pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("byte_bpe_50k.tiktoken"), block_pieces=5).collect()
    found, _ = check_pieces(rows, lambda i: reference(TEXTS[i]))
    assert sorted(found) == list(range(len(TEXTS)))
    again = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    rows = pack(again, queries.tokenizer_file("byte_bpe_50k.json")).collect()
    assert sorted(repr(r.doc_id) for r in rows) == ["1", "1", "None"] and len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert pack(docs.limit(0), queries.tokenizer_file("byte_bpe_50k.json")).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_packing(spark, sf).collect()
    found, sequences = check_pieces(rows, lambda i: reference(texts[i]))
    assert found.keys() == texts.keys()
    assert sum(r.length for r in rows) / (CAPACITY * len(sequences)) > 0.97


def test_cuts():
    assert cuts(5000, 2048, 512) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 392)]


def test_plain_texts_have_the_same_ids_by_both_encoders():
    """Random strings over the alphabet that the rank encoder may take."""
    both = [TokenIds(queries.tokenizer_file("byte_bpe_50k.json"), ranks) for ranks in (None, queries.tokenizer_file("byte_bpe_50k.tiktoken"))]
    rng = random.Random(12)
    plain = [c for c in map(chr, range(0x20AD)) if not re.match(ODD, c)]
    common = "aeinrst'  \n\t.,0123456789é“”"
    texts = ["".join(rng.choice(plain) if rng.random() < 0.3 else rng.choice(common) for _ in range(rng.randrange(1, 60))) for _ in range(40_000)]
    assert len(plain) > 500 and not any(both[1].odd.search(t) for t in texts)
    assert both[0](texts) == both[1](texts)
