"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each document is tokenised once and cut: full windows first, then what is
left over in pieces of at most ``piece_tokens``.  A full window is a sequence
of its own.  The other pieces are dealt at random into blocks of a bounded
number of pieces, and each block is split into near-equal windows: partial
partitions are merged, largest difference first, the fullest windows of one
with the emptiest of the other.  While a window exceeds the capacity, the
block's number of windows rises and the differencing runs again.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import split_batch, stored, tidy

CAPACITY = 2048
PIECE_TOKENS = 512
BLOCK_PIECES = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters on whose class the two encoders might not agree: all but plain ASCII, Latin letters and common punctuation.
ODD = "[^\t\n\r -~\u00a1-\u024f\u2010-\u2027\u20ac]"


class TokenIds:
    """Little-endian unsigned 32-bit ids of texts, as the tokeniser file has them.

    Texts of plain characters go through the rank encoder when ``ranks_path``
    names the same vocabulary as ranks: it gives the same ids several times
    faster.  All others, and any with a special token's text, go through the
    tokeniser itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str = PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.ranks = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([ODD, *special]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.ranks is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        out = []
        for text in texts:
            if self.odd.search(text):
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes())
        return out


def cuts(n: int, capacity: int, piece_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    full = n - n % capacity
    out = [(s, capacity) for s in range(0, full, capacity)]
    return out + [(s, min(piece_tokens, n - s)) for s in range(full, n, piece_tokens)]


def token_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece_tokens: int = PIECE_TOKENS) -> DataFrame:
    """A row for each piece of each document, with the checksum of its ids."""

    def run(batches):
        ids_of = TokenIds(tokenizer_path, ranks_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for part in split_batch(batch, "text", 1 << 20):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), ids_of([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    rows += [(doc, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n) for s, k in cuts(n, capacity, piece_tokens)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), PIECES)


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size, by Karmarkar-Karp differencing into ``windows`` sums."""
    n = len(sizes)
    sums: list = [None] * (2 * n - 1)
    children: list = [None] * (2 * n - 1)
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-int(s), i))
    heapq.heapify(heap)

    def dense(i: int) -> np.ndarray:
        """Sums in descending order; a single size stands in the first window."""
        if sums[i] is None:
            out = np.zeros(windows, np.int64)
            out[0] = sizes[i]
            return out
        return sums[i]

    for k in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = dense(a) + dense(b)[::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        total -= total[-1]
        sums[a] = sums[b] = None
        sums[k], children[k] = total, (a, b, order)
        heapq.heappush(heap, (-int(total[0]), k))
    place = np.zeros(n, np.int64)
    # Windows of the root are numbered as they are; each merge tells which window of its parts lies in which.
    stack = [(2 * n - 2, np.arange(windows))]
    while stack:
        i, names = stack.pop()
        if children[i] is None:
            place[i] = names[0]
            continue
        a, b, order = children[i]
        at = np.empty(windows, np.int64)
        at[order] = names
        stack += [(a, at), (b, at[::-1])]
    return place


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; no window holds more than the capacity."""
    if len(sizes) == 0:
        return np.zeros(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("a piece exceeds the capacity")
    windows, step = max(1, -(-int(sizes.sum()) // capacity)), 1
    while True:
        place = differencing(sizes, windows)
        if np.bincount(place, weights=sizes, minlength=windows).max() <= capacity:
            return place
        windows = min(len(sizes), windows + step)
        step += 1


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece_tokens: int = PIECE_TOKENS, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone.  Rows that share a doc_id, or
    have none, are packed as documents of their own; pieces of equal length
    stand in the order of their rows.  Very long texts are tokenised whole.
    Other columns, whatever their names, are ignored, and an empty table gives
    no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer_path, ranks_path, id_col, text_col, capacity, piece_tokens).withColumn("_row", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") == capacity).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, -(-rest.count() // block_pieces))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
        place = pack_block(pdf["length"].to_numpy(), capacity)
        pdf["sequence_id"] = 2 * ((int(key[0]) << 31) + place)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns=["_row", "_block"])

    dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    packed = dealt.groupBy("_block").applyInPandas(one, PIECES + ", sequence_id long, offset long")
    return full.unionByName(packed)
