"""SentencePiece BPE encoding by suffix-array matching, and decoding.

The distinct words of a batch are put end to end and their suffixes sorted.
Binary search gives each piece its range of suffixes, so all places where it
occurs.  These edges are sorted by their end and relaxed from left to right:
an edge joins the encoding of what stands before it if the piece at its end
and the edge's own piece stay apart when they are encoded together.  For BPE
exactly one edge into each position does, and the pieces on the way to a
word's end are its encoding.

Long words are first cut wherever no piece holds the two neighbouring
characters: no merge can cross there.  Edges are relaxed for all words at once,
but in parts that stay long one position after the other.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import bound_batches, split_batch, tidy

SPACE = "▁"
#: A word: spaces, then everything up to the next space.  No piece has a space after another character.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
CACHE_WORDS = 500_000
LONGEST_CACHED = 64
#: Characters above which a part of a word is relaxed on its own, and positions whose suffixes are sorted at once.
LONG_PART = 512
POSITIONS = 1 << 20
UNKNOWN = -1


class Codec:
    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = self.sp.get_piece_size()
        special = [self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i) for i in range(n)]
        self.pieces = [self.sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.score = {i: self.sp.get_score(i) for i in self.ids.values()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.sp.is_byte(i)}
        byte_of = {i: b for b, i in self.bytes.items()}
        #: What each id decodes to.
        self.raw = [bytes([byte_of[i]]) if i in byte_of else p.encode() for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids))
        # In the order of their characters, so that they are searched for in ascending order.
        by_text = sorted(self.ids)
        self.names = np.array([self.ids[p] for p in by_text], np.int64)
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.points = np.zeros((len(self.names), self.longest), np.uint32)
        for row, p in zip(self.points, by_text, strict=True):
            row[: len(p)] = [ord(c) for c in p]
        self._learn_merges(n)
        #: Pairs of characters that stand together in some piece.
        self.inner = np.unique(np.array([ord(x) << 21 | ord(y) for p in self.ids for x, y in zip(p, p[1:], strict=False)], np.int64))
        self.cache: dict[str, bytes] = {}
        self.apart: dict[int, bool] = {}

    def _learn_merges(self, n: int) -> None:
        """When each piece is made (0 for a character), its two parts, and all pairs of pieces that make one."""
        self.usable = np.zeros(n, bool)
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.made = np.zeros(n, np.int64)
        ids = [i for p, i in self.ids.items() if len(p) > 1]
        _, turn = np.unique([-self.score[i] for i in ids], return_inverse=True)
        self.made[ids] = turn + 1
        pairs = {}
        for p, i in self.ids.items():
            last: list[str] = []
            self.usable[i] = self.merge(p, last) == [i]
            if self.usable[i] and last:
                self.left[i], self.right[i] = (self.ids[q] for q in last)
            for k in range(1, len(p)):
                x, y = self.ids.get(p[:k]), self.ids.get(p[k:])
                if x is not None and y is not None:
                    pairs[x << 24 | y] = self.made[i]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[c] for c in self.pairs.tolist()], np.int64)

    def merge(self, text: str, last: list[str] | None = None) -> list[int]:
        """Pieces by merging, best pair first; for short strings.  ``last`` gets the two parts that merged last."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return [self.ids.get(p, UNKNOWN) for p in parts]
            if last is not None:
                last[:] = parts[at : at + 2]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a; a = -2 is a word's start, -1 an unknown character."""
        out = (b == UNKNOWN) | self.usable[b]
        both = np.flatnonzero(out & (a >= 0) & (b >= 0))
        code, at = np.unique(a[both] << 24 | b[both], return_inverse=True)
        out[both] = self._no_merge_across(code >> 24, code & 0xFFFFFF)[at]
        return out

    def _no_merge_across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the border of pieces a and b.

        The merges that made the two are undone, latest first.  A pair at the
        border that would merge before the one undone last would have crossed.
        """
        out = np.ones(len(a), bool)
        row, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(row):
            code = a << 24 | b
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            cross = (self.pairs[at] == code) & (self.pair_made[at] < limit)
            out[row[cross]] = False
            on = ~cross & ((self.made[a] > 0) | (self.made[b] > 0))
            row, a, b = row[on], a[on], b[on]
            made_a, made_b = self.made[a], self.made[b]
            undo_a = made_a > made_b
            # Of equal merges the one further left goes first.
            limit = np.where(undo_a, made_a, made_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return out

    @functools.cached_property
    def _merge_tables(self):
        return dict(zip(self.pairs.tolist(), self.pair_made.tolist(), strict=True)), self.made.tolist(), self.left.tolist(), self.right.tolist()

    def _stays_apart(self, a: int, b: int) -> bool:
        """``stay_apart`` for two pieces, remembered."""
        code = a << 24 | b
        known = self.apart.get(code)
        if known is None:
            if len(self.apart) > 4 * CACHE_WORDS:
                self.apart.clear()
            known = self.apart[code] = self._one_border(a, b)
        return known

    def _one_border(self, a: int, b: int) -> bool:
        turns, made, left, right = self._merge_tables
        limit = 1 << 62
        while True:
            turn = turns.get(a << 24 | b)
            if turn is not None and turn < limit:
                return False
            if made[a] > made[b]:
                limit, a = made[a], right[a]
            elif made[b] > 0:
                limit, b = made[b] + 1, left[b]
            else:
                return True

    def parts(self, word: str) -> list[str]:
        """A long word cut where no merge can cross."""
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        code = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.inner, code), len(self.inner) - 1)
        cuts = [0, *(np.flatnonzero(self.inner[at] != code) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _match(self, words: list[str]):
        """(start, end, piece) of every occurrence of every piece, and the words' offsets."""
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(w) for w in words])
        offset = np.concatenate([[0], np.cumsum(size)])
        chars, rank = np.unique(text, return_inverse=True)
        # Windows of ranks: 0 is past the word's end, the highest value above any character.
        unit = ">u1" if len(chars) < 0xFE else ">u2" if len(chars) < 0xFFFE else ">u4"
        top = np.iinfo(np.dtype(unit)).max
        n, width = len(text), -(-self.longest // 8) * 8
        left = np.repeat(offset[1:], size) - np.arange(n)
        rank = np.concatenate([rank + 1, np.zeros(self.longest, rank.dtype)]).astype(unit)
        at = np.minimum(np.searchsorted(chars, self.points), len(chars) - 1)
        here = (chars[at] == self.points) | (self.points == 0)
        whole = here.all(axis=1)
        names = self.names[whole]
        low = np.zeros((len(names), width), unit)
        low[:, : self.longest] = np.where(self.points[whole] == 0, 0, at[whole] + 1)
        high = np.where(np.arange(width) < self.length[names][:, None], low, np.array(top, unit)).astype(unit)
        starts, pieces = [], []
        for a in range(0, n, POSITIONS):
            b = min(a + POSITIONS, n)
            room = np.zeros((b - a, width), unit)
            for j in range(self.longest):
                room[:, j] = np.where(left[a:b] > j, rank[a + j : b + j], 0)
            keys = room.view(f"S{room.strides[0]}").ravel()
            halves = room.view(">u8").astype(np.uint64)
            order = np.lexsort([halves[:, k] for k in reversed(range(halves.shape[1]))])
            keys = keys[order]
            lo = np.searchsorted(keys, low.view(keys.dtype).ravel(), side="left")
            hi = np.searchsorted(keys, np.ascontiguousarray(high).view(keys.dtype).ravel(), side="right")
            number = hi - lo
            within = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            starts.append(a + order[np.repeat(lo, number) + within])
            pieces.append(np.repeat(names, number))
        start, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, pieces))
        length = self.length[piece]
        known = np.zeros(n, bool)
        known[start[length == 1]] = True
        odd = np.flatnonzero(~known)
        return np.concatenate([start, odd]), np.concatenate([start + length, odd + 1]), np.concatenate([piece, np.full(len(odd), UNKNOWN)]), offset, text

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        if not words:
            return []
        start, end, piece, offset, text = self._match(words)
        owner = np.searchsorted(offset, start, side="right") - 1
        # The piece that ends at each position of the encoding of the word so far; position 0 of a word is its start.
        last = np.full(len(text) + 1, -3, np.int64)
        came = np.zeros(len(text) + 1, np.int64)
        far = np.diff(offset)[owner] > LONG_PART
        if far.any():
            self._relax_in_turn(start[far], end[far], piece[far], offset[owner[far]], last, came)
            start, end, piece, owner = (x[~far] for x in (start, end, piece, owner))
        step = end - offset[owner]
        by = np.argsort(step, kind="stable")
        start, end, piece, owner, step = (x[by] for x in (start, end, piece, owner, step))
        cut = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cut.tolist()] if len(step) else [], [*cut.tolist(), len(step)] if len(step) else [], strict=True):
            s, p = start[a:b], piece[a:b]
            before = np.where(s == offset[owner[a:b]], -2, last[s])
            fit = before != -3
            fit[fit] = self.stay_apart(before[fit], p[fit])
            last[end[a:b][fit]] = p[fit]
            came[end[a:b][fit]] = s[fit]
        # Back from the ends of all words at once.
        on = np.zeros(len(text) + 1, bool)
        at, first = offset[1:], offset[:-1]
        while len(at):
            on[at] = True
            at = came[at]
            more = at > first
            at, first = at[more], first[more]
        at = np.flatnonzero(on)
        ids = last[at]
        number = np.ones(len(at), np.int64)
        odd = np.flatnonzero(ids == UNKNOWN)
        spelt = [self._spell(chr(c)) for c in text[at[odd] - 1].tolist()]
        number[odd] = [len(s) for s in spelt]
        flat = np.repeat(ids, number)
        flat[flat == UNKNOWN] = [i for s in spelt for i in s]
        data = flat.astype("<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(number)])[np.searchsorted(at, offset, side="right")] * 4
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _relax_in_turn(self, start, end, piece, first, last, came) -> None:
        """The same as relaxing all words at once, for few long ones."""
        by = np.argsort(end, kind="stable")
        usable, low = self.usable, int(first.min())
        held = [-3] * (int(end.max()) - low + 1)
        for s, e, p, f in zip(*(x[by].tolist() for x in (start, end, piece, first)), strict=True):
            before = -2 if s == f else held[s - low]
            if before != -3 and (p == UNKNOWN or (usable[p] and (before < 0 or self._stays_apart(before, p)))):
                held[e - low] = p
                last[e], came[e] = p, s

    def _spell(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace")] if self.bytes else [self.sp.unk_id()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_normal([self.sp.normalize(t) for t in texts])

    def encode_normal(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts in normal form."""
        split = [_WORD.findall(t) for t in texts]
        used = set().union(*split)
        new = list(used - self.cache.keys())
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(used)
        # Parts of the long words go with the other words.
        short, long = [], []
        for w in new:
            (short if len(w) <= LONGEST_CACHED else long).append(w)
        cut = [self.parts(w) for w in long]
        found = self.encode_words([*short, *itertools.chain.from_iterable(cut)])
        self.cache.update(zip(short, found, strict=False))
        at = len(short)
        for w, parts in zip(long, cut, strict=True):
            self.cache[w] = b"".join(found[at : at + len(parts)])
            at += len(parts)
        out = [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<i4") for words in split]
        for w in long:
            del self.cache[w]
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def codec_of(model_path: str) -> Codec:
    """One codec for all tasks of a worker."""
    return Codec(model_path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids, ids_crc32, round_trip (whether decoding gives the text's normal form).

    Null text is empty and has no ids; repeated rows and null ids get a row
    each; very long texts, with or without spaces, are encoded whole; an empty
    table gives no rows; other columns, whatever their names, are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        codec = codec_of(model_path)
        for batch in batches:
            for part in split_batch(batch, "_text", 6 << 20):
                texts = [t or "" for t in part.column(1).to_pylist()]
                normal = [codec.sp.normalize(t) for t in texts]
                ids = codec.encode_normal(normal)
                same = [codec.decode(i.tolist()) == t.replace(SPACE, " ")[1:] for i, t in zip(ids, normal, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
                crc = pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, crc, pa.array(same, pa.bool_())], names=["doc_id", "ids", "ids_crc32", "round_trip"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids array<int>, ids_crc32 long, round_trip boolean")
