"""Removal of byte strings that occur anywhere else, by hash-compared suffix sorting around anchors.

Anchors are chosen by content: of each string of ``LENGTH`` bytes, the
position whose next ``GRAM`` bytes hash lowest.  Equal strings have equal
anchors, so only anchors whose gram occurs again matter, and two strings are
compared around them.  The context of an anchor holds all strings of that
length that contain its gram.  Equal contexts, which 160 bits of two
independent hashes tell, repeat as a whole.  Different contexts of one gram are sorted as suffixes to the right of the anchor and to
the left of it: a mergesort that compares two suffixes by the length of their
common extension, found by binary search over prefix polynomial hashes.
Neighbours' common extensions are then verified byte by byte, and with both
orders it is known for each string of a context whether another context has it.

A gram of more contexts than a few parts would need a copy of each context for
every other part.  Its strings are compared by 128-bit hashes instead, so the
work stays in proportion to the contexts.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import POWERS, bound_batches, drop_path, mix64, row_key, scratch, shared_dir, split_batch, stored, text_bytes, tidy

LENGTH = 200
GRAM = 72
#: Bytes of a text that are searched for anchors at once.
SEGMENT = 1 << 19
#: Contexts of one gram that are sorted together; larger groups are sorted for each pair of such parts.
PART = 4096
#: Bytes of contexts of several groups that are sorted at once; a sort takes some thirty times as much memory.
SORTED = 1 << 20
#: Parts of one gram's contexts beyond which their strings are hashed.
MOST_PARTS = 8


def _sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over x[i : i + width] for each full window."""
    span, y = 1, x
    while 2 * span <= width:
        y = f(y[:-span], y[span:])
        span *= 2
    rest = width - span
    return f(y[: len(y) - rest], y[rest:]) if rest else y


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(segment, position in it, gram hash, two parts of the context's hash, bytes left, bytes right) of every anchor, with segments end to end."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, empty, empty, empty
    prefix = POWERS.prefix(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix64(POWERS.window(prefix, at, at + gram))
    width = length - gram + 1
    low = _sliding(grams, width, np.minimum)
    starts = np.arange(len(low))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = starts + length <= offsets[1:][owner[: len(low)]]
    low = np.where(whole, low, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    high = _sliding(padded, width, np.maximum)[: len(grams)]
    pos = np.flatnonzero((high == grams) & (grams > 0))
    segment = owner[pos]
    left = np.minimum(pos - offsets[:-1][segment], length - gram)
    right = np.minimum(offsets[1:][segment] - pos, length)
    raw = data.tobytes()
    digests = [xxhash.xxh3_128_digest(raw[a:b], seed=n) for a, b, n in zip((pos - left).tolist(), (pos + right).tolist(), left.tolist(), strict=True)]
    context = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return segment, pos - offsets[:-1][segment], grams[pos].view(np.int64), context[:, 0], (context[:, 1] & 0x7FFFFFFF).astype(np.int32), left, right


def _compare(prefix, data, px, nx, py, ny):
    """The sign of the suffixes at px against those at py, by the binary search for their common extension."""
    low, high = np.zeros(len(px), np.int64), np.minimum(nx, ny)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = POWERS.window(prefix, px, px + mid) == POWERS.window(prefix, py, py + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    end_x, end_y = low == nx, low == ny
    bx = data[np.minimum(px + low, len(data) - 1)].astype(np.int64)
    by = data[np.minimum(py + low, len(data) - 1)].astype(np.int64)
    return np.where(end_x & end_y, 0, np.where(end_x, -1, np.where(end_y, 1, np.sign(bx - by))))


def suffix_order(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of each group in order, and the verified common extension of each with the one before (-1 at a group's first).

    ``group`` ascends.  All groups are merged at once, run by run.
    """
    m = len(start)
    prefix = POWERS.prefix(data)
    order, at = np.arange(m), np.arange(m)
    first = np.searchsorted(group, group, side="left")
    last = np.searchsorted(group, group, side="right")
    width = 1
    while m and (last - first).max() > width:
        run = (at - first) // width
        is_b = run % 2
        own = first + run * width
        other = np.minimum(np.where(is_b == 1, own - width, own + width), last)
        low, high = other.copy(), np.minimum(other + width, last)
        while True:
            act = np.flatnonzero(low < high)
            if not len(act):
                break
            mid = (low[act] + high[act]) // 2
            x, y = order[act], order[mid]
            sign = _compare(prefix, data, start[x], size[x], start[y], size[y])
            after = (sign > 0) | ((sign == 0) & (is_b[act] == 1))
            low[act] = np.where(after, mid + 1, low[act])
            high[act] = np.where(after, high[act], mid)
        place = np.minimum(own, other) + (at - own) + (low - other)
        merged = np.empty(m, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    return order, common_extensions(data, start[order], size[order], group[order])


def common_extensions(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The common bytes of each suffix with the one before it, from the bytes themselves."""
    out = np.full(len(start), -1, np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    for part in np.array_split(same, len(same) // 1024 + 1):
        if not len(part):
            continue
        n = np.minimum(size[part], size[part - 1])
        span = np.arange(max(int(n.max()), 1))
        a = data[np.minimum(start[part][:, None] + span, len(data) - 1)]
        b = data[np.minimum(start[part - 1][:, None] + span, len(data) - 1)]
        differ = (a != b) | (span >= n[:, None])
        out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), len(span))
    return out


def repeated_strings(contexts: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Whether the string at each offset (rows: contexts; columns: from length - gram before the anchor up to it) is in another context of the group."""
    m = len(contexts)
    size = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(size) - size
    right = size - left
    r_order, r_common = suffix_order(data, begin + left, right, group)
    back = data[::-1]
    l_order, l_common = suffix_order(back, len(data) - (begin + left), left, group)
    out = np.zeros((m, length - gram + 1), bool)
    r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for column in range(length - gram + 1):
        before = length - gram - column
        after = length - before
        r_class[r_order] = np.cumsum(r_common < after)
        l_class[l_order] = np.cumsum(l_common < before)
        able = np.flatnonzero((left >= before) & (right >= after))
        key = l_class[able] * (m + 1) + r_class[able]
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        same = np.zeros(len(by), bool)
        equal = sorted_key[1:] == sorted_key[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        out[able[by[same]], column] = True
    return out


def _runs(row: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def _begins(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row's first three columns, which name its group, differ from those of the row before."""
    names = [rows.column(i).to_numpy() for i in range(3)]
    new = np.ones(len(rows), bool)
    new[1:] = np.any([n[1:] != n[:-1] for n in names], axis=0)
    return new


def whole_groups(batches, limit: int = SORTED):
    """The rows in batches of whole groups that have at most ``limit`` bytes of contexts (the last column), or a single group."""

    def cut(parts):
        for rows in pa.Table.from_batches(parts).combine_chunks().to_batches():
            at = np.append(np.flatnonzero(_begins(rows)), len(rows))
            size = text_bytes(rows.column(rows.num_columns - 1))[1][at]
            i = 0
            while i < len(at) - 1:
                j = max(i + 1, int(np.searchsorted(size, size[i] + limit, side="right")) - 1)
                yield rows.slice(int(at[i]), int(at[j] - at[i]))
                i = j

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        # The last group may go on in the next batch.
        end = int(np.flatnonzero(_begins(batch))[-1])
        if end or held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(3)):
            yield from cut([*held, batch.slice(0, end)])
            held = []
        held.append(batch.slice(end))
    if held:
        yield from cut(held)


def spans_of_groups(batches, length: int = LENGTH, gram: int = GRAM):
    """(_k, _t, start, end) of the strings that contexts share with others of their group, from rows of (three columns of the group, _n, _k, _t, pos, l, context) in the order of groups."""
    for rows in whole_groups(batches):
        n, k, t, pos, left = (rows.column(i).to_numpy().astype(np.int64) for i in range(3, 8))
        # Contexts that repeat as a whole are covered, but others are compared with them.
        hit = repeated_strings(rows.column(8).to_pylist(), left, np.cumsum(_begins(rows)), length, gram)
        out = [(k[i], t[i], pos[i] - (length - gram) + a, pos[i] - (length - gram) + b + length) for i in np.flatnonzero((n == 1) & hit.any(axis=1)) for a, b in _runs(hit[i])]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(4)], names=["_k", "_t", "start", "end"])


def _release(spark) -> None:
    """Lets Spark delete shuffle files that no DataFrame needs any more; results don't depend on it."""
    gc.collect()
    spark._jvm.System.gc()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, part: int = PART, most_parts: int = MOST_PARTS) -> DataFrame:
    """(_k, _t, start, end): byte ranges that cover all strings of ``length`` bytes that also start anywhere else."""
    spark = docs.sparkSession
    bound_batches(spark)
    keys = row_key(id_col, text_col)
    rows = docs.where(F.octet_length(text_col) >= length).select(*keys, F.encode(text_col, "UTF-8").alias("_text"))
    schema = "_k long, _t long, pos long, h long, c long, d int, l short, r short"

    def find(batches):
        for batch in batches:
            for piece in split_batch(batch, "_text", SEGMENT):
                data, offsets = text_bytes(piece.column(2))
                k, t = (piece.column(i).to_numpy() for i in (0, 1))
                # A longer text than a segment is cut so that each string lies in one of its segments.
                for a in range(0, max(1, len(data) if len(piece) == 1 else 1), SEGMENT):
                    own, bounds = (data[a : a + SEGMENT + length - 1], None) if len(piece) == 1 else (data, offsets)
                    bounds = np.array([0, len(own)]) if bounds is None else bounds
                    s, pos, h, c, d, left, right = anchors(own, bounds, length, gram)
                    yield pa.RecordBatch.from_arrays([pa.array(k[s]), pa.array(t[s]), pa.array(pos + a), pa.array(h), pa.array(c, pa.int64()), pa.array(d, pa.int32()), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], names=["_k", "_t", "pos", "h", "c", "d", "l", "r"])

    first = shared_dir(spark)
    found = stored(rows.mapInArrow(tidy(find), schema), first)
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
    again = stored(again)
    at = stored(found.join(again.hint("merge"), "h"))
    drop_path(spark, first)
    del found, again
    _release(spark)
    classes = at.groupBy("h", "c", "d").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_k", "_t", "pos", "l", "r")).alias("_rep"))
    classes = stored(classes)
    _release(spark)
    wholes = at.join(classes.where("_n > 1").select("h", "c", "d").hint("merge"), ["h", "c", "d"])
    spans = stored(wholes.select("_k", "_t", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end")))
    # Only grams with several contexts, of which one occurs once, have to be sorted.
    mixed = classes.groupBy("h").agg(F.count(F.lit(1)).alias("_m"), F.min("_n").alias("_least")).where("_m > 1 and _least = 1").select("h", F.ceil(F.col("_m") / part).cast("int").alias("_parts"))
    mixed = stored(mixed)
    drop_path(spark, at._stored_at)
    _release(spark)
    wanted = classes.join(mixed.hint("merge"), "h").select("h", "_n", "_parts", "_rep.*")
    context_schema = "h long, _n long, _parts int, _k long, _t long, pos long, l short, context binary"

    def cut(batches):
        names = ["h", "_n", "_parts", "_k", "_t", "pos", "l", "context"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.binary()]
        for batch in batches:
            for piece in split_batch(batch, "_text", SEGMENT):
                for k, t, spots, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_pylist(), piece.column(3), strict=True):
                    text = text.as_py()
                    out = [(s["h"], s["_n"], s["_parts"], k, t, s["pos"], s["l"], text[s["pos"] - s["l"] : s["pos"] + s["r"]]) for s in spots]
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=names)

    def contexts_of(wanted: DataFrame) -> DataFrame:
        per_text = wanted.groupBy("_k", "_t").agg(F.collect_list(F.struct("h", "_n", "_parts", "pos", "l", "r")).alias("_at"))
        one_each = rows.join(per_text.hint("merge"), ["_k", "_t"]).select("_k", "_t", "_at", "_text")
        return one_each.mapInArrow(tidy(cut), context_schema)

    contexts = contexts_of(wanted.where(F.col("_parts") <= most_parts))
    # A context of a large group goes to every pair of parts that has its own part.
    own = F.pmod(F.xxhash64("_k", "_t", "pos"), F.col("_parts")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: F.struct(F.least(p, F.col("_own")).alias("a"), F.greatest(p, F.col("_own")).alias("b"))))
    dealt = contexts.withColumn("_own", own).select("h", "_n", "_k", "_t", "pos", "l", "context", pair.alias("_pair"))
    ordered = dealt.repartition("h", "_pair").sortWithinPartitions("h", "_pair").select("h", "_pair.a", "_pair.b", "_n", "_k", "_t", "pos", "l", "context")
    parts = stored(ordered.mapInArrow(tidy(lambda batches: spans_of_groups(batches, length, gram)), "_k long, _t long, start long, end long"))
    _release(spark)
    if mixed.where(F.col("_parts") > most_parts).isEmpty():
        return spans.unionByName(parts)
    hashed = stored(_strings_by_hash(contexts_of(wanted.where(F.col("_parts") > most_parts)), length))
    _release(spark)
    return spans.unionByName(parts).unionByName(hashed)


def _strings_by_hash(contexts: DataFrame, length: int) -> DataFrame:
    """(_k, _t, start, end) of the strings of the contexts that occur at several places, for grams of very many contexts."""
    names = ["w", "v", "_n", "_k", "_t", "start"]

    def run(batches):
        for batch in batches:
            for piece in split_batch(batch, "context", SEGMENT >> 1):
                digests, at, owner = [], [], []
                for i, (context, pos, left) in enumerate(zip(piece.column(7).to_pylist(), piece.column(5).to_pylist(), piece.column(6).to_pylist(), strict=True)):
                    last = min(left, len(context) - length)
                    digests += [xxhash.xxh3_128_digest(context[a : a + length]) for a in range(last + 1)]
                    at += range(pos - left, pos - left + last + 1)
                    owner += [i] * (last + 1)
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                kept = [np.asarray(piece.column(c))[owner] if owner else np.zeros(0, np.int64) for c in (1, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (both[:, 0], both[:, 1], *kept, np.array(at, np.int64))], names=names)

    strings = stored(contexts.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in names)))
    # A string that two anchors of one text share is at one place.
    place = F.struct("_k", "_t", "start")
    again = strings.groupBy("w", "v").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a != _b").select("w", "v")
    again = stored(again)
    # Contexts that repeat as a whole are covered, but others were compared with them.
    found = strings.where("_n = 1").join(again.hint("merge"), ["w", "v"])
    return found.select("_k", "_t", "start", (F.col("start") + length).alias("end"))


def _with_spans(docs: DataFrame, id_col: str, text_col: str, keep: list[str], length: int, gram: int, part: int, most_parts: int) -> DataFrame:
    with scratch(docs.sparkSession) as keep_table:
        spans = repeated_spans(docs, id_col, text_col, length, gram, part, most_parts)
        # A text has at most one anchor's span for each of its bytes.
        per_text = stored(spans.groupBy("_k", "_t").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans")))
        keep_table(per_text)
    _release(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("_doc"), *row_key(id_col, text_col), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_text"))
    return rows.join(per_text.hint("merge"), ["_k", "_t"], "left").select("_doc", "_spans", "_text")


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, part: int = PART, most_parts: int = MOST_PARTS) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans, kept_sha256.

    ``spans`` are the maximal removed byte ranges (start, end).  Null text is
    empty; a text shorter than ``length`` loses nothing; equal rows repeat
    each other, also with equal or null ids.  Very long texts are searched
    whole, in overlapping segments.  An empty table gives no rows; other
    columns, whatever their names, are ignored.
    """
    schema = "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for piece in split_batch(batch, "_text", SEGMENT):
                out = []
                for doc, spans, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2), strict=True):
                    text, spans = text.as_py(), merged(spans)
                    rest = _rest(text, spans)
                    out.append((doc["_id"], len(text), len(text) - len(rest), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(rest).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), kind, pa.string()))], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    named = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return _with_spans(named, "_id", "_text", ["_id"], length, gram, part, most_parts).mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The documents without their repeated strings, and with their number of characters; a character cut apart goes.

    Null texts stay null, a text that repeats as a whole becomes empty, and
    repeated rows each lose what they share.
    """
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for piece in split_batch(batch, "_text", SEGMENT):
                texts = [_rest(text.as_py(), merged(spans)).decode("utf-8", "ignore") for spans, text in zip(piece.column(1).to_pylist(), piece.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.string())], names=["_doc", "_text"])

    rows = _with_spans(docs, id_col, text_col, columns, LENGTH, GRAM, PART, MOST_PARTS)
    doc = rows.schema["_doc"].dataType
    from pyspark.sql import types as T

    out = rows.mapInArrow(tidy(run), T.StructType([T.StructField("_doc", doc), T.StructField("_text", T.StringType())]))
    new = {text_col: F.when(F.col(f"_doc.{text_col}").isNotNull(), F.col("_text")), count_col: F.char_length("_text").cast("bigint")}
    return out.select(*(new.get(c, F.col(f"_doc.{c}")).alias(c) for c in columns))
