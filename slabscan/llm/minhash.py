"""Near-duplicate documents with ProbMinHash signatures over weighted word shingles.

Shingles of five words are weighted by 1 + ln(count).  Each shingle sends a
Poisson process of arrivals, at a rate equal to its weight, to random
registers of its document's signature; a register keeps the shingle that
arrives first.  Two registers agree with the probability Jaccard of the
weighted sets.  Arrivals are drawn in rounds and a shingle stops once its time
exceeds the largest register: later arrivals can't win.

Signatures are cut to bands.  A text that repeats shingles also gets the bands
of its shingle set, each of weight 1; for a text without repeats these are its
own.  So texts of similar sets meet even if they repeat them differently.  Texts with equal words are one class from the
start.  Every class is verified against the smallest one of each of its
buckets by the exact Jaccard similarity of the shingle sets.  What is then
still apart from a bucket's largest component is compared with a few of its
most central members, and in the end with all of the bucket that is not yet in its
own component, but for pairs that can't reach the similarity because the
texts share too few shingles by an exact upper bound.  So no candidate pair
that could join two groups is left out.
Groups are the connected components of verified pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabscan.llm.common import POWERS, bound_batches, in_files, mix64, places, rows_at, scratch, split_batch, stored, text_bytes, tidy, without_rows
from slabscan.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
BAND_ROWS = 5
#: What is apart from a bucket's largest component is compared with so many of its members before it is compared with all.
LEADERS = 4
#: Slices of a text's shingles, by which the similarity of a pair is bounded.
SLICES = 64
#: Pairs of one leader that a task verifies in one go.
CHUNK = 512
#: Bytes of a word above which its hash isn't a polynomial.
LONG_WORD = 256

_WORD_BYTE = np.ones(256, bool)
_WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, 128-bit hash of all words of each text as two columns), with the texts end to end.

    Words are runs of bytes other than ASCII white space, with A-Z in lower
    case.  A text of fewer words than a shingle has one shingle of them all; a
    text without words has none, and 0 for its words.  Polynomial hashes modulo
    2**64 collide by construction from 1,024 symbols on, so they serve only
    for short words and for the few words of a shingle.
    """
    n = len(offsets) - 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[:-1] = inside
    starts_text = np.zeros(len(data) + 1, bool)
    starts_text[offsets] = True
    before = np.concatenate([[False], inside])
    begin = np.flatnonzero((edge == 1) & (~before | starts_text))
    after = np.concatenate([edge[1:], [0]])
    end = np.flatnonzero((edge == 1) & ((after == 0) | np.concatenate([starts_text[1:], [True]]))) + 1
    prefix = POWERS.prefix(lower)
    word = mix64(POWERS.window(prefix, begin, end) + mix64((end - begin).astype(np.uint64)))
    for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
        word[i] = xxhash.xxh3_64_intdigest(lower[begin[i] : end[i]].tobytes())
    text = np.searchsorted(offsets, begin, side="right") - 1
    count = np.bincount(text, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    chain = POWERS.prefix_of(word)
    whole = _words_hash(lower, inside, end, offsets, count)
    size = np.minimum(count, words)
    number = np.where(count > 0, count - size + 1, 0)
    owner = np.repeat(np.arange(n), number)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    a = first[owner] + within
    return owner, mix64(POWERS.window(chain, a, a + size[owner])), whole


def _words_hash(lower: np.ndarray, inside: np.ndarray, end: np.ndarray, offsets: np.ndarray, count: np.ndarray) -> np.ndarray:
    """n x 2 halves of a hash of each text's words, one space after each; 0 for a text without words."""
    size = inside.astype(np.int64)
    size[end - 1] += 1
    place = np.concatenate([[0], np.cumsum(size)])
    plain = np.full(place[-1], 32, np.uint8)
    plain[place[:-1][inside]] = lower[inside]
    data, at = plain.tobytes(), place[offsets].tolist()
    out = np.zeros((len(count), 2), np.uint64)
    for i in np.flatnonzero(count).tolist():
        h = xxhash.xxh3_128_intdigest(data[at[i] : at[i + 1]])
        # 0 stands for no words.
        out[i] = max(h >> 64, 1), h & (2**64 - 1)
    return out


def weighted_sets(owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, with the number of times each occurs."""
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return owner[at], shingle[at], np.diff(np.append(at, len(owner)))


def prob_minhash(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers shingles that arrived first; 0 for texts without shingles."""
    time = np.full(n * registers, np.inf)
    first = np.zeros(n * registers, np.uint64)
    clock = np.zeros(len(owner))
    step = 0
    while len(owner):
        step += 1
        draw = mix64(shingle + np.uint64((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        clock -= np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / weight
        at = owner * registers + (mix64(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, at, clock)
        won = time[at] == clock
        first[at[won]] = shingle[won]
        limit = time.reshape(n, registers).max(axis=1)
        alive = clock < limit[owner]
        owner, shingle, weight, clock = owner[alive], shingle[alive], weight[alive], clock[alive]
    return first.reshape(n, registers)


def band_hashes(signature: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    out = np.zeros((len(signature), bands), np.uint64)
    for i in range(rows):
        out = mix64(out * np.uint64(31) + signature.reshape(len(signature), bands, rows)[:, :, i])
    return mix64(out + np.arange(bands, dtype=np.uint64))


def buckets_of(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, bands: int = BANDS, rows: int = BAND_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket): the bands by weight and, for texts that repeat shingles, those of the plain set."""
    weighted = band_hashes(prob_minhash(owner, shingle, 1 + np.log(count), n, bands * rows), bands, rows)
    repeats = np.zeros(n, bool)
    repeats[owner[count > 1]] = True
    again = repeats[owner]
    number = np.cumsum(repeats) - 1
    plain = band_hashes(prob_minhash(number[owner[again]], shingle[again], np.ones(again.sum()), repeats.sum(), bands * rows), bands, rows)
    text = np.repeat(np.concatenate([np.arange(n), np.flatnonzero(repeats)]), bands)
    return weighted_sets(text, np.concatenate([weighted.ravel(), plain.ravel()]))[:2]


def sketches(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = (), words: int = WORDS, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """The columns ``keep``, ``_class`` (a hash of all words; 0 without words), ``_check`` (its other half), ``_words`` and ``_bands`` of each row."""
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = rows.drop("_text").schema.add("_class", "long").add("_check", "long").add("_words", "long").add("_bands", T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for part in split_batch(batch, "_text", 1 << 20):
                n = len(part)
                data, offsets = text_bytes(part.column(len(keep)))
                owner, shingle, whole = shingles(data, offsets, words)
                number = np.bincount(owner, minlength=n)
                owner, shingle, count = weighted_sets(owner, shingle)
                text, bucket = buckets_of(owner, shingle, count, n, bands, band_rows)
                at = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), pa.array(number.astype(np.int64)), lists], names=[*keep, "_class", "_check", "_words", "_bands"])

    return rows.mapInArrow(tidy(run), schema)


def _jaccard_verify(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose shingle sets are similar enough; ``texts`` has _class and _text.

    A leader's pairs are dealt in chunks, so that no task takes all pairs of a
    leader that a third of the table is similar to.  Within a task the rows
    stream in order: the leader's text, then the texts it is compared with.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    sizes = stored(sizes)
    dealt = pairs.join(sizes.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_chunks")).cast("int").alias("_chunk"))
    followers = dealt.select(F.col("b").alias("_class"), "a", "_chunk", F.lit(1).alias("_kind"))
    leaders = sizes.select(F.col("a").alias("_class"), "a", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), F.lit(0).alias("_kind"))
    wanted = followers.unionByName(leaders)
    loaded = wanted.join(texts.hint("merge"), "_class").select("a", "_chunk", "_kind", F.col("_class").alias("b"), "_text")
    ordered = loaded.repartition("a", "_chunk").sortWithinPartitions("a", "_chunk", "_kind")

    def sets(part):
        data, offsets = text_bytes(part.column(4))
        owner, shingle, _ = weighted_sets(*shingles(data, offsets, words)[:2])
        return np.split(shingle, np.searchsorted(owner, np.arange(1, len(part))))

    def run(batches):
        leader, own = None, None
        for batch in batches:
            for part in split_batch(batch, "_text", 1 << 20):
                found = []
                for a, chunk, kind, b, own_set in zip(*(part.column(i).to_pylist() for i in range(4)), sets(part), strict=True):
                    if kind == 0:
                        leader, own = (a, chunk), own_set
                        continue
                    assert leader == (a, chunk)
                    both = np.intersect1d(own, own_set, assume_unique=True).size
                    if both and both >= similarity * (own.size + own_set.size - both) - 1e-9:
                        found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return ordered.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: id, class_id, group_id, group_size, kept.

    ``class_id`` is a hash shared by texts of equal words, told apart by 128
    bits; ``group_id`` is the smallest id of the group, which is kept.  A null id is never the smallest
    unless a group has no other.  A document without words is alone in a
    group of its own: its group_id is its id.  Of rows that repeat the
    smallest id exactly one is kept.  Very long texts are compared whole.  An
    empty table gives no rows; other columns, whatever their names, are ignored.
    """
    told = _judged(in_files(docs), id_col, text_col, words, similarity, bands, band_rows)
    return told.select(F.col("_id").alias(id_col), F.col("_class").alias("class_id"), "group_id", "group_size", "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float, bands: int, band_rows: int) -> DataFrame:
    """_id, _file, _at, _class, group_id, group_size, kept of each row of a table in files."""
    bound_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        rows = docs.select(docs[id_col].alias("_id"), F.monotonically_increasing_id().alias("_row"), *places(docs), docs[text_col].alias("_body"))
        flat = _apart(stored(sketches(rows, "_body", ("_id", "_row", "_file", "_at"), words, bands, band_rows)))
        full = flat.where("_words > 0")
        classes = full.groupBy("_class").agg(F.min("_row").alias("_row"))
        # One sketch for each class, at its first row; a join on the row number has no hot key.
        heads = stored(full.join(classes.select("_row"), "_row", "left_semi").select("_class", "_bands", "_file", "_at"))
        members = heads.select("_class", F.explode("_bands").alias("_bucket"))
        buckets = stored(members.groupBy("_bucket").agg(F.min("_class").alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
        shared = stored(members.join(buckets.select("_bucket", "a").hint("merge"), "_bucket").select("_bucket", "a", F.col("_class").alias("b")))
        near = shared.select("a", "b").where("a != b").distinct()
        # Texts of the classes that share a bucket: any row of a class serves.
        involved = stored(heads.join(shared.select(F.col("b").alias("_class")).distinct(), "_class", "left_semi").select("_class", "_file", "_at"))
        texts = _class_texts(docs, text_col, involved)
        links = stored(_jaccard_verify(near, texts, words, similarity))
        groups = stored(connected_components(links))
        done = near
        profile = None
        for last in (False, True):
            open_buckets = _open_buckets(shared, groups)
            if profile is None:
                profile = stored(_profiles(texts, open_buckets.select(F.col("b").alias("_class")).distinct(), words))
            of = lambda side, name: profile.select(F.col("_class").alias(side), *(F.col(f"_{c}").alias(f"{c}_{name}") for c in ("n", "o", "shared")))
            others = open_buckets.join(of("b", "b").hint("merge"), "b")
            minor = open_buckets.where("_group != _most").select("_bucket", F.col("b").alias("x"), F.col("_group").alias("_x"))
            if not last:
                rest = minor.join(_leaders(others), "_bucket").select("x", F.explode("_leaders").alias("b"))
            else:
                minor = minor.join(of("x", "x").hint("merge"), "x")
                needed = F.ceil((F.col("n_x") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-6)
                by_slice = F.aggregate(F.zip_with("shared_x", "shared_b", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
                able = (F.least("o_x", "o_b") >= needed) & (by_slice >= needed)
                rest = minor.join(others, "_bucket").where(F.expr("_x != _group and (_group = _most or x < b)") & able)
            rest = rest.select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()
            rest = stored(rest.join(done.hint("merge"), ["a", "b"], "left_anti"))
            if rest.isEmpty():
                continue
            done = done.unionByName(rest)
            links = links.unionByName(stored(_jaccard_verify(rest, texts, words, similarity)))
            groups = stored(connected_components(links))
        joined = flat.join(groups.hint("merge"), F.col("_class") == F.col("node"), "left")
        group = F.when(F.col("_words") > 0, F.coalesce("component", "_class"))
        told = stored(joined.select("_id", "_row", "_file", "_at", "_class", group.alias("_group")))
        first = F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row")))
        tops = stored(told.where("_group is not null").groupBy("_group").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")))
        keep(told, tops)
    some = told.where("_group is not null").join(tops.hint("merge"), "_group").select("_id", "_file", "_at", "_class", F.col("_first.id").alias("group_id"), F.col("_n").alias("group_size"), (F.col("_row") == F.col("_first.row")).alias("kept"))
    none = told.where("_group is null").select("_id", "_file", "_at", "_class", F.col("_id").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"))
    return some.unionByName(none)


def _open_buckets(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(_bucket, b, _group, _most) of the buckets that hold several components; _most is the largest one there."""
    placed = shared.join(groups.hint("merge"), F.col("b") == F.col("node"), "left").select("_bucket", "b", F.coalesce("component", "b").alias("_group"))
    sizes = placed.groupBy("_bucket", "_group").agg(F.count(F.lit(1)).alias("_n"))
    largest = sizes.groupBy("_bucket").agg(F.max_by("_group", F.struct("_n", "_group")).alias("_most"), F.count(F.lit(1)).alias("_groups")).where("_groups > 1")
    return stored(placed.join(largest.hint("merge"), "_bucket").select("_bucket", "b", "_group", "_most"))


def _profiles(texts: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(_class, _n, _o, _shared): a text's shingles, those that some other text of ``classes`` has too, and these by slice.

    Slices are cut by the shingle's hash.  Two texts share at most the sum of
    the smaller counts of each slice, which bounds their similarity from above.
    """

    def run(batches):
        for batch in batches:
            for part in split_batch(batch, "_text", 1 << 20):
                data, offsets = text_bytes(part.column(1))
                owner, shingle, _ = weighted_sets(*shingles(data, offsets, words)[:2])
                at = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(shingle.view(np.int64)))], names=["_class", "_s"])

    def count(batches):
        for batch in batches:
            n, o, shared = [], [], []
            for own, alone in zip(batch.column(1), batch.column(2), strict=True):
                own = own.values.to_numpy(zero_copy_only=False)
                rest = own if not alone.is_valid else np.setdiff1d(own, alone.values.to_numpy(zero_copy_only=False), assume_unique=True)
                n.append(len(own))
                o.append(len(rest))
                shared.append(np.bincount(rest % SLICES, minlength=SLICES).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(o, pa.int32()), pa.array(shared, pa.list_(pa.int32()))], names=["_class", "_n", "_o", "_shared"])

    sets = stored(texts.join(classes.hint("merge"), "_class", "left_semi").select("_class", "_text").mapInArrow(tidy(run), "_class long, _s array<long>"))
    alone = sets.select("_class", F.explode("_s").alias("_s")).groupBy("_s").agg(F.min("_class").alias("_class"), F.count(F.lit(1)).alias("_n"))
    own = alone.where("_n = 1").groupBy("_class").agg(F.collect_list("_s").alias("_alone"))
    return sets.join(own.hint("merge"), "_class", "left").select("_class", "_s", "_alone").mapInArrow(tidy(count), "_class long, _n int, _o int, _shared array<int>")


def _leaders(others: DataFrame) -> DataFrame:
    """A few members of each bucket's largest component: of each slice of them, the one with the largest shared part."""
    drawn = [F.max(F.when(F.pmod(F.xxhash64("b"), F.lit(LEADERS)) == i, F.struct((F.col("o_b") - F.col("n_b")).alias("o"), "b")))["b"] for i in range(LEADERS)]
    return others.where("_group = _most").groupBy("_bucket").agg(F.array_compact(F.array(*drawn)).alias("_leaders"))


def _apart(flat: DataFrame) -> DataFrame:
    """The sketches with one class for each hash of 128 bits: classes whose halves don't agree are split."""
    full = flat.where("_words > 0")
    mixed = full.groupBy("_class").agg(F.min("_check").alias("_a"), F.max("_check").alias("_b")).where("_a != _b").select("_class")
    mixed = stored(mixed)
    if mixed.isEmpty():
        return flat
    other = F.when(F.col("_mixed").isNotNull(), F.xxhash64("_class", "_check")).otherwise(F.col("_class")).alias("_class")
    told = flat.join(mixed.withColumn("_mixed", F.lit(1)).hint("merge"), "_class", "left")
    return stored(told.select(*(other if c == "_class" else F.col(c) for c in flat.columns)))


def _class_texts(docs: DataFrame, text_col: str, involved: DataFrame) -> DataFrame:
    """(_class, _text) of the document at the place of each class in ``involved``, written once; no other text moves."""
    found = rows_at(docs, involved, [docs[text_col].alias("_text")])
    return stored(found.join(involved.hint("merge"), ["_file", "_at"]).select("_class", "_text"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: exactly one of each group, and all without words.

    Rows are told by their places in the files, so that repeated ids and rows
    are told apart and no document shuffles; a table that isn't read from
    files is written first.
    """
    docs = in_files(docs)
    judged = _judged(docs, id_col, text_col, WORDS, SIMILARITY, BANDS, BAND_ROWS)
    return without_rows(docs, judged.where("not kept").select("_file", "_at"))
