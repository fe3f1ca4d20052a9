"""Near copies by SimHash balls, decided on whole sets of word shingles.

A text's set of shingles has a wide fingerprint: twelve segments of 21 bits and 128 bits to check by. Each fingerprint emits, for every
segment, the ball of its variants within one bit, and two fingerprints meet where a variant of one is a variant of the other: where a
segment differs in two bits at most. Of pairs of similarity 0.8 (a bit differs with probability 0.15 there) 99.5 of 100 meet, of more
similar ones nearly all (of the shortest texts, with four and five shingles, 95 of 100); the check bits only strike pairs that are at 37 or more of 128 (19 are expected at 0.8; 24 for the shortest texts). Whatever meets is then
decided by the Jaccard similarity of the whole sets, so no pair below the bound is ever joined.

Variants that differ in the low bits of a segment stay in one group and are made there, so a fingerprint travels in four rows for a
segment instead of 22 (more where there are more texts); `top_bits`, which says how finely groups are dealt, grows with the input and never changes what meets.

Pairs are real ones, never stars of a component. Crowds (values of a segment that meet in more than `all_pairs` pairs) first give, in
four segments, each member's neighbour by size, the middle one and that of the largest value met; when those are decided, all members of
a crowd that are not yet in one component are held against each other by size, check bits and a parity sketch, in blocks of bounded
size, each two of which meet in one task. So a large group of near copies costs a few rows for each member, and nothing is left out.

Null and wordless texts are one empty set, which is linked to nothing else. Work on unlike texts grows with the square of their number
times 12 * 253 / 2^21 bit checks each; beyond some 10^8 different texts take longer segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import _ball, _named, components, majority_bits
from .words import gram_hashes, lowered, mixed, split_words, text_bytes

SEGMENTS, SEGMENT_BITS = 12, 21  # three segments in each of the first four words of a wide fingerprint
WORDS = 6  # the last two are the check bits
CHECK_LIMIT = 36
PARITY_WORDS = 32  # 64-bit words of a parity sketch
STARS = 4  # segments whose crowds give a few pairs for each member before the others are held against each other
BLOCK = 4096
_SALTS = np.arange(1, 2 * WORDS, 2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
_WIDE = [f"w{k}" for k in range(WORDS)]
_ENTRY = np.dtype([("fp", "<i8"), ("n", "<u4"), ("segment", "<u4"), ("check", "<u8", 2)])


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin; a text of fewer words is one shingle."""
    data, offsets = text_bytes(column)
    words = split_words(lowered(data), offsets, "solid")
    hashes, counts = words.hashes(), words.counts
    per_doc = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    grams = np.zeros(bounds[-1], dtype=np.uint64)
    for n in range(1, shingle + 1):  # fewer words than a shingle: all of them
        rows = np.flatnonzero(counts >= shingle if n == shingle else counts == n)
        if len(rows):
            at = np.repeat(bounds[rows], per_doc[rows]) + np.arange(per_doc[rows].sum()) - np.repeat(np.cumsum(per_doc[rows]) - per_doc[rows], per_doc[rows])
            doc = np.repeat(rows, per_doc[rows])
            grams[at] = gram_hashes(hashes, n)[at - bounds[doc] + words.bounds[doc]]
    doc = np.repeat(np.arange(len(counts)), per_doc)
    order = np.lexsort((grams, doc))  # a shingle counts once for each text, as in the similarity of sets
    grams, doc = grams[order], doc[order]
    once = np.ones(len(grams), dtype=bool)
    once[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[once], np.searchsorted(doc[once], np.arange(len(counts) + 1))


def names_of(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; zero for an empty one."""
    n = np.diff(bounds)
    out, full = np.zeros(len(n), dtype=np.uint64), np.flatnonzero(n)
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(grams ^ np.uint64(0x9E3779B97F4A7C15)), bounds[:-1][full]) ^ mixed(n[full].astype(np.uint64)))
    return out


def parities_of(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set, whether the number of its shingles in each of 64 * PARITY_WORDS cells is odd: PARITY_WORDS words a set. Bits that
    differ between two sets are never more than the shingles they don't share."""
    h = mixed(grams)
    out = np.zeros((len(bounds) - 1) * PARITY_WORDS, dtype=np.uint64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    np.bitwise_xor.at(out, doc * PARITY_WORDS + ((h >> np.uint64(6)) % np.uint64(PARITY_WORDS)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return out


def wide_of(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Wide fingerprints, a row of WORDS words each: bits set in over half of the set's hashes, hashed anew for each word."""
    return np.column_stack([majority_bits(mixed(grams + _SALTS[k]), bounds) for k in range(WORDS)])


def sketches(docs: DataFrame, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """Columns `keep`, fp (name of the set of shingles), n (its size), the words of the wide fingerprint and the parity sketch."""
    schema = common.schema_of(docs, keep, ", ".join(["fp long", "n int", *(f"{w} long" for w in _WIDE), "parity array<long>"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_chunks(batches):
            at = {name: k for k, name in enumerate(batch.schema.names)}
            grams, bounds = shingle_sets(batch.column(at["text"]), shingle)
            wide = wide_of(grams, bounds).view(np.int64)
            own = [pa.array(names_of(grams, bounds).view(np.int64)), pa.array(np.diff(bounds).astype(np.int32)), *(pa.array(np.ascontiguousarray(wide[:, k])) for k in range(WORDS))]
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(bounds), dtype=np.int32) * PARITY_WORDS), pa.array(parities_of(grams, bounds).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in keep), *own, parity], names=[*keep, "fp", "n", *_WIDE, "parity"])

    return common.map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def _segments(wide: np.ndarray) -> np.ndarray:
    parts = [(wide[:, k // 3] >> np.uint64(SEGMENT_BITS * (k % 3))) & np.uint64((1 << SEGMENT_BITS) - 1) for k in range(SEGMENTS)]
    return np.column_stack(parts).astype(np.int64)


def _groups(wide: np.ndarray, top_bits: int) -> np.ndarray:
    """The groups each fingerprint is dealt to: for each segment its top bits, and these with one of them flipped."""
    top = _segments(wide) >> (SEGMENT_BITS - top_bits)
    masks = np.concatenate([[0], 1 << np.arange(top_bits)])
    return ((top | np.arange(SEGMENTS) << top_bits)[:, :, None] ^ masks).reshape(len(wide), -1)


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """fp, n and the wide fingerprints of a batch with columns fp, n, w0, ..."""
    fp, n, *words = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2 + WORDS))
    return fp, n, np.column_stack(words).view(np.uint64)


def _deal(batches: Iterator[pa.RecordBatch], top_bits: int, blocks: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """fp, n, w0... -> (key, block, entries): the members of a group in packed form."""
    for batch in batches:
        for start in range(0, batch.num_rows, 8_000):
            fp, n, wide = _read(batch.slice(start, 8_000))
            keys = _groups(wide, top_bits)
            order = np.argsort(keys, axis=None, kind="stable")
            key, row = keys.ravel()[order], order // keys.shape[1]
            entries = np.empty(len(row), dtype=_ENTRY)
            entries["fp"], entries["n"], entries["check"] = fp[row], n[row], wide[row, 4:]
            entries["segment"] = _segments(wide)[row, key >> top_bits]
            out = []
            for part in np.split(np.arange(len(key)), np.flatnonzero(np.diff(key)) + 1):
                own = int(key[part[0]])
                if own not in blocks:
                    out.append((own, 0, entries[part].tobytes()))
                    continue
                block = mixed(fp[row[part]].view(np.uint64)) % np.uint64(blocks[own])
                out += [(own, int(b), entries[part[block == b]].tobytes()) for b in np.unique(block)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["key", "block", "entries"])


def _meetings(segment: np.ndarray, own: np.ndarray, low_bits: int) -> np.ndarray:
    """Pairs of distinct segment values (by their numbers) whose balls meet in this group; own: the bits a value is off by at the top."""
    low = segment & ((1 << low_bits) - 1)
    selves = np.flatnonzero(own == 0)
    ball = _ball(low_bits, 1).astype(np.int64)
    variant = np.concatenate([(low[selves][:, None] ^ ball).ravel(), low[own != 0]])
    number = np.concatenate([np.repeat(selves, len(ball)), np.flatnonzero(own != 0)])
    order = np.argsort(variant, kind="stable")
    variant, number = variant[order], number[order]
    pairs = []
    for step in range(1, 2 * SEGMENT_BITS + 2):  # so many values at most have one variant
        same = np.flatnonzero(variant[step:] == variant[:-step])
        if not len(same):
            break
        pairs.append(np.sort(np.column_stack([number[same], number[same + step]]), axis=1))
    if not pairs:
        return np.empty((0, 2), dtype=np.int64)
    found = np.unique(np.concatenate(pairs), axis=0)
    return found[(own[found[:, 0]] == 0) | (own[found[:, 0]] != own[found[:, 1]])]  # both off by the same bit: their own group has them


def _may_link(e: np.ndarray, a: np.ndarray, b: np.ndarray, p: int, q: int) -> np.ndarray:
    """By size and check bits."""
    n = e["n"].astype(np.int64)
    near = np.bitwise_count(e["check"][a] ^ e["check"][b]).sum(axis=1, dtype=np.int64) <= CHECK_LIMIT
    return near & (e["fp"][a] != e["fp"][b]) & (q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b]))


def _pieces(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first number of the piece of each of 0..n-1, where a and b are joined."""
    label = np.arange(n)
    while len(a):
        high, low = np.maximum(label[a], label[b]), np.minimum(label[a], label[b])
        apart = high != low
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def _meet(rows: pa.Table, top_bits: int, blocks: dict[int, int], p: int, q: int, all_pairs: int, most: int = 4096, block: int = 1 << 20) -> pa.Table:
    """Of one group (or of one block of it) candidate pairs (fp, to), and members of crowds: `to` null, crowd: a number."""
    key, low_bits = rows.column("key")[0].as_py(), SEGMENT_BITS - top_bits
    e = np.frombuffer(b"".join(rows.column("entries").to_pylist()), dtype=_ENTRY)
    e = e[np.lexsort((e["fp"], e["n"], e["segment"]))]
    segment = e["segment"].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.concatenate([head, [len(e)]]))
    own = (segment[head] >> low_bits) ^ (key & ((1 << top_bits) - 1))
    alone = np.flatnonzero((own == 0) & (size > 1))
    left, right = np.concatenate([_meetings(segment[head], own, low_bits), np.column_stack([alone, alone])]).T
    held: list[np.ndarray] = []  # (row, row, meeting)

    def hold(a: np.ndarray, b: np.ndarray, meeting: np.ndarray) -> None:
        good = _may_link(e, a, b, p, q)
        held.append(np.column_stack([a[good], b[good], meeting[good]]))

    many = size[left] * size[right] > most
    few = np.flatnonzero(~many)
    total = np.concatenate([[0], np.cumsum(size[left[few]] * size[right[few]])])
    at = 0
    while at < len(few):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + block, side="right")) - 1)
        u, v = left[few[at:stop]], right[few[at:stop]]
        n = size[u] * size[v]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.repeat(head[u], n) + nth // np.repeat(size[v], n), np.repeat(head[v], n) + nth % np.repeat(size[v], n)
        hold(a[a < b], b[a < b], np.repeat(few[at:stop], n)[a < b])
        at = stop
    pairs = np.concatenate(held) if held else np.empty((0, 3), dtype=np.int64)
    met = np.bincount(pairs[:, 2], minlength=len(left))
    many |= met > all_pairs
    if key in blocks:  # what is in another block may be near any of them
        many[:] = True
        left, right, many = (np.concatenate([x, y]) for x, y in ((left, np.arange(len(head))), (right, np.zeros(len(head), dtype=np.int64)), (many, np.ones(len(head), dtype=bool))))
    else:
        crowded = np.zeros(len(head), dtype=bool)
        crowded[left[many]] = crowded[right[many]] = True
        many |= (met > 0) & (crowded[left] | crowded[right])
    pairs = pairs[~many[pairs[:, 2]]][:, :2]
    crowd = np.full(len(head), -1, dtype=np.int64)
    if many.any():
        cells = np.unique(np.concatenate([left[many], right[many]]))
        crowd[cells] = _pieces(len(head), left[many], right[many])[cells]
    marked = np.flatnonzero(np.repeat(crowd >= 0, size))
    if len(marked) and key >> top_bits < STARS:
        middle = head + size // 2
        following = marked[marked + 1 < len(e)]
        following = following[segment[following] == segment[following + 1]]
        u, v = np.concatenate([left[many], right[many]]), np.concatenate([right[many], left[many]])
        order = np.lexsort((-size[v], u))
        first = order[np.concatenate([[True], np.diff(u[order]) != 0])]
        a = np.concatenate([marked, following, middle[u[first]]])
        b = np.concatenate([np.repeat(middle, size)[marked], following + 1, middle[v[first]]])
        good = _may_link(e, a, b, p, q)
        pairs = np.concatenate([pairs, np.column_stack([a[good], b[good]])])
    both = np.unique(np.sort(e["fp"][pairs], axis=1), axis=0)
    number = segment[head][np.repeat(crowd, size)[marked]] if key not in blocks else np.zeros(len(marked), dtype=np.int64)
    none = lambda n, kind: pa.nulls(n, kind)
    return pa.table({
        "key": pa.array([key] * (len(both) + len(marked)), pa.int32()), "crowd": pa.concat_arrays([none(len(both), pa.int32()), pa.array(number.astype(np.int32))]),
        "fp": pa.array(np.concatenate([both[:, 0], e["fp"][marked]])), "to": pa.concat_arrays([pa.array(both[:, 1].copy()), none(len(marked), pa.int64())]),
    })


def _meet_apart(rows: pa.Table, p: int, q: int) -> pa.Table:
    """All pairs of two blocks of a group's members (columns low, high, block, root, fp, n, segment, c0, c1, parity) that are in two components."""
    e = np.empty(rows.num_rows, dtype=_ENTRY)
    for name in ("fp", "n", "segment"):
        e[name] = rows.column(name).to_numpy()
    e["check"] = np.column_stack([rows.column(c).to_numpy().view(np.uint64) for c in ("c0", "c1")])
    block, root, segment = (rows.column(c).to_numpy() for c in ("block", "root", "segment"))
    low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
    parity = rows.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY_WORDS)
    n = e["n"].astype(np.int64)
    first = np.flatnonzero(block == low)
    second = first if low == high else np.flatnonzero(block == high)
    found = []
    for k in range(0, len(first), 128):
        a, b = np.repeat(first[k : k + 128], len(second)), np.tile(second, len(first[k : k + 128]))
        good = (root[a] != root[b]) & ((second is not first) | (a < b)) & (np.bitwise_count(segment[a] ^ segment[b]) <= 2)
        a, b = a[good], b[good]
        good = _may_link(e, a, b, p, q)
        a, b = a[good], b[good]
        good = (p + q) * np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64) <= (q - p) * (n[a] + n[b])
        a, b = e["fp"][a[good]], e["fp"][b[good]]
        found.append(np.column_stack([np.minimum(a, b), np.maximum(a, b)]))
    both = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=np.int64)
    return pa.table({"fp": pa.array(both[:, 0].copy()), "to": pa.array(both[:, 1].copy())})


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """fp and grams (the whole set) of each text, each set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_chunks(batches):
            grams, bounds = shingle_sets(batch.column(0), shingle)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(grams.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names_of(grams, bounds).view(np.int64)), lists], names=["fp", "grams"])

    return common.map_arrow(docs.select("text"), run, "fp long, grams array<long>").dropDuplicates(["fp"])


def verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, shingle: int, p: int, q: int) -> DataFrame:
    """The pairs (fp, to) whose sets have the similarity p / q or more: by parity sketches, which only strike what is certainly too far
    apart, then by the whole sets, made of one text each of the names that are still in a pair."""

    def with_both(some: DataFrame, sides: DataFrame) -> DataFrame:
        return some.join(sides.toDF("fp", "x"), "fp").join(sides.toDF("to", "y"), "to")

    differ = F.aggregate(F.zip_with("x.parity", "y.parity", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    near = with_both(pairs, distinct.select("fp", F.struct("n", "parity"))).where((p + q) * differ <= (q - p) * (F.col("x.n") + F.col("y.n")))
    near = common.written(near.select("fp", "to"), "near")
    wanted = near.select("fp").unionByName(near.select(F.col("to").alias("fp"))).distinct()
    one = common.written(distinct.join(wanted, "fp", "left_semi").select(F.col("least").alias("of_id"), F.col("text_key").alias("of_key")), "wanted")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("key")).join(one, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left_semi")
    sets = common.written(sets_of(texts, shingle), "sets")
    agree = F.size(F.array_intersect("x", "y"))
    return common.written(with_both(near, sets).where((p + q) * agree >= p * (F.size("x") + F.size("y"))).select("fp", "to"), "verified")


def near_links(distinct: DataFrame, verify: Callable[[DataFrame], DataFrame], similarity: float, group_rows: int = 1 << 20, top_bits: int | None = None, all_pairs: int = 16) -> DataFrame:
    """(fp, to): links that join all pairs which meet and which `verify` keeps; distinct: fp, n, w0, ..., parity without repeats."""
    share = Fraction(str(similarity))
    p, q = share.numerator, share.denominator
    rows = distinct.where("n > 0").select("fp", "n", *_WIDE)
    if top_bits is None:
        top_bits = min(SEGMENT_BITS, max(3, math.ceil(math.log2(max(1, 12 * rows.count() / group_rows)))))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = np.unique(_groups(_read(batch)[2], top_bits), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "n"])

    # one entry for group_rows rows at least
    large = common.map_arrow(rows, sizes, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > group_rows).collect()
    blocks = {r["key"]: -(-r["n"] // group_rows) for r in large}
    dealt = common.map_arrow(rows, lambda it: _deal(it, top_bits, blocks), "key int, block int, entries binary")
    found = common.written(dealt.groupBy("key", "block").applyInArrow(lambda x: _meet(x, top_bits, blocks, p, q, all_pairs), "key int, crowd int, fp long, to long"), "met")
    pairs = common.written(found.where("to is not null").select("fp", "to").distinct(), "pairs")
    links = verify(pairs)
    marked = found.where("to is null").select("key", "crowd", "fp")
    if marked.isEmpty():
        return links
    named = marked.join(components(links), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = named.groupBy("key", "crowd").agg(F.count("*").alias("m"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", "crowd", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = named.join(open_, ["key", "crowd"]).join(distinct.select("fp", "n", *_WIDE, "parity"), "fp").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.shiftright("key", top_bits)
    word = F.element_at(F.array(*_WIDE[:4]), F.floor(part / 3).cast("int") + 1)
    shifted = F.expr(f"shiftrightunsigned(_word, {SEGMENT_BITS} * (shiftright(key, {top_bits}) % 3))")
    dealt = dealt.withColumn("_word", word).withColumn("segment", shifted.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))
    dealt = dealt.select("key", "crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "root", "fp", "n", "segment", F.col("w4").alias("c0"), F.col("w5").alias("c1"), "parity")
    apart = dealt.groupBy("key", "crowd", "low", "high").applyInArrow(lambda x: _meet_apart(x, p, q), "fp long, to long")
    more = common.written(apart.distinct().join(pairs, ["fp", "to"], "left_anti"), "pairs")
    return links if more.isEmpty() else links.unionByName(verify(more))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, keep: tuple[str, ...] = ("doc_id",), all_pairs: int = 16) -> DataFrame:
    """Columns `keep`, fp (a name of the set of shingles), root and component_id for each row; texts of that Jaccard similarity or more are
    linked. keep must hold doc_id."""
    share = Fraction(str(similarity))
    keyed = docs.select(*dict.fromkeys([*keep, "text"])).withColumn("_key", F.xxhash64("text"))
    marked = common.written(sketches(keyed, shingle, (*keep, "_key")), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_key").alias("key")))
    once = marked.dropDuplicates(["fp"]).select("fp", "n", *_WIDE, "parity")
    distinct = common.written(marked.groupBy("fp").agg(first.alias("one")).join(once, "fp").select("fp", F.col("one.id").alias("least"), F.col("one.key").alias("text_key"), "n", *_WIDE, "parity"), "distinct")
    links = near_links(distinct, lambda pairs: verified(pairs, docs, distinct, shingle, share.numerator, share.denominator), similarity, all_pairs=all_pairs)
    return _named(marked.select(*keep, "fp"), distinct.select("fp", "least"), components(links))
