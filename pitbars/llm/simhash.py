"""SimHash near-dedup by ball hashing, met in the middle.

A fingerprint has 64 bits; two link at `radius` (3) or fewer differing bits. Split into two halves, one half of such a pair differs
in 1 bit at most, half the radius. So every distinct fingerprint emits, for each half, all variants of that half within one bit
(66 rows), Spark shuffles on (half, variant), and a pair meets where the variant of one is the half of the other. A group of one
variant is verified in numpy; its links leave as a star to the smallest fingerprint of each piece, never as all pairs. A group with
more than `group_limit` fingerprints of exactly that half is dealt anew by the same rule one level down: its members are shuffled on (half, variant,
quarter, variant of that quarter), where at most 2^16 fingerprints can be exact in both parts; every other member is held against
those while it streams by. Nothing is left out at any size.

`near_copies` has the wide fingerprints that find texts by the similarity of their shingles.

Components: alternating large-star and small-star steps on fingerprints, each written to the shared folder, until nothing changes.

Defined results: null or wordless texts have fingerprint zero and link like any other; a null doc_id gets its component but never
names one unless all are null; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import joined, lowered, split_words, text_bytes

_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes [bounds[i], bounds[i + 1]): bits set in over half of the run; zero for an empty run.

    Eight counters of eight bits ride in one 64-bit word, so runs are added up in parts of 255 hashes at most."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    parts = (counts[full] + 254) // 255
    owner = np.repeat(np.arange(len(full)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = bounds[full][owner] + nth * 255
    heads = np.cumsum(parts) - parts
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, begin)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        major = 2 * sums > counts[full][:, None]
        for byte in range(8):
            out[full] |= major[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprints_of(column: pa.Array, shingle: int) -> np.ndarray:
    data, offsets = text_bytes(column)
    words = split_words(lowered(data), offsets, "solid")
    counts = words.counts
    per_doc = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    text, starts, ends = joined(words)
    text = text.tobytes()
    doc = np.repeat(np.arange(len(counts)), per_doc)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + words.bounds[:-1][doc]
    last = first + np.minimum(counts[doc], shingle) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], 42) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), dtype=np.uint64, count=len(doc)) if len(doc) else np.empty(0, np.uint64)
    return majority_bits(hashes, np.concatenate([[0], np.cumsum(per_doc)]))


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` and fp (long: the 64 bits) for each row of docs."""
    schema = common.schema_of(docs, keep, "fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_chunks(batches):
            at = {name: k for k, name in enumerate(batch.schema.names)}
            fp = fingerprints_of(batch.column(at["text"]), shingle)
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in keep), pa.array(fp.view(np.int64))], names=[*keep, "fp"])

    return common.map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of `bits` bits with at most `radius` of them set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], dtype=np.uint64)


def _variants(fp: np.ndarray, shift: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's part (bits from shift) with every mask of the ball: (variants, row of the fingerprint)."""
    part = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    ball = _ball(bits, radius)
    return (part[:, None] ^ ball[None, :]).ravel(), np.repeat(np.arange(len(fp)), len(ball))


def _stars(n: int, left: np.ndarray, right: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a small graph over rows 0..n-1: (rows that are not the smallest of their piece, that smallest row), by value."""
    order = np.argsort(value, kind="stable")
    label = np.empty(n, dtype=np.int64)
    label[order] = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = np.minimum(label, label[order[label]])
        if np.array_equal(label, before):
            break
    rows = np.flatnonzero(order[label] != np.arange(n))
    return rows, order[label[rows]]


def _linked(fp: np.ndarray, group: np.ndarray, is_self: np.ndarray, fresh: np.ndarray, radius: int, block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Star links among rows that lie by (group, not is_self): each fresh row is held against the selves of its group before it."""
    n = len(fp)
    index = np.arange(n)
    head = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.maximum.accumulate(np.where(head, index, 0))
    selves = np.cumsum(is_self) - is_self
    partners = np.where(fresh, selves - selves[begin], 0)
    total = np.concatenate([[0], np.cumsum(partners)])
    left, right = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + block, side="right")) - 1)
        count = partners[at:stop]
        if total[stop] > total[at]:
            a = np.repeat(index[at:stop], count)
            b = np.repeat(begin[at:stop], count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
            good = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            if good.any():
                left, right = _stars(n, np.concatenate([left, a[good]]), np.concatenate([right, b[good]]), fp)
        at = stop
    return left, right


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fp -> (key, sub, own, fp): for each half the variants within one bit. own 0: the half itself, 1: a bit off."""
    for batch in batches:
        for k in range(0, batch.num_rows, 20_000):
            fp = batch.column(0).slice(k, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
            for half in (0, 1):
                variants, row = _variants(fp, 32 * half, 32, 1)
                own = np.tile(np.minimum(np.arange(33), 1), len(fp)).astype(np.int8)
                key = (variants | np.uint64(half << 32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(row), dtype=np.int32)), pa.array(own), pa.array(fp[row].view(np.int64))], names=["key", "sub", "own", "fp"])


def _variant_rows_below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) of large groups -> the same, dealt by the variants of a quarter of the other half."""
    for batch in batches:
        for k in range(0, batch.num_rows, 20_000):
            part = batch.slice(k, 20_000)
            key = part.column(0).to_numpy(zero_copy_only=False)
            fp = part.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            half = key >> 32
            exact = ((fp >> (np.uint64(32) * half.astype(np.uint64))) & np.uint64(0xFFFFFFFF)).astype(np.int64) == (key & 0xFFFFFFFF)
            for side in (0, 1):
                rows = np.flatnonzero(half == side)
                for quarter in (0, 1):
                    variants, row = _variants(fp[rows], 32 * (1 - side) + 16 * quarter, 16, 1)
                    row = rows[row]
                    flipped = np.tile(np.minimum(np.arange(17), 1), len(rows))
                    own = np.where(exact[row], flipped, 1).astype(np.int8)
                    sub = (variants.astype(np.int64) | (quarter + 1) << 16).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(sub), pa.array(own), pa.array(fp[row].view(np.int64))], names=["key", "sub", "own", "fp"])


def _verify(batches: Iterator[pa.RecordBatch], radius: int, group_limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows by (key, sub, own) -> (key, fp, to): links with key null, or members of groups of more than group_limit selves with `to` null."""
    held: dict[str, np.ndarray] | None = None  # the selves of the group that goes on
    large: tuple[int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sub, own, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        fp = fp.view(np.uint64)
        fresh = np.ones(len(key), dtype=bool)
        if held is not None and (held["key"][0], held["sub"][0]) == (key[0], sub[0]):
            key, sub, own, fp = (np.concatenate([held[name], x]) for name, x in (("key", key), ("sub", sub), ("own", own), ("fp", fp)))
            fresh = np.concatenate([np.zeros(len(held["key"]), dtype=bool), fresh])
        new = np.concatenate([[True], (np.diff(key) != 0) | (np.diff(sub) != 0)])
        group = np.cumsum(new) - 1
        is_self = own == 0
        spill = np.zeros(len(key), dtype=bool)
        if group_limit is not None:
            many = np.bincount(group[is_self], minlength=group[-1] + 1) > group_limit
            goes_on = large is not None and large == (key[0], sub[0])
            many[0] |= goes_on
            spill = many[group]
            # selves held back from an earlier batch go along when the group turns out to be large
            sent = spill & (fresh | (not goes_on))
            large = (key[-1], sub[-1]) if many[-1] else None
            if sent.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[sent]), pa.array(fp[sent].view(np.int64)), pa.nulls(int(sent.sum()), pa.int64())], names=["key", "fp", "to"])
        rest = np.flatnonzero(~spill)
        if len(rest):
            a, b = _linked(fp[rest], group[rest], is_self[rest], fresh[rest], radius)
            if len(a):
                pairs = np.unique(np.column_stack([fp[rest][a], fp[rest][b]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], names=["key", "fp", "to"])
        last = (group == group[-1]) & is_self & ~spill
        held = {"key": key[last], "sub": sub[last], "own": own[last], "fp": fp[last]} if last.any() else None


def links(distinct: DataFrame, radius: int = 3, group_limit: int = 1024) -> DataFrame:
    """(fp, to): star links that join all fingerprints within radius; distinct has one column fp, without repeats."""
    if radius != 3:
        raise ValueError("the split into halves with one flipped bit is exact for a radius of 3")
    kind = "key long, sub int, own byte, fp long"

    def verified(rows: DataFrame, limit: int | None) -> DataFrame:
        dealt = rows.repartition("key", "sub").sortWithinPartitions("key", "sub", "own", "fp")
        return common.written(common.map_arrow(dealt, lambda it: _verify(it, radius, limit), "key long, fp long, to long"), "links")

    found = verified(common.map_arrow(distinct.select("fp"), _variant_rows, kind), group_limit)
    large = found.where(F.col("to").isNull()).select("key", "fp")
    out = found.where(F.col("to").isNotNull()).select("fp", "to")
    if large.isEmpty():
        return out
    below = verified(common.map_arrow(large.distinct(), _variant_rows_below, kind), None)
    return out.unionByName(below.select("fp", "to"))


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of all nodes of edges (fp, to): large-star and small-star steps until the edges stay as they are."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    pairs = common.written(edges.select(F.greatest("fp", "to").alias("u"), F.least("fp", "to").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = least(large)
        pairs = common.written(large.join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        after = mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def _named(marked: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """marked with root and component_id by its fp; distinct: (fp, least), roots: (fp, root) of the linked ones."""
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("fp").alias("of"), "root", "component_id")
    return marked.join(named, F.col("fp") == F.col("of"), "left").drop("of")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, keep: tuple[str, ...] = ("doc_id",), group_limit: int = 1024) -> DataFrame:
    """Columns `keep`, fp (long), root (a fingerprint that names the component) and component_id (the smallest doc_id of the component) for each row; keep must hold doc_id."""
    marked = common.written(fingerprints(docs, shingle, keep), "fingerprints")
    distinct = common.written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return _named(marked, distinct, components(links(distinct, radius, group_limit)))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
