"""Substring dedup: words of passages that also stand in a document with a smaller id, found by FM-indexes of content shards.

A shard holds all passages that share an anchor, so that equal windows always meet in one shard and no document is held against
every shard. Steps:

1. Chunks of documents are cut into windows of `window` words; neighbouring windows with the same anchor (the smallest hash of
   `anchor_words` consecutive words in the window) make a passage. Equal passages of a chunk are sent once, under the smallest id
   (the others are known to be repeats and go to any shard); so a passage that a third of all documents hold is sent once for each chunk.
   Anchors of very many different passages (a common phrase with other words around it) are counted first; windows of such an anchor
   are placed by the hash of all their words instead, which splits the group and still keeps equal windows together.
2. A shard keeps passages whose anchor more than one document holds. A passage that a smaller document holds word for word is a
   removal interval at once. Of the others, some anchors at a time, it builds an FM-index over a wavelet matrix and streams them
   through it: matching statistics, capped at the window length, and the smallest document id among the rows of each full match.
   Places where that id is smaller than the own are removal intervals. So what an index takes doesn't follow the share of the
   shard that is repeated, which is all of it where documents come again whole.
3. Intervals are written to the shared folder, and go back to the documents. doc_id must be a number; one that is none is an error.

Defined results: null texts have no words; a null doc_id is neither compared nor removed from; repeated rows with one doc_id do not
count against each other; documents of fewer words than the window stay whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fm_index import FMIndex
from .words import gram_hashes, joined, split_words, text_bytes

_PASSAGES = "shard int, n long, ids binary, keys binary, firsts binary, tags binary, passages binary, repeats binary"
_FOUND = "doc_id long, text_key long, intervals binary"
PASSAGE_BYTES = 4 << 20  # of a chunk: larger ones know more repeats at once and pack better
KEY_BITS = 32  # of the hash that tells rows with one doc_id and different texts apart
HOT_ANCHORS = 1 << 18  # at most so many anchors are split (8 bytes each to every task)
HOT_PASSAGES = 20_000  # an anchor of fewer passages fits a task anyway
INDEX_WORDS = 1 << 18  # of an FM-index (about 150 bytes each while it is built and searched), or all words of one anchor


def _packed(values, dtype) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.asarray(values, dtype=dtype).tobytes())


def _unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=dtype)


def _packed_ascending(values: np.ndarray) -> bytes:
    """Ascending integers as differences, a byte plane each, which leaves little of them."""
    return _packed(np.diff(values, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T, np.uint8)


def _unpacked_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unpacked(data, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _packed_places(values) -> bytes:
    """Small integers, a byte plane each."""
    return _packed(np.asarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T, np.uint8)


def _unpacked_places(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _tags(anchor: np.ndarray) -> bytes:
    """24 bits of each anchor: few passages of a shard share them by chance, and such passages are told apart by the index."""
    return np.ascontiguousarray((anchor >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _read_tags(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
    return parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, have = h, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(anchor: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First windows of the passages, and the windows after their last: neighbours of one document with one anchor."""
    m = len(anchor)
    inside = doc[:m] == doc[window - 1 :]
    new = np.ones(m, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:m] != doc[: m - 1]) | ~inside[:-1]
    return np.flatnonzero(new & inside), np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]])) + 1


def _frequent(anchors: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts summed by anchor, `most` of them at most: a mergeable summary, so that a count falls short by total / (most + 1) at most."""
    anchors, inverse = np.unique(anchors, return_inverse=True)
    counts = np.bincount(inverse, weights=counts, minlength=len(anchors)).astype(np.int64)
    if len(anchors) > most:
        counts = counts - np.partition(counts, -most - 1)[-most - 1]
    return anchors[counts > 0], counts[counts > 0]


def hot_anchors(docs: DataFrame, window: int, anchor_words: int, most: int = HOT_ANCHORS, floor: int = HOT_PASSAGES) -> np.ndarray:
    """Sorted hashes of anchors that very many different passages have, from all documents: every one of more than
    2 * floor + 2 * passages / most passages, and none of fewer than floor or passages / (most + 1). So there are `most` + 1 at most."""
    n_parts = max(1, docs.rdd.getNumPartitions())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, counts, held, total = [], [], 0, 0
        for batch in common.in_chunks(batches, PASSAGE_BYTES):
            words = split_words(*text_bytes(batch.column(0)), "solid")
            if len(words.starts) < window:
                continue
            hashes = words.hashes()
            anchor = _sliding_min(gram_hashes(hashes, anchor_words), window - anchor_words + 1)
            whole = gram_hashes(hashes, window)
            begin, stop = _runs(anchor, words.docs, window)
            # passages of a chunk that begin and end alike are sent once
            own = np.unique(np.rec.fromarrays([anchor[begin], whole[begin] ^ (whole[stop - 1] << np.uint64(1))]))["f0"]
            found, n = np.unique(own, return_counts=True)
            anchors.append(found)
            counts.append(n)
            held, total = held + len(found), total + len(own)
            if held > 4 * most:
                a, n = _frequent(np.concatenate(anchors), np.concatenate(counts), most)
                anchors, counts, held = [a], [n], len(a)
        if total:
            a, n = _frequent(np.concatenate(anchors), np.concatenate(counts), most)
            many = n >= max(total / (most + 1), floor / n_parts)
            yield pa.RecordBatch.from_arrays([pa.array([None, *a[many].view(np.int64).tolist()], pa.int64()), pa.array([total, *n[many].tolist()], pa.int64())], names=["anchor", "n"])

    counted = common.map_arrow(docs.where("doc_id is not null").select("text"), count, "anchor long, n long")
    sums = common.written(counted.groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = sums.where("anchor is null").agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("anchor").isNotNull() & (F.col("n") >= max(floor, total / (most + 1)))).select("anchor").collect()
    return np.sort(np.array([x[0] for x in hot], dtype=np.int64).view(np.uint64))


def passages_of(batch: pa.RecordBatch, window: int, anchor_words: int, n_shards: int, hot: np.ndarray) -> Iterator[tuple]:
    """Rows of _PASSAGES for a chunk with columns doc_id and text; windows whose anchor is in `hot` have all their words for an anchor."""
    ids = batch.column(batch.schema.get_field_index("doc_id"))
    batch = batch.filter(ids.is_valid())
    if not batch.num_rows:
        return
    order = np.argsort(batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False), kind="stable")
    batch = batch.take(pa.array(order))
    ids = batch.column(batch.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    words = split_words(data, offsets, "solid")
    if len(words.starts) < window:
        return
    raw = memoryview(data)
    keys = np.array([xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], dtype=np.uint64).view(np.int64) & ((1 << KEY_BITS) - 1)
    hashes, doc = words.hashes(), words.docs
    anchor = _sliding_min(gram_hashes(hashes, anchor_words), window - anchor_words + 1)
    if len(hot):
        split = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
        anchor = np.where(split, gram_hashes(hashes, window), anchor)
    begin, stop = _runs(anchor, doc, window)
    if not len(begin):
        return
    text, starts, ends = joined(words)
    text = text.tobytes()
    shard = (anchor[begin] % np.uint64(n_shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    begin, stop, shard = begin[order], stop[order], shard[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    low, high = starts[begin].tolist(), ends[stop + window - 2].tolist()
    first = (begin - words.bounds[doc[begin]]).tolist()
    owner, n_windows = doc[begin].tolist(), (stop - begin).tolist()
    anchors = anchor[begin]
    repeats = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(begin)], strict=True):
        seen: dict[bytes, int] = {}
        kept = []
        for k in range(a, b):
            passage = text[low[k] : high[k]]
            held = seen.setdefault(passage, owner[k])  # documents come by id: the first holder has the smallest
            if ids[held] < ids[owner[k]]:
                repeats += (owner[k], first[k], n_windows[k] + window - 1)
            else:
                kept.append(k)
        own = np.array([owner[k] for k in kept])
        body = b"\n".join([text[low[k] : high[k]] for k in kept])
        yield (int(shard[a]), len(kept), _packed_ascending(ids[own]), _packed(keys[own], np.uint32), _packed_places([first[k] for k in kept]), _tags(anchors[kept]), zstandard.ZstdCompressor(level=3).compress(body), _packed([], np.int64))
    if repeats:  # any shard will do: one by the chunk, so that a passage of very many documents fills none
        rep = np.array(repeats, dtype=np.int64).reshape(-1, 3)
        rep = np.column_stack([ids[rep[:, 0]], keys[rep[:, 0]], rep[:, 1:]])
        rep = rep[np.lexsort((rep[:, 2], rep[:, 0]))]
        yield (int(keys[0]) % n_shards, 0, _packed_ascending(np.array([], dtype=np.int64)), _packed([], np.uint32), _packed_places([]), b"", b"", _packed(rep, np.int64))


def _several(tag: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which passages, sorted by tag and document, have a tag that more than one document holds."""
    if not len(tag):
        return np.empty(0, dtype=bool)
    head = np.flatnonzero(np.diff(tag, prepend=-1) != 0)
    stop = np.append(head[1:], len(tag))
    return np.repeat(doc[head] != doc[stop - 1], stop - head)


def _copies(tag: np.ndarray, doc: np.ndarray, passages: list[bytes]) -> np.ndarray:
    """Which passages, sorted by tag and document, a smaller document holds word for word: no window of theirs needs them in the index."""
    out, seen, at = np.zeros(len(doc), dtype=bool), {}, -1
    for k, (t, d) in enumerate(zip(tag.tolist(), doc.tolist(), strict=True)):
        if t != at:
            seen, at = {}, t
        out[k] = seen.setdefault(passages[k], d) < d
    return out


def _indexed_repeats(doc: np.ndarray, key: np.ndarray, first: np.ndarray, passages: list[bytes], window: int) -> np.ndarray:
    """Rows (doc_id, key, first word, number of words) of what the passages repeat of each other, by an FM-index of them."""
    lengths = np.array([p.count(b" ") + 1 for p in passages])
    symbols, vocabulary = pd.factorize(np.array(b" ".join(passages).split(b" "), dtype=object))
    index = FMIndex(symbols, lengths, len(vocabulary), sample=0)
    starts = np.cumsum(lengths) - lengths
    n_windows = lengths - window + 1
    owner = np.repeat(np.arange(len(lengths)), n_windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    # the statistics of a passage never leave it: each end has `window` symbols of its own passage before it
    got, low, high = index.matches(symbols, starts[owner] + offset + window, window, rows=2)
    holder = np.searchsorted(np.cumsum(lengths + 1), index.sa, side="right")
    holder_doc = np.append(doc[np.minimum(holder, len(doc) - 1)], np.iinfo(np.int64).max)
    full = np.flatnonzero(got >= window)
    ranges, inverse = np.unique(low[full] * (index.n + 1) + high[full], return_inverse=True)
    edges = np.column_stack([ranges // (index.n + 1), ranges % (index.n + 1)]).ravel()
    least = np.minimum.reduceat(holder_doc, edges)[::2][inverse] if len(full) else np.array([], dtype=np.int64)
    bad = full[least < doc[owner[full]]]
    cut = np.ones(len(bad), dtype=bool)
    cut[1:] = (np.diff(bad) != 1) | (np.diff(owner[bad]) != 0)
    head = np.flatnonzero(cut)
    size = np.diff(np.append(head, len(bad)))
    at = owner[bad[head]]
    return np.column_stack([doc[at], key[at], first[at] + offset[bad[head]], size + window - 1])


def repeats_of(rows: pa.Table, window: int, index_words: int = INDEX_WORDS) -> pa.Table:
    """Removal intervals of a shard, a row for each document: (first word, number of words) pairs as 32-bit integers.

    Passages of one tag are indexed together, as many tags at a time as hold `index_words` words (one tag if it alone holds more)."""
    ids = [_unpacked_ascending(x.as_py()) for x in rows["ids"]]
    sizes = [len(x) for x in ids]
    doc = np.concatenate(ids)
    key = np.concatenate([_unpacked(x.as_py(), np.uint32) for x in rows["keys"]]).astype(np.int64)
    first = np.concatenate([_unpacked_places(x.as_py()) for x in rows["firsts"]])
    tag = np.concatenate([_read_tags(x.as_py()) for x in rows["tags"]]).astype(np.int64)
    found = [_unpacked(x.as_py(), np.int64).reshape(-1, 4) for x in rows["repeats"]]
    order = np.lexsort((doc, tag))
    keep = np.zeros(len(order), dtype=bool)
    keep[order] = _several(tag[order], doc[order])
    passages = []
    for body, own in zip(rows["passages"], np.split(keep, np.cumsum(sizes)[:-1]), strict=True):
        if own.any():
            parts = zstandard.ZstdDecompressor().decompress(body.as_py()).split(b"\n")
            passages += [parts[k] for k in np.flatnonzero(own).tolist()]
    doc, key, first, tag = doc[keep], key[keep], first[keep], tag[keep]
    order = np.lexsort((doc, tag))
    doc, key, first, tag, passages = doc[order], key[order], first[order], tag[order], [passages[k] for k in order.tolist()]
    lengths = np.array([p.count(b" ") + 1 for p in passages], dtype=np.int64)
    copies = _copies(tag, doc, passages)
    found.append(np.column_stack([x[copies] for x in (doc, key, first, lengths)]))
    left = np.flatnonzero(~copies)
    left = left[_several(tag[left], doc[left])]
    if len(left):
        before = np.cumsum(lengths[left]) - lengths[left]
        head = np.flatnonzero(np.diff(tag[left], prepend=-1) != 0)
        for part in np.split(left, head[np.flatnonzero(np.diff(before[head] // index_words) != 0) + 1]):
            found.append(_indexed_repeats(doc[part], key[part], first[part], [passages[k] for k in part.tolist()], window))
    rows = np.concatenate(found)
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    cuts = np.flatnonzero(np.any(np.diff(rows[:, :2], axis=0) != 0, axis=1)) + 1
    parts = np.split(rows, cuts) if len(rows) else []
    return pa.table({"doc_id": pa.array([int(p[0, 0]) for p in parts], pa.int64()), "text_key": pa.array([int(p[0, 1]) for p in parts], pa.int64()), "intervals": pa.array([p[:, 2:].astype("<u4").tobytes() for p in parts], pa.binary())})


def repeated_words(docs: DataFrame, window: int = 13, anchor_words: int = 5, n_shards: int | None = None, hot_passages: int = HOT_PASSAGES) -> DataFrame:
    """Removal intervals: (doc_id long, text_key long, intervals binary), a row for each document and shard that found any.

    n_shards: by default four for each input partition, so that a shard stays as large as the input grows. hot_passages: from how many
    passages on an anchor is split. docs is read once to count anchors and once to place passages.
    """
    n_shards = n_shards or 4 * max(2, docs.rdd.getNumPartitions())
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, window, anchor_words, floor=hot_passages))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PASSAGES.split(", ")]
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        for batch in common.in_chunks(batches, PASSAGE_BYTES):
            if rows := list(passages_of(batch, window, anchor_words, n_shards, hot.value)):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    passages = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PASSAGES)
    return common.group_arrow(passages.groupBy("shard"), lambda rows: repeats_of(rows, window), _FOUND)


def dedup_substrings(docs: DataFrame, window: int = 13, anchor_words: int = 5, n_shards: int | None = None, hot_passages: int = HOT_PASSAGES) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    with common.settings(docs.sparkSession, common.TIDY):  # the passages sent to the shards go from the disks before the texts are joined
        found = repeated_words(docs, window, anchor_words, n_shards, hot_passages).groupBy("doc_id", "text_key").agg(F.collect_list("intervals").alias("intervals"))
        found = common.written(found, "intervals")
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_key": "found_key"})
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = keyed.withColumn("text_key", F.xxhash64("text").bitwiseAND(F.lit((1 << KEY_BITS) - 1))).join(found, (F.col("doc_id") == F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_chunks(batches):
            data, offsets = text_bytes(batch.column(1))
            words = split_words(data, offsets, "solid")
            gone = np.zeros(len(words.starts) + 1, dtype=np.int64)
            for d, parts in enumerate(batch.column(2).to_pylist()):
                if parts:
                    rows = np.frombuffer(b"".join(parts), dtype="<u4").reshape(-1, 2).astype(np.int64) + [words.bounds[d], 0]
                    np.add.at(gone, rows[:, 0], 1)
                    np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
            gone = np.cumsum(gone)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            n_removed = total[words.bounds[1:]] - total[words.bounds[:-1]]
            stay = ~gone
            left = split_words(words.data, offsets, "solid")
            left.starts, left.ends = words.starts[stay], words.ends[stay]
            text, starts, ends = joined(left)
            at = np.concatenate([[0], np.cumsum(words.counts - n_removed)])
            text = text.tobytes()
            spots = [*starts.tolist(), len(text)]
            kept = [text[spots[a] : max(spots[b] - 1, spots[a])] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.select("doc_id", "text", "intervals").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING count(*) > 1),
x AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (s) WHERE doc_id > least),
k AS (SELECT r, list(j) AS gone FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda y, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
