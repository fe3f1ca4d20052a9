"""Benchmark decontamination: an FM-index of each shard of training text, searched backwards for the phrases of a benchmark.

A shard is a chunk of a partition. Words outside the benchmark's vocabulary lie in no phrase, so they cut a document into runs; runs
shorter than the shortest phrase can hold none and are left out, all others are indexed. Phrases (windows of an item's words) are
searched together, their occurrences located through sampled suffix positions, held against the words themselves, and the spans merged
for each document. A benchmark of more than `part_words` words is searched in parts, one after another in the same pass over the texts;
only one part (or one item, if it is larger) is ever on the driver or in one broadcast.

Defined results: null or empty texts have no words; an item without words has no phrase; phrases of an item whose item_id is null
count as hits but not as items; items with equal phrases are all reported; repeated rows each give a row; other columns are ignored
unless named in `keep`; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .fm_index import FMIndex
from .words import Words, lowered, span_hashes, split_words, text_bytes


WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing


@dataclass
class Phrases:
    """Distinct phrases of a benchmark: symbol sequences over its vocabulary, and the items of each."""

    vocabulary: np.ndarray  # sorted word hashes; a symbol is a place in it
    symbols: np.ndarray  # of all phrases, one after another
    ends: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray  # pairs (phrase, item), by phrase
    item_from: np.ndarray
    items: list
    texts: list[bytes]  # the words of each phrase, by one space

    @classmethod
    def of(cls, items: pa.Table, window: int) -> Phrases:
        data, offsets = text_bytes(items.column("text").combine_chunks() if items.num_rows else pa.array([], pa.string()))
        data = lowered(data)
        words = split_words(data, offsets, "alnum")
        vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
        seen: dict[bytes, int] = {}
        rows: list[np.ndarray] = []
        texts: list[bytes] = []
        links: set[tuple[int, int]] = set()
        ids: list = []
        for item, item_id in enumerate(items.column("item_id").to_pylist()):
            own = symbols[words.bounds[item] : words.bounds[item + 1]].astype(np.int64)
            ids.append(None if item_id is None else str(item_id))
            for k in range(max(1, len(own) - window + 1) if len(own) else 0):
                part = own[k : k + window]
                at = seen.setdefault(part.tobytes(), len(rows))
                if at == len(rows):
                    rows.append(part)
                    texts.append(words_at(data, words, int(words.bounds[item]) + k, len(part)))
                links.add((at, item))
        pairs = np.array(sorted(links), dtype=np.int64).reshape(-1, 2)
        lengths = np.array([len(x) for x in rows], dtype=np.int64)
        joined = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        return cls(vocabulary, joined, np.cumsum(lengths), lengths, pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), ids, texts)


def words_at(data: np.ndarray, words: Words, first: int, n: int) -> bytes:
    """n words from the first one on, by one space."""
    return b" ".join(data[a:b].tobytes() for a, b in zip(words.starts[first : first + n].tolist(), words.ends[first : first + n].tolist(), strict=True))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each of counts, one after another."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total) if total else np.empty(0, dtype=np.int64)


def find_spans(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the words of all documents of a chunk: the hit mask, and distinct (document, phrase) pairs."""
    n = len(words.starts)
    hit = np.zeros(n, dtype=bool)
    none = np.empty(0, dtype=np.int64)
    if not n or not len(phrases.lengths):
        return hit, none, none
    h = span_hashes(words.data, words.starts, words.ends)
    sieve = np.zeros(1 << 20, dtype=bool)
    sieve[(phrases.vocabulary >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
    place = np.minimum(np.searchsorted(phrases.vocabulary, h[maybe]), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[place] == h[maybe]
    maybe, place = maybe[known], place[known]
    # runs of known words within one document
    doc = np.searchsorted(words.bounds, maybe, side="right") - 1
    new = np.ones(len(maybe), dtype=bool)
    new[1:] = (np.diff(maybe) != 1) | (np.diff(doc) != 0)
    begin = np.flatnonzero(new)
    length = np.diff(np.concatenate([begin, [len(maybe)]]))
    long = length >= phrases.lengths.min()
    begin, length = begin[long], length[long]
    if not len(begin):
        return hit, none, none
    taken = _spread(begin, length)
    index = FMIndex(place[taken], length, len(phrases.vocabulary))
    index.forget_order()
    got, low, high = index.matches(phrases.symbols, phrases.ends, phrases.lengths)
    found = np.flatnonzero(got == phrases.lengths)
    counts = high[found] - low[found]
    where = index.locate(_spread(low[found], counts))
    which = np.repeat(found, counts)
    # index position -> word of the chunk; each run is followed by one separator
    run_at = np.cumsum(length + 1) - (length + 1)
    run = np.searchsorted(run_at, where, side="right") - 1
    word = maybe[begin[run]] + (where - run_at[run])
    same = np.array([words_at(words.data, words, w, int(phrases.lengths[p])) == phrases.texts[p] for w, p in zip(word.tolist(), which.tolist(), strict=True)], dtype=bool)
    word, which = word[same], which[same]
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, word, 1)
    np.add.at(edges, word + phrases.lengths[which], -1)
    hit = np.cumsum(edges[:-1]) > 0
    doc = np.searchsorted(words.bounds, word, side="right") - 1
    pairs = np.unique(doc * len(phrases.lengths) + which)
    return hit, pairs // len(phrases.lengths), pairs % len(phrases.lengths)


def _parts(benchmark: DataFrame, part_words: int) -> Iterator[DataFrame]:
    """The benchmark in parts of about part_words words at most; an item is never cut."""
    rows = benchmark.select("item_id", "text")
    total = rows.select(F.coalesce(F.sum(F.regexp_count("text", F.lit(WORD))), F.lit(0))).first()[0]
    n = -(-total // part_words)
    if n <= 1:
        yield rows
        return
    for k in range(2 * n):
        yield rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n)) == k)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), cut: bool = False, part_words: int = 2_000_000) -> DataFrame:
    """For each document: columns `keep`, n_words, n_hit, n_items, items (sorted ids), contaminated, spans (word intervals to remove) and
    clean_text (the text without them; null if cut is not set)."""
    spark = docs.sparkSession
    common.reserved(keep, ("n_words", "n_hit", "n_items", "items", "contaminated", "spans", "clean_text"))
    kept = [f"k{i}" for i in range(len(keep))]
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("length", pa.int64())]))
    state = "_items array<string>, _spans array<struct<first: long, length: long>>"
    out = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)), "text")
    parts = list(_parts(benchmark, part_words))
    for nth, part in enumerate(parts):
        shared, last = spark.sparkContext.broadcast(Phrases.of(part.toArrow(), window)), nth == len(parts) - 1
        schema = common.schema_of(out, kept if last else [*kept, "text"], f"n_words long, {state}, clean_text string" if last else state)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, last=last, names=tuple(schema.names)) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in common.in_chunks(batches):
                at = {name: k for k, name in enumerate(batch.schema.names)}
                data, offsets = text_bytes(batch.column(at["text"]))
                words = split_words(lowered(data), offsets, "alnum")
                hit, doc, phrase = find_spans(words, phrases)
                of_doc: dict[int, set] = {}
                for d, p in zip(doc.tolist(), phrase.tolist(), strict=True):
                    of_doc.setdefault(d, set()).update(phrases.item_of[phrases.item_from[p] : phrases.item_from[p + 1]].tolist())
                items, spans = (batch.column(at[c]).to_pylist() if c in at else [[]] * batch.num_rows for c in ("_items", "_spans"))
                for d, found in of_doc.items():
                    items[d] = sorted({*items[d], *(phrases.items[i] for i in found if phrases.items[i] is not None)})
                    own = hit[words.bounds[d] : words.bounds[d + 1]].astype(np.int8)
                    for x in spans[d]:  # of earlier parts
                        own[x["first"] : x["first"] + x["length"]] = 1
                    own = np.diff(np.concatenate([[0], own, [0]]))
                    spans[d] = [{"first": a, "length": b - a} for a, b in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist(), strict=True)]
                found = [pa.array(items, pa.list_(pa.string())), pa.array(spans, span_type)]
                if not last:
                    yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in [*kept, "text"]), *found], names=names)
                    continue
                clean = batch.column(at["text"]).to_pylist() if cut else [None] * batch.num_rows
                for d, cuts in enumerate(spans) if cut else ():
                    here, rest = int(offsets[d]), []
                    for span in cuts:
                        a = int(words.bounds[d]) + span["first"]
                        rest.append(data[here : words.starts[a]].tobytes())
                        here = int(words.ends[a + span["length"] - 1])
                    if cuts:
                        clean[d] = b"".join([*rest, data[here : offsets[d + 1]].tobytes()]).decode()
                yield pa.RecordBatch.from_arrays([*(batch.column(at[k]) for k in kept), pa.array(words.counts, pa.int64()), *found, pa.array(clean, pa.string())], names=names)

        out = common.map_arrow(out, search, schema)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), "n_words", n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.col("_items").alias("items"), (F.size("_spans") > 0).alias("contaminated"), F.col("_spans").alias("spans"), "clean_text")


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
      FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)),
m AS (SELECT g.r, g.i, g.k, p.item_id FROM g JOIN p USING (k, s)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
