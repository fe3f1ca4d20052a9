"""Phrase collocation mining by dynamic itemset counting over cyclic scans of shards.

The texts are dealt to `shards` shards, scanned in turn, again and again. All lengths are counted in the same scans, interleaved: words
from the first shard on; a longer phrase once both its subphrases, the one without its last and the one without its first word, have
been seen to reach `min_count`, be it in one shard alone or in all counts of a length that has been through its cycle. Each phrase is
counted until it has been through every shard, a full cycle from where it began. Length k is complete after k cycles, when its counts
are added up; a scan that could count nothing new is left out.

What has been activated is kept in one bit filter for each length (`FILTER_BITS`, whatever the input; 8 MB), which only grows. A scan counts
what the filter of now lets through and the filter of the shard's scan before did not, so every phrase that passes is counted exactly
once in each shard; a false positive is one more phrase that is counted. Filters thus prune and decide nothing: a phrase of min_count
has subphrases of min_count, so it always passes in the end, and its count is of its own words, as text.

At scale: a scan adds up within chunks and tasks before it shuffles on whole phrases; only bits of the filters and one row for each shard
reach the driver. Parts of candidates are joined by salted keys, since one word may begin very many phrases; the first of each group are
taken in two steps. Counts of a scan are written to the shared folder and removed once they are added up.

Defined results: null and empty texts have no words; a null group is `und`; repeated rows count again; ties of score and count go by the
phrase's bytes; an empty table gives no rows. Extra columns of any name play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import gram_hashes, joined, lowered, mixed, span_hashes, split_words, text_bytes

FILTER_BITS = 1 << 26
CHUNK = 4 << 20
SALTS = 8
#: A phrase of a group is one key in the counts: the group, a tab (which no word holds) and the phrase.
_COUNTS = "key string, n long"
_STEP = "key string, n long, k int"
#: What ends a piece besides [\x0A-\x0D], which the splitter takes as white space.
_BREAKS = np.array([chr(b) in ".,;:!?\n\v\f\r" for b in range(256)])
_AS_LINES = np.where(_BREAKS, 10, np.arange(256)).astype(np.uint8)


def _seeds(langs: pa.Array) -> np.ndarray:
    """A hash of the group of each row, unlike that of a word of the same text."""
    data, offsets = text_bytes(langs)
    return mixed(span_hashes(data, offsets[:-1], offsets[1:]) + np.uint64(1))


def _keys(langs: pa.Array, docs: np.ndarray, text: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray, k: int) -> pa.Array:
    """Group, tab and phrase for the phrases of k words that begin at the given words of the text (see words.joined)."""
    data, starts, ends = text
    first, length = starts[at], ends[at + k - 1] - starts[at]
    offsets = np.concatenate([[0], np.cumsum(length)])
    taken = data[np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1])]
    phrases = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))
    return pc.binary_join_element_wise(langs.take(pa.array(docs[at])), phrases, "\t")


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key is first, and how often it is there."""
    codes, different = pd.factorize(keys)
    highest = np.maximum.accumulate(codes)
    return np.flatnonzero(np.concatenate([[True], codes[1:] > highest[:-1]])), np.bincount(codes, minlength=len(different))


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low, high = _places(keys)
    return ((bits[low >> 3] >> (low & 7).astype(np.uint8)) & (bits[high >> 3] >> (high & 7).astype(np.uint8)) & 1).astype(bool)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    return (keys % np.uint64(FILTER_BITS)).astype(np.int64), ((keys >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


@dataclass
class _Filters:
    """Bits of the activated phrases of each length, and how often they have changed."""

    spark: object
    longest: int
    bits: list[np.ndarray] = field(default_factory=list)
    version: list[int] = field(default_factory=list)
    sent: dict = field(default_factory=dict)

    def __post_init__(self):
        self.bits = [np.zeros(FILTER_BITS // 8, dtype=np.uint8) for _ in range(self.longest - 1)]
        self.version = [0] * (self.longest - 1)

    def add(self, found: DataFrame) -> None:
        """Adds phrases (lang, k, phrase); FILTER_BITS / 64 rows for each length reach the driver at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                length, keys = batch.column(1).to_numpy(), np.zeros(batch.num_rows, dtype=np.uint64)
                words = split_words(*text_bytes(batch.column(2)), "solid")
                h, begin = words.hashes(), words.bounds[:-1]
                for k in np.unique(length).tolist():
                    rows = np.flatnonzero(length == k)
                    keys[rows] = gram_hashes(h, k)[begin[rows]]
                places = np.stack(_places(mixed(keys ^ _seeds(batch.column(0)))))
                where, mask = (places >> 6).ravel(), np.left_shift(np.uint64(1), (places & 63).astype(np.uint64)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(length, 2)), pa.array(where), pa.array(mask.view(np.int64))], names=["k", "at", "mask"])

        rows = common.map_arrow(found.select("lang", "k", "phrase"), run, "k int, at long, mask long").groupBy("k", "at").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
        k, at, mask = (rows.column(c).to_numpy() for c in range(3))
        for length in np.unique(k).tolist():
            mine = k == length
            bits = self.bits[length - 1].copy()
            bits.view(np.uint64)[at[mine]] |= mask[mine].view(np.uint64)
            if not np.array_equal(bits, self.bits[length - 1]):
                self.bits[length - 1] = bits
                self.version[length - 1] += 1

    def broadcast(self, k: int):
        """The filter of length k as it is now, sent once."""
        key = (k, self.version[k - 1])
        if key not in self.sent:
            self.sent[key] = self.spark.sparkContext.broadcast(self.bits[k - 1].tobytes())
        return self.sent[key]

    def forget(self, kept: set) -> None:
        for key in set(self.sent) - kept:
            self.sent.pop(key).unpersist()


def _scan(shard: DataFrame, now: dict, before: dict | None, longest: int) -> DataFrame:
    """Counts of what passes the filters of now and did not pass those of before (None: the shard is scanned for the first time):
    words on the first scan, phrases of k words where both subphrases pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lambda sent: {k: np.frombuffer(b.value, dtype=np.uint8) for k, b in sent.items()}
        new, old = opened(now), opened(before or {})
        for batch in common.in_chunks(batches, CHUNK):
            langs = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            data = lowered(data)
            words = split_words(_AS_LINES[data], offsets, "solid")
            if not len(words.starts):
                continue
            docs, breaks = words.docs, np.cumsum(_BREAKS[data])
            linked = (docs[1:] == docs[:-1]) & (breaks[words.starts[1:]] == breaks[words.ends[:-1] - 1])
            h, seeds = words.hashes(), _seeds(langs)[docs]
            valid = np.ones(len(h), dtype=bool)
            keys, text = mixed(h ^ seeds), joined(words)
            for k in range(1, longest + 1):
                if k == 1:
                    places = np.arange(len(h)) if before is None else np.empty(0, dtype=np.int64)
                else:
                    # both subphrases of k - 1 words pass
                    fresh = valid[:-1] & linked[k - 2 :]
                    if k - 1 in new:
                        part = _passes(new[k - 1], keys)
                        counts = fresh & part[:-1] & part[1:]
                        if k - 1 in old:
                            part = _passes(old[k - 1], keys)
                            counts &= ~(part[:-1] & part[1:])
                    else:
                        counts = np.zeros(len(fresh), dtype=bool)
                    valid, places = fresh, np.flatnonzero(counts)
                    grams = gram_hashes(h, k)
                    keys = mixed(grams ^ seeds[: len(grams)])
                if len(places):
                    first, n = _counted(keys[places])
                    yield pa.RecordBatch.from_arrays([_keys(langs, docs, text, places[first], k), pa.array(n)], names=["key", "n"])
                if len(h) <= k:
                    break

    length = F.octet_length(F.substring_index("key", "\t", -1)) - F.octet_length(F.replace(F.substring_index("key", "\t", -1), F.lit(" "), F.lit(""))) + 1
    return common.map_arrow(shard.select("lang", "text"), run, _COUNTS).groupBy("key").agg(F.sum("n").alias("n")).withColumn("k", length)


def _apart(counts: DataFrame) -> DataFrame:
    """lang, k, phrase, n of counts by key. A group may hold a tab, a phrase never does."""
    phrase = F.substring_index("key", "\t", -1)
    return counts.select(F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)").alias("lang"), "k", phrase.alias("phrase"), "n")


def count_phrases(docs: DataFrame, group: str = "lang", min_count: int = 10, longest: int = 3, shards: int = 4) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): lang, k, phrase, n of every phrase of `longest` words at most that occurs min_count times or more in its group;
    and lang, n of all word occurrences of each group."""
    spark = docs.sparkSession
    home = common.fresh_path(spark, "phrases")
    dealt = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("lang"), "text", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard"))
    dealt.write.partitionBy("shard").option("compression", "zstd").parquet(f"{home}/shards")
    read = lambda path, schema: spark.read.schema(schema).parquet(path)
    texts = read(f"{home}/shards", "lang string, text string, shard int")
    filters, scanned, counted, done = _Filters(spark, longest), {}, {k: [] for k in range(1, longest + 1)}, []
    totals = None
    for step in range(longest * shards):
        shard, seen = step % shards, tuple(filters.version)
        before = scanned.get(shard)
        if before != seen:
            # lengths whose filter is empty count nothing; those whose filter has not changed count nothing new
            news = {k for k in range(1, longest) if seen[k - 1] and (before is None or before[k - 1][0] != seen[k - 1])}
            was = None if before is None else {k: before[k - 1][1] for k in news if before[k - 1][0]}
            if before is None or news:
                path = f"{home}/step{step}"
                now = {k: filters.broadcast(k) for k in news}
                _scan(texts.where(F.col("shard") == shard), now, was, longest).write.partitionBy("k").parquet(path)
                for k in range(1, longest + 1):
                    counted[k].append(path)
                scanned[shard] = [(seen[k - 1], filters.broadcast(k) if seen[k - 1] else None) for k in range(1, longest)]
                frequent = read(path, _STEP).where((F.col("n") >= min_count) & (F.col("k") < longest))
                filters.add(_apart(frequent))
                kept = {(k, s[k - 1][0]) for s in scanned.values() for k in range(1, longest)}
                filters.forget(kept | {(k, filters.version[k - 1]) for k in range(1, longest)})
        if (step + 1) % shards == 0:
            k = (step + 1) // shards  # this length has been through its cycle
            parts = reduce(DataFrame.unionByName, [read(path, _STEP) for path in counted[k]]).where(F.col("k") == k)
            if k == 1:
                totals = common.written(_apart(parts).groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
            whole = common.written(_apart(parts.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).withColumn("k", F.lit(k))), "phrase-counts")
            for path in counted[k]:
                common.removed(spark, f"{path}/k={k}")
            done.append(whole)
            if k < longest:
                filters.add(whole)
    filters.forget(set())
    common.removed(spark, home)
    return reduce(DataFrame.unionByName, done), totals


def collocations(docs: DataFrame, group: str = "lang", min_count: int = 10, longest: int = 3, shards: int = 4, top: int = 2000, inside: int = 50) -> DataFrame:
    """The first `top` phrases of two words or more in each group: lang, rank, phrase, a, l, r, n, score.

    A phrase of count a cut in two parts of counts l and r scores floor(10^6 a a / (l r)), its lowest cut counting (the first of those
    equal). A phrase contiguous in a longer one that occurs `inside` in a hundred times as often, or more, is left out."""
    phrases, totals = count_phrases(docs, group, min_count, longest, shards)
    words = F.split("phrase", " ")
    text = lambda parts: F.array_join(parts, " ")
    candidates = phrases.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k", words.alias("w"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda j: F.array(F.struct(j.alias("j"), F.lit(True).alias("head"), text(F.slice("w", F.lit(1), j)).alias("part")), F.struct(j.alias("j"), F.lit(False).alias("head"), text(F.slice("w", j + 1, F.col("k") - j)).alias("part")))))
    asked = candidates.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))
    known = phrases.where(F.col("k") < longest).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"), F.explode(F.array(*(F.lit(s).cast("long") for s in range(SALTS)))).alias("salt"))
    found = asked.join(known, ["lang", "part", "salt"]).select("lang", "phrase", "a", "j", "head", "f", F.lit(None).cast("long").alias("longer"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: text(F.slice("w", i, m)))))
    held = candidates.where("k > 2").select("lang", F.explode(spans).alias("phrase"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("boolean").alias("head"), F.lit(None).cast("long").alias("f"), F.col("a").alias("longer"))
    pick = lambda j, head: F.max(F.when((F.col("j") == j) & (F.col("head") == head), F.col("f")))
    sides = [(j, f"l{j}", f"r{j}") for j in range(1, longest)]
    both = found.unionByName(held).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *(pick(j, True).alias(left) for j, left, _ in sides), *(pick(j, False).alias(right) for j, _, right in sides))
    kept = both.where("a IS NOT NULL AND NOT coalesce(100 * longer >= {inside} * a, false)".format(inside=inside))
    # fourteen digits each: the products stay within the 38 of a decimal
    d = lambda c: f"cast({c} as decimal(14,0))"
    scored = [F.expr(f"CASE WHEN {left} IS NOT NULL THEN named_struct('score', (cast(1000000 as decimal(7,0)) * ({d('a')} * {d('a')})) div ({d(left)} * {d(right)}), 'j', {j}, 'l', {left}, 'r', {right}) END") for j, left, right in sides]
    best = kept.withColumn("x", F.array_min(F.array(*scored))).select("lang", "phrase", "a", "x.l", "x.r", "x.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = best.withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM lists, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS j FROM candidates),
parts AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.j], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1 :], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE NOT coalesce(100 * g.a >= 50 * b.a, false))
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY k.score DESC, k.a DESC, k.phrase) AS rank, k.phrase, k.a, k.l, k.r, t.n, k.score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang QUALIFY rank <= 2000
"""
