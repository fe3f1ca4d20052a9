"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source's documents, in seeded hash order, are one stream of words, cut into blocks of `block_tokens`; the stream is cut into
`shards` equal runs of blocks. The blocks of the mix are seats, awarded to sources by the highest quotients target / (2 k + 1); as that
rule never takes a seat back when seats are added, the quota of shard j is what the first j + 1 parts of all seats hold more than the
first j (what a shard could only give by taking a block three times is left to the next one that has room). A source with a quota of q
in a shard of B blocks takes the shard's block i as often as floor((i q + f) / B) grows there, f seeded: exactly q blocks, spread evenly
over a randomly ordered run, none more than twice. Blocks are `block_tokens` words; a source of less than 64 such has smaller ones, by
powers of two down to a word, so that it too meets its target, and the seats of each size of block go to the sources that have it.

No table of blocks is made: what a document gives follows from where it begins in its stream. That place is a sum over hash cells
(one row for each source and cell) plus a running sum within a cell, so a source with a third of all rows is dealt to many tasks.
Only one row for each source reaches the driver, `max_sources` at most, which is checked.

Defined results: null texts have size 0; a null source is a source, the last one; documents of size 0 are taken with 0 words; repeated
rows are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CELLS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def targets_of(sizes: dict, weights: tuple[int, ...] = (5, 2, 1), share: Fraction = Fraction(3, 2), most: int = 2) -> dict:
    """Target of each source: `share` of all sizes by weight; what exceeds `most` times a source goes to the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    rest, open_, out = share * sum(sizes.values()), sum(weight.values()), {}
    # those that are full first are those with the least size for their weight
    for s in sorted(names, key=lambda s: Fraction(sizes[s], weight[s])):
        out[s] = min(weight[s] * Fraction(rest) / open_, Fraction(most * sizes[s]))
        if out[s] == most * sizes[s]:
            rest, open_ = rest - out[s], open_ - weight[s]
    return {s: out[s] if out[s] == most * sizes[s] else weight[s] * Fraction(rest) / open_ for s in names}


def block_of(size: int, block_tokens: int) -> int:
    """Words of a block of a source: block_tokens, or the power of two below it of which the source has 64 at least (or one word)."""
    return min(block_tokens, 1 << max(0, (size // 64).bit_length() - 1))


def seats(targets: dict, total: int) -> dict:
    """Sainte-Laguë: `total` seats by the highest quotients target / (2 k + 1); ties go to the earlier source."""
    names = sorted((s for s in targets if targets[s] > 0), key=lambda s: (s is None, s or ""))
    out = dict.fromkeys(targets, 0)
    if not names or not total:
        return out
    want = [float(targets[s]) for s in names]
    whole = sum(want)
    # rounding to nearest is within half a seat for each source; the few that lack or exceed are settled one by one
    got = [int(t * total / whole + 0.5) for t in want]
    gap = total - sum(got)
    sign = 1 if gap > 0 else -1
    heap = [(-want[i] / (2 * got[i] + 1), i) if gap > 0 else (want[i] / (2 * got[i] - 1), -i) for i in range(len(want)) if gap > 0 or got[i]]
    heapq.heapify(heap)
    for _ in range(abs(gap)):
        i = abs(heap[0][1])
        got[i] += sign
        if gap > 0:
            heapq.heapreplace(heap, (-want[i] / (2 * got[i] + 1), i))
        elif got[i]:
            heapq.heapreplace(heap, (want[i] / (2 * got[i] - 1), -i))
        else:
            heapq.heappop(heap)
    return out | dict(zip(names, got, strict=True))


def shard_quotas(targets: dict, total: int, shards: int) -> list[dict]:
    """Seats of each shard; together they are seats(targets, total)."""
    steps = [seats(targets, total * j // shards) for j in range(shards + 1)]
    return [{s: b[s] - a[s] for s in targets} for a, b in zip(steps, steps[1:], strict=False)]


def fitted(quotas: list[int], blocks: int) -> list[int]:
    """Quotas of the shards of a source with so many blocks, none above twice the shard's blocks: the rest goes to the next shards with room."""
    shards, out, over = len(quotas), [], 0
    room = [2 * (-(-(j + 1) * blocks // shards) - -(-j * blocks // shards)) for j in range(shards)]
    for q, r in zip(quotas, room, strict=True):
        out.append(min(q + over, r))
        over += q - out[-1]
    for j in range(shards):  # round the end
        more = min(over, room[j] - out[j])
        out[j], over = out[j] + more, over - more
    return out


def mix_sources(docs: DataFrame, block_tokens: int = 128, seed: int = 17, max_sources: int = 100_000, keep: tuple[str, ...] = ("doc_id",), shards: int = 8) -> DataFrame:
    """For each row: columns `keep`, size, source_size, target, taken, shard (of its first block), and first (its place in the stream),
    block, blocks, quotas, before and starts (arrays with an entry for each shard, and one for the end).

    More than max_sources sources are a ValueError: their sizes, one row each, are apportioned on the driver."""
    common.reserved(keep, ("size", "source_size", "target", "first", "block", "blocks", "quotas", "before", "starts", "taken", "shard"))
    spark = docs.sparkSession
    narrow = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("of"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))
    hashed = narrow.withColumn("h", F.xxhash64(F.lit(seed), "id", "text_hash")).withColumn("cell", F.pmod("h", F.lit(CELLS)).cast("int"))
    sized = common.written(hashed, "mix")
    cells = sized.groupBy("of", "cell").agg(F.sum("size").alias("n"))
    ahead = cells.select("of", "cell", (F.sum("n").over(Window.partitionBy("of").orderBy("cell")) - F.col("n")).alias("ahead"))
    found = cells.groupBy("of").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["of"]: r["n"] for r in found}
    targets = targets_of(sizes)
    alike: dict[int, dict] = defaultdict(dict)
    for s, n in sizes.items():
        alike[block_of(n, block_tokens)][s] = targets[s]
    won = {block: shard_quotas(own, int(sum(own.values()) / block), shards) for block, own in alike.items()}
    rows = []
    for s, n in sizes.items():
        block = block_of(n, block_tokens)
        blocks = max(1, -(-n // block))
        quotas = fitted([q[s] for q in won[block]], blocks)
        before = [sum(quotas[:j]) for j in range(shards + 1)]
        starts = [hash_fraction(seed + j, s, max(1, -(-(j + 1) * blocks // shards) - -(-j * blocks // shards))) for j in range(shards)]
        rows.append((s, n, float(targets[s]), block, blocks, [*quotas, 0], before, [*starts, 0]))
    plan = spark.createDataFrame(rows, "of string, source_size long, target double, block long, blocks long, quotas array<long>, before array<long>, starts array<long>")
    here = Window.partitionBy("of", "cell").orderBy("h", "id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)
    running = sized.withColumn("inside", F.sum("size").over(here) - F.col("size"))
    both = running.alias("d").join(ahead.alias("b"), F.col("d.of").eqNullSafe(F.col("b.of")) & (F.col("d.cell") == F.col("b.cell"))).join(F.broadcast(plan).alias("p"), F.col("d.of").eqNullSafe(F.col("p.of")))
    out = both.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "d.size", (F.col("ahead") + F.col("inside")).alias("first"), "source_size", "target", "block", "blocks", "quotas", "p.before", "starts")
    shard = F.expr(f"cast(least((first div block) * {shards} div blocks, {shards - 1}) as int)")
    return out.withColumns({"taken": (taken_before("first + size", shards) - taken_before("first", shards)).cast("long"), "shard": shard})


def copies_before(block: str, shards: int) -> str:
    """SQL: how many blocks are taken, repeats counted, before the given block of the stream."""
    shard = f"cast({block} * {shards} div blocks as int)"
    begin = lambda j: f"(({j} * blocks + {shards - 1}) div {shards})"
    at = lambda name: f"element_at({name}, {shard} + 1)"
    width = f"greatest({begin(f'({shard} + 1)')} - {begin(shard)}, 1)"
    return f"({at('before')} + (cast({block} - {begin(shard)} as decimal(19,0)) * cast({at('quotas')} as decimal(18,0)) + {at('starts')}) div {width})"


def taken_before(place: str, shards: int):
    """How many words are taken, repeats counted, before a place of the stream."""
    block = f"(({place}) div block)"
    after = f"least({block} + 1, blocks)"
    return F.expr(f"block * {copies_before(block, shards)} + (({place}) % block) * ({copies_before(after, shards)} - {copies_before(block, shards)})")


def block_copies(block: int, blocks: int, quotas: list[int], before: list[int], starts: list[int]) -> int:
    """copies_before for one block."""
    shards = len(quotas) - 1
    j = block * shards // blocks
    begin, end = -(-j * blocks // shards), -(-(j + 1) * blocks // shards)
    return before[j] + ((block - begin) * quotas[j] + starts[j]) // max(end - begin, 1)


def mixed_texts(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: for each row of mix_sources (which kept `columns`, text among them) one row for each time any of its words are
    taken, with the words of the blocks taken that often or more. A text taken whole stays as it is."""
    schema = T.StructType([mixed.schema[c] for c in columns])
    text_at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.in_chunks(batches):
            rows, texts = [], []
            at = {name: k for k, name in enumerate(batch.schema.names)}
            numbers = zip(*(batch.column(at[c]).to_pylist() for c in ("size", "first", "block", "blocks", "quotas", "before", "starts")), strict=True)
            for row, (text, (size, first, block_tokens, *plan)) in enumerate(zip(batch.column(at["text"]).to_pylist(), numbers, strict=True)):
                if not size:
                    continue
                span = range(first // block_tokens, (first + size - 1) // block_tokens + 1)
                passed = [block_copies(j, *plan) for j in range(span.start, span.stop + 1)]
                times = [b - a for a, b in zip(passed, passed[1:], strict=False)]
                words = None
                for nth in range(1, max(times) + 1):
                    if min(times) >= nth:
                        rows.append(row)
                        texts.append(text)
                        continue
                    words = words or [m.span() for m in re.finditer(WORD, text)]
                    parts, k = [], 0
                    while k < len(times):
                        if times[k] < nth:
                            k += 1
                            continue
                        begin = k
                        while k < len(times) and times[k] >= nth:
                            k += 1
                        a, b = max(span[begin] * block_tokens - first, 0), min((span[k - 1] + 1) * block_tokens - first, size)
                        parts.append(text[words[a][0] : words[b - 1][1]])
                    rows.append(row)
                    texts.append(" ".join(parts))
            out = [batch.column(at[c]).take(pa.array(rows, pa.int64())) for c in columns]
            out[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return common.map_arrow(mixed.select(*columns, "size", "first", "block", "blocks", "quotas", "before", "starts"), run, schema)


def hash_fraction(seed: int, source, blocks: int) -> int:
    return zlib.crc32(f"{seed}:{source!r}".encode()) * blocks >> 32


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard")
