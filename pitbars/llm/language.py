"""Language ID: an interpolated Kneser-Ney model of characters for each language, in sorted hash arrays.

Counts of 4-character grams come from every text a language may be learned from: chunks count in numpy, Spark sums over chunks. A
language's model holds all of them, its discounts come from the full counts, and the lower orders are continuation counts. A text is
scored by every language's length-normalised cross-entropy; the lowest wins. Models go to the tasks in groups of `group_grams` grams at
most (a language with more is a group by itself: its size follows its alphabet, not its texts); the groups score one after another in the
same pass over the texts, each handing on the best language so far, so any number of languages and grams is used whole.
Scores are a softmax of the entropies; its sharpness and the entropy beyond which a text counts as rejected are calibrated on
every text that is learned from.

Characters: letters in lower case, anything else is one blank. Defined results: null texts and texts without a letter are `und` with
score 0; if no language can be learned, every text is; a null lang is not learned from; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import mixed

N = 4
BLANK = 32
UNDETERMINED = "und"
#: Sharpnesses that calibration chooses from, and the parts of one that its sums are counted in.
SHARPNESS, UNIT = [0.5, 1, 2, 4, 8, 16, 32], 1 << 24


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: the lower-case letter, a blank for what is no letter, 0xFFFF for letters beyond 16 bits."""
    out = np.full(0x110000, BLANK, dtype=np.uint64)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            code = ord(low) if len(low) == 1 else c
            out[c] = code if code < 0xFFFF else 0xFFFF
    return out


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams (4 x 16 bits) of all texts, one for each symbol and one for the end; and where each text's begin. None for texts
    without a letter."""
    texts = [t or "" for t in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = _symbols()[points]
    before = np.empty_like(symbols)
    if len(symbols):
        before[1:] = symbols[:-1]
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = BLANK
    keep = ~((symbols == BLANK) & (before == BLANK))
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(lengths)
    counts = kept[ends] - kept[ends - lengths]
    lead = N - 1
    out = np.full(int(counts.sum()) + (lead + 1) * len(texts), BLANK, dtype=np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts)
    out[np.arange(len(doc)) + (lead + 1) * doc + lead] = symbols[keep]
    starts = np.cumsum(counts) - counts + (lead + 1) * np.arange(len(texts))
    n = np.where(counts > 0, counts + 1, 0)
    at = np.repeat(starts + lead - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    packed = out[at]
    for k in range(1, N):
        packed = packed | out[at - k] << np.uint64(16 * k)
    return packed, np.concatenate([[0], np.cumsum(n)])


class Table:
    """Counts by key in a sorted array of hashes."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        h = mixed(keys)
        order = np.argsort(h)
        self.hashes, self.values = h[order], [v[order].astype(np.float64) for v in values]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        if not len(self.hashes):
            return [np.zeros(len(keys)) for _ in self.values]
        h = mixed(keys)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return [np.where(hit, v[at], 0.0) for v in self.values]


class KneserNey:
    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.orders: list[tuple[Table, Table, float]] = []
        keys, values = grams, counts.astype(np.float64)
        for k in range(N, 0, -1):
            ones, twos = (values == 1).sum(), (values == 2).sum()
            discount = float(ones / (ones + 2 * twos)) if ones and twos else 0.75
            contexts, inverse = np.unique(keys >> np.uint64(16), return_inverse=True)
            self.orders.append((Table(keys, values), Table(contexts, np.bincount(inverse, values), np.bincount(inverse)), discount))
            # what the next lower order counts: how many different symbols stand before
            keys, number = np.unique(keys & np.uint64((1 << (16 * (k - 1))) - 1), return_counts=True)
            values = number.astype(np.float64)
        self.uniform = 1.0 / (len(self.orders[-1][0].hashes) + 1)

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.uniform)
        for k, (table, contexts, discount) in zip(range(1, N + 1), reversed(self.orders), strict=True):
            key = grams & np.uint64((1 << (16 * k)) - 1) if k < N else grams
            (count,), (total, kinds) = table.find(key), contexts.find(key >> np.uint64(16))
            seen = np.maximum(total, 1)
            p = np.where(total > 0, (np.maximum(count - discount, 0) + discount * kinds * p) / seen, p)
        return np.log(p)


def entropies_of(models: dict[str, KneserNey], texts: list[str | None]) -> np.ndarray:
    """Mean negative log-probability of a symbol: texts x languages, by name; nan for texts without a letter."""
    packed, bounds = grams_of(texts)
    n = np.diff(bounds)
    out = np.full((len(texts), len(models)), np.nan)
    full = np.flatnonzero(n)
    if len(full):
        inverse, distinct = pd.factorize(packed)
        for k, x in enumerate(sorted(models)):
            out[full, k] = -np.add.reduceat(models[x].log_probability(distinct)[inverse], bounds[:-1][full]) / n[full]
    return out


class Identifier:
    """All languages, in groups (dictionaries) of models."""

    def __init__(self, groups: list[dict[str, KneserNey]]):
        self.groups = groups
        self.languages = sorted(x for g in groups for x in g)
        self.sharpness, self.limits = 4.0, {x: np.inf for x in self.languages}

    def probabilities(self, entropies: np.ndarray) -> np.ndarray:
        e = -self.sharpness * (entropies - np.nanmin(entropies, axis=1, keepdims=True))
        p = np.exp(e)
        return p / p.sum(axis=1, keepdims=True)

    def calibrate(self, losses: list[float], moments: dict[str, tuple[int, float, float]]) -> None:
        """Sharpness by likelihood (losses: the sum of each of SHARPNESS), and for each language the entropy that hardly any of its texts exceed
        (moments: number, sum and sum of squares of its own texts' entropies)."""
        if not moments:
            return
        self.sharpness = float(SHARPNESS[int(np.argmin(losses))])
        for x, (n, total, squares) in moments.items():
            if n > 1:
                mean = total / n
                self.limits[x] = float(mean + 4 * np.sqrt(max(squares / n - mean * mean, 0.0)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in common.in_chunks(batches):
            packed, bounds = grams_of(batch.column(0).to_pylist())
            inverse, distinct = pd.factorize(packed)
            codes, names = pd.factorize(np.array(batch.column(1).to_pylist(), dtype=object))
            of = np.repeat(codes, np.diff(bounds))
            for k, name in enumerate(names):
                n = np.bincount(inverse[of == k], minlength=len(distinct))
                parts = held.setdefault(name, [])
                parts.append((distinct[n > 0], n[n > 0]))
                if len(parts) > 8:
                    held[name] = [_merged(parts)]
        for name, parts in held.items():
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return common.map_arrow(docs.select("text", "lang"), run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, group_grams: int = 4_000_000) -> Identifier | None:
    """docs: the rows to learn from (doc_id, text, lang)."""
    known = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = common.written(count_grams(known), "grams")
    sizes = sorted((r["lang"], r["count"]) for r in counts.groupBy("lang").count().collect())
    if not sizes:
        return None
    groups: list[list[str]] = []
    held = group_grams
    for x, n in sizes:
        if held + n > group_grams:
            groups.append([])
            held = 0
        groups[-1].append(x)
        held += n
    model = Identifier([])
    for names in groups:
        rows = counts.where(F.col("lang").isin(names)).select("lang", "gram", "n").toArrow()
        lang = rows.column("lang").combine_chunks().dictionary_encode()
        code, gram, n = lang.indices.to_numpy(), rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        model.groups.append({x: KneserNey(gram[code == k], n[code == k]) for k, x in enumerate(lang.dictionary.to_pylist())})
    model = Identifier(model.groups)
    _calibrate(known, model)
    return model


def _calibrate(known: DataFrame, model: Identifier) -> None:
    """Every text of known (text, lang) is scored; only sums by sharpness and by language come back. Sums of a batch are whole numbers of
    1 / UNIT, so their order makes no difference."""
    scored = known.select("text", "lang", F.array().cast("array<double>").alias("e"))
    for group in model.groups:
        shared = known.sparkSession.sparkContext.broadcast(group)

        def measure(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in common.in_chunks(batches):
                e = np.hstack([batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1), entropies_of(shared.value, batch.column(0).to_pylist())])
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1, dtype=np.int32) * e.shape[1], pa.int32()), pa.array(e.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["text", "lang", "e"])

        scored = common.map_arrow(scored, measure, "text string, lang string, e array<double>")
    names = [x for g in model.groups for x in sorted(g)]
    order = np.argsort(names, kind="stable")
    plain = Identifier([])
    plain.languages = model.languages
    place = {x: k for k, x in enumerate(plain.languages)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(names))[:, order]
            own = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            full = ~np.isnan(e[:, 0])
            e, own = e[full], own[full]
            if not len(own):
                continue
            at, mine = np.arange(len(own)), e[np.arange(len(own)), own]
            rows = []
            for k, plain.sharpness in enumerate(SHARPNESS):
                rows.append((k, None, len(own), -np.log(np.maximum(plain.probabilities(e)[at, own], 1e-9)).sum(), 0.0))
            n, total, squares = np.bincount(own), np.bincount(own, mine), np.bincount(own, mine * mine)
            rows += [(None, plain.languages[k], int(n[k]), total[k], squares[k]) for k in np.flatnonzero(n)]
            k, lang, n, total, squares = zip(*rows, strict=True)
            whole = [pa.array([round(x * UNIT) for x in column], pa.int64()) for column in (total, squares)]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(lang, pa.string()), pa.array(n, pa.int64()), *whole], names=["k", "lang", "n", "total", "squares"])

    parts = common.map_arrow(scored.select("lang", "e"), add, "k int, lang string, n long, total long, squares long")
    sums = parts.groupBy("k", "lang").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("n", "total", "squares"))).collect()
    losses = [float(r["total"]) / UNIT for r in sorted((r for r in sums if r["k"] is not None), key=lambda r: r["k"])]
    model.calibrate(losses, {r["lang"]: (int(r["n"]), float(r["total"]) / UNIT, float(r["squares"]) / UNIT) for r in sums if r["k"] is None})


def identify(docs: DataFrame, model: Identifier | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: columns `keep`, lang_pred, score, entropy (of the language chosen) and rejected."""
    state = "_lang string, _entropy double, _mass double"  # the best so far, and the sum of exp(sharpness * (its entropy - entropy)) over languages
    common.reserved(keep, ("lang_pred", "score", "entropy", "rejected"))
    source = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), "text", F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("double").alias("_entropy"), F.lit(0.0).alias("_mass"))
    schema = common.schema_of(source, [f"k{i}" for i in range(len(keep))] + ["text"], state)
    sharpness = model.sharpness if model else 1.0
    for group in model.groups if model else []:
        shared = docs.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = np.array(sorted(shared.value), dtype=object)
            for batch in common.in_chunks(batches):
                at = {name: k for k, name in enumerate(batch.schema.names)}
                e = entropies_of(shared.value, batch.column(at["text"]).to_pylist())
                lang = np.array(batch.column(at["_lang"]).to_pylist(), dtype=object)
                entropy, mass = (batch.column(at[c]).to_numpy(zero_copy_only=False).astype(float) for c in ("_entropy", "_mass"))
                full = np.flatnonzero(~np.isnan(e[:, 0]))
                if len(full):
                    best = np.argmin(e[full], axis=1)
                    low = e[full, best]
                    old = np.where(np.isnan(entropy[full]), np.inf, entropy[full])
                    least = np.minimum(low, old)
                    mass[full] = mass[full] * np.exp(-sharpness * np.minimum(old - least, 1e9)) + np.exp(-sharpness * (e[full] - least[:, None])).sum(axis=1)
                    better = low < old
                    lang[full[better]] = names[best[better]]
                    entropy[full] = least
                yield pa.RecordBatch.from_arrays([*(batch.column(at[f"k{i}"]) for i in range(len(keep))), batch.column(at["text"]), pa.array(lang, pa.string()), pa.array(entropy, from_pandas=True), pa.array(mass)], names=schema.names)

        source = common.map_arrow(source, run, schema)
    limits = {x: v for x, v in model.limits.items() if np.isfinite(v)} if model else {}
    limit = F.create_map(*(F.lit(y) for x, v in limits.items() for y in (x, v)))[F.col("_lang")] if limits else F.lit(None).cast("double")
    rejected = F.col("_lang").isNull() | F.coalesce(F.col("_entropy") > limit, F.lit(False))
    score = F.when(F.col("_lang").isNull(), 0.0).otherwise(1.0 / F.col("_mass"))
    return source.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.coalesce("_lang", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"), F.col("_entropy").alias("entropy"), rejected.alias("rejected"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs, train(docs.where(common.may_learn())))
    return out.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score", "rejected")
