"""Quality rules: base counts of a text, and a logistic regression on hashed word and character n-grams with calibrated probability.

The model is fitted on `per_class` labelled rows of each class at most, chosen by the hash of their ids, and as many of these as have
`sample_bytes` together (documented bounds); it is a vector of 3 * 2^16 weights, so what goes to the tasks has a fixed size. Scoring runs
over Arrow batches: a document's score is the mean weight of its words, plus that of its pairs of words, plus that of its grams of four
characters, calibrated on a fifth of the sample that the fit has not seen.

Defined results: null texts have no words and fail the base rule; without rows of both classes the model keeps whatever the base rule
keeps; other columns are ignored; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import Words, gram_hashes, mixed, split_words, text_bytes

BUCKETS = 1 << 16
KINDS = 3
GRAM = 4
#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_BLANKS = b" \t\n\x0b\x0c\r"


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray, words: Words, h: np.ndarray) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    body = data[: offsets[-1]]
    blank = (body == 32) | ((body >= 9) & (body <= 13))
    out = {"word_chars": _per_doc(((body & 0xC0) != 0x80) & ~blank, offsets), "n_symbols": _per_doc(_SYMBOL[body], offsets)}
    text = body.tobytes()
    lines = np.zeros(len(offsets) - 1, dtype=np.int64)
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        seen = [x for x in text[a:b].split(b"\n") if x.strip(_BLANKS)]
        lines[d] = len(seen) - len(set(seen))
    out["n_dup_lines"] = lines
    covered = np.zeros(len(h) + 1, dtype=np.int64)
    grams = gram_hashes(h, WINDOW)
    if len(grams):
        doc = words.docs
        inside = np.flatnonzero(doc[: len(grams)] == doc[WINDOW - 1 :])
        own = mixed(grams[inside] ^ mixed(doc[inside].astype(np.uint64) + np.uint64(1)))
        twice = inside[pd.Series(own).duplicated(keep=False).to_numpy()]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(covered[:-1]) > 0, words.bounds)
    return out


def feature_slots(data: np.ndarray, offsets: np.ndarray, words: Words, h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words, pairs of words and character grams: the bucket of each, and where those of each document begin and end. What spans two
    documents lies between the end of one and the beginning of the next."""
    mask = np.uint64(BUCKETS - 1)
    pairs = (gram_hashes(h, 2) & mask).astype(np.int64)
    body = data[: offsets[-1]]
    points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    at = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[offsets]
    grams = (gram_hashes(mixed(points), GRAM) & mask).astype(np.int64)
    inner = lambda bounds, n, size: (np.minimum(bounds[:-1], n), np.clip(bounds[1:] - size + 1, np.minimum(bounds[:-1], n), n))
    return [((h & mask).astype(np.int64), words.bounds[:-1], words.bounds[1:]), (pairs, *inner(words.bounds, len(pairs), 2)), (grams, *inner(at, len(grams), GRAM))]


def _means(weights: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(weights, dtype=np.float64)])
    return (total[end] - total[begin]) / np.maximum(end - begin, 1)


@dataclass
class Model:
    weights: list[np.ndarray]  # of words, pairs of words and character grams
    bias: float
    slope: float
    shift: float

    def probability(self, data, offsets, words, h) -> np.ndarray:
        raw = self.bias + sum(_means(w[slots], begin, end) for w, (slots, begin, end) in zip(self.weights, feature_slots(data, offsets, words, h), strict=True))
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def calibrate(raw: np.ndarray, label: np.ndarray, weight: np.ndarray | float = 1.0, steps: int = 50) -> tuple[float, float]:
    """Platt's slope and shift, with smoothed targets; Newton steps. weight: how many rows each stands for."""
    weight = np.broadcast_to(np.asarray(weight, dtype=float), raw.shape)
    pos, neg = max(label.sum(), 0), max((1 - label).sum(), 0)
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.column_stack([raw, np.ones_like(raw)]), np.zeros(2)
    w[0] = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (p - target)) + 1e-3 * (w - [1, 0]))
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(texts: pa.Array, label: np.ndarray, rounds: int = 120, rate: float = 0.3, scale: float = 30.0, decay: float = 1e-4) -> Model | None:
    """Adam on the log loss; four fifths of the rows train, the rest calibrate."""
    if len(set(label.tolist())) < 2:
        return None
    data, offsets = text_bytes(texts)
    words = split_words(data, offsets, "solid")
    keys, sizes = [], []
    for kind, (slots, begin, end) in enumerate(feature_slots(data, offsets, words, words.hashes())):
        n = end - begin
        doc = np.repeat(np.arange(len(label)), n)
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        keys.append(np.unique(doc * KINDS * BUCKETS + kind * BUCKETS + slots[at], return_counts=True))
        sizes.append(np.maximum(n, 1))
    keys, counts = (np.concatenate(x) for x in zip(*keys, strict=True))
    row, column = keys // (KINDS * BUCKETS), keys % (KINDS * BUCKETS)
    value = scale * counts / np.stack(sizes)[column // BUCKETS, row]
    train = np.arange(len(label)) % 5 != 0
    used = train[row]
    r, c, v = row[used], column[used], value[used]
    weight = np.where(label > 0, 0.5 / max(label[train].sum(), 1), 0.5 / max((1 - label)[train].sum(), 1)) * train
    w, m, s = (np.zeros(KINDS * BUCKETS + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        raw = np.bincount(r, w[c] * v, minlength=len(label)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * weight
        g = np.append(np.bincount(c, error[r] * v, minlength=KINDS * BUCKETS), error.sum()) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    raw = np.bincount(row, w[column] * value, minlength=len(label)) + w[-1]
    slope, shift = calibrate(raw[~train], label[~train])
    return Model([x.astype(np.float32) for x in np.split(w[:-1] * scale, KINDS)], float(w[-1]), slope, shift)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, only=None, sample_bytes: int = 64 << 20) -> pa.Table:
    """text and label of at most per_class rows of each class, those whose ids hash lowest, by that hash; of each class as many as have
    half of sample_bytes together, and one in any case."""
    known = labels.where(F.col(column).isin(0, 1)).where(only if only is not None else F.lit(True)).select(F.col("doc_id").alias("chosen"), F.col(column).cast("int").alias("label"), F.xxhash64("doc_id").alias("order"))
    parts = [known.where(F.col("label") == k).orderBy("order", "chosen").limit(per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * per_class rows at most
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("order", "doc_id", "label", "text")
    own = Window.partitionBy("label").orderBy("order", "doc_id", F.xxhash64("text"))
    sized = rows.withColumn("so_far", F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(own))
    return sized.where((F.col("so_far") <= sample_bytes // 2) | (F.col("nth") == 1)).drop("so_far", "nth").toArrow().sort_by([("order", "ascending"), ("label", "ascending")])


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> Model | None:
    rows = labelled_sample(docs, labels, "quality", per_class)
    return fit(rows.column("text").combine_chunks(), rows.column("label").to_numpy().astype(np.int64)) if rows.num_rows else None


def judge_quality(docs: DataFrame, labels: DataFrame, per_class: int = 1000, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: columns `keep`, the base counts, base_failed, probability (of good quality) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = common.schema_of(docs, keep, ", ".join([*(f"{n} long" for n in names), "base_failed boolean, probability double, kept boolean"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in common.in_chunks(batches):
            at = {name: k for k, name in enumerate(batch.schema.names)}
            data, offsets = text_bytes(batch.column(at["text"]))
            words = split_words(data, offsets, "solid")
            h = words.hashes()
            counts = {"n_words": words.counts} | base_counts(data, offsets, words, h)
            failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])
            p = model.probability(data, offsets, words, h) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in keep), *(pa.array(counts[n], pa.int64()) for n in names), pa.array(failed), pa.array(p, pa.float64()), pa.array(~failed & (p >= threshold))], names=[*keep, *names, "base_failed", "probability", "kept"])

    return common.map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return judge_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
