"""Toxicity: a linear-chain conditional random field tags toxic tokens; marginals make document scores and offending offsets.

Labels are per document, so tokens are labelled from them: a token that stands in toxic documents of the training sample far more often
than in clean ones is labelled toxic there, every other token clean. Where no token does, all tokens of toxic documents are labelled
toxic, and the field finds what tells them apart. The field has two states, transition weights, and token features
in sorted hash arrays (the word, its first and its last four bytes). It is fitted on windows of `per_class` documents of each class
at most, chosen by the hash of their ids (a documented bound, which bounds the model too).

A document's score joins the marginals of all its tokens (one minus the product of their complements, small ones left out), calibrated
on a fifth of the sample that the fit has not seen (on all of it, where a class is missing there). Texts are scored whole: the forward and backward passes run over all documents of a chunk at once, longest first.

Defined results: null and empty texts have no tokens and get the score of no evidence; without rows of both classes every score is 0;
labels outside 0 and 1 are not learned from; repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import calibrate, labelled_sample
from .words import Words, lowered, mixed, span_hashes, split_words, text_bytes

HALF = 6  # tokens on each side of a labelled one that a training window holds
FLOOR = 0.05


def token_features(words: Words, h: np.ndarray) -> list[np.ndarray]:
    """Three hashes for each token: the word, its first and its last four bytes."""
    head = span_hashes(words.data, words.starts, np.minimum(words.starts + 4, words.ends))
    tail = span_hashes(words.data, np.maximum(words.ends - 4, words.starts), words.ends)
    return [h, head, tail]


def places_of(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where each hash stands in the sorted array; its length for hashes that don't."""
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, len(known))


@dataclass
class Field:
    known: list[np.ndarray]  # for each kind of feature the sorted hashes that training saw
    weights: list[np.ndarray]  # theirs, for the toxic state against the clean one; a last 0 for unknown ones
    bias: float
    moves: np.ndarray  # 2 x 2, from state to state, as factors
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, words: Words, h: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for each token."""
        score = np.full(len(h), self.bias)
        for known, weights, own in zip(self.known, self.weights, token_features(words, h), strict=True):
            score += weights[places_of(known, own)]
        odds = np.exp(np.clip(score, -12, 12))
        counts = words.counts
        order = np.argsort(-counts, kind="stable")
        size = counts[order]
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
        (a00, a01), (a10, a11) = self.moves
        forward, backward = np.empty(len(h)), np.empty(len(h))
        first, last = words.bounds[:-1][order], words.bounds[1:][order] - 1
        r = q = None
        for t, m in enumerate(active.tolist()):
            at = first[:m] + t
            r = odds[at] * ((a01 + a11 * r[:m]) / (a00 + a10 * r[:m])) if t else odds[at]
            forward[at] = r
            at = last[:m] - t
            if t:
                seen = odds[at + 1] * q[:m]
                q = (a10 + a11 * seen) / (a00 + a01 * seen)
            else:
                q = np.ones(m)
            backward[at] = q
        both = forward * backward
        return both / (1 + both)

    def raw(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-odds that any token is toxic."""
        kept = np.where(p >= FLOOR, np.log1p(-np.minimum(p, 1 - 1e-9)), 0.0)
        total = np.concatenate([[0.0], np.cumsum(kept)])
        none = total[bounds[1:]] - total[bounds[:-1]]
        top = np.zeros(len(bounds) - 1)
        full = np.flatnonzero(np.diff(bounds))
        if len(full):
            top[full] = np.maximum.reduceat(p, bounds[:-1][full])
        any_ = np.clip(np.maximum(-np.expm1(none), top), 1e-5, 1 - 1e-9)
        return np.log(any_) - np.log1p(-any_)

    def score(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(p, bounds) + self.shift, -30, 30)))


def token_labels(h: np.ndarray, doc: np.ndarray, label: np.ndarray, least: int = 5, ratio: float = 20.0) -> np.ndarray:
    """1 for tokens of toxic documents that stand in `least` different places (by the tokens beside them, so copies of one document
    count once) and whose share of toxic documents is `ratio` times that of clean ones at least."""
    kinds, inverse = np.unique(h, return_inverse=True)
    pairs = np.unique(inverse * len(label) + doc)
    kind, of = pairs // len(label), label[pairs % len(label)]
    toxic, clean = np.bincount(kind[of == 1], minlength=len(kinds)), np.bincount(kind[of == 0], minlength=len(kinds))
    bad = label[doc] == 1
    beside = mixed(np.roll(h, 1) ^ mixed(np.roll(h, -1) + h))
    places = pd.Series(inverse[bad]).groupby(beside[bad]).first()
    n_places = np.bincount(places.to_numpy(), minlength=len(kinds))
    n_toxic, n_clean = max(int(label.sum()), 1), max(int((1 - label).sum()), 1)
    marked = (n_places >= least) & (toxic >= least) & (toxic / n_toxic >= ratio * (clean + 0.5) / n_clean)
    return (marked[inverse] & bad).astype(np.int64)


def fit(texts: pa.Array, label: np.ndarray, shares: tuple[float, float] = (0.5, 0.5), rounds: int = 80, rate: float = 0.2, decay: float = 1e-4) -> Field | None:
    """Adam on the conditional likelihood of token labels in windows, then calibration of document scores. shares: of both classes in all
    labelled rows; the sample's rows are weighted to them."""
    if len(set(label.tolist())) < 2:
        return None
    data, offsets = text_bytes(texts)
    words = split_words(lowered(data), offsets, "alnum")
    h, doc = words.hashes(), words.docs
    rest = np.arange(len(label)) % 5 == 0
    if len(set(label[rest].tolist())) < 2 or len(set(label[~rest].tolist())) < 2:
        rest = np.ones(len(label), dtype=bool)
    learn = ~rest if not rest.all() else rest
    fresh = learn[doc]
    tags = np.zeros(len(h), dtype=np.int64)
    number = np.cumsum(learn) - 1  # of the documents that are learned from
    tags[fresh] = token_labels(h[fresh], number[doc[fresh]], label[learn])
    if not tags.any():
        tags = (label[doc] * fresh).astype(np.int64)
    # windows: around labelled tokens, and as many hashed places again in each clean document, up to four
    place = np.flatnonzero(tags)
    spread = np.flatnonzero(fresh & (label[doc] == 0) & ((h >> np.uint64(20)) % np.maximum(words.counts[doc] // 4, 1).astype(np.uint64) == 0))
    centre = np.concatenate([place, spread])
    if not len(place):
        return None
    grid = centre[:, None] + np.arange(-HALF, HALF + 1)
    inside = (grid >= words.bounds[doc[centre]][:, None]) & (grid < words.bounds[doc[centre] + 1][:, None])
    grid = np.where(inside, grid, centre[:, None])
    y = np.where(inside, tags[grid], 0).astype(float)
    features = [x[grid] for x in token_features(words, h)]
    known = [np.unique(x) for x in features]
    sizes = [len(x) for x in known]
    slots = np.stack([np.searchsorted(k, x) + sum(sizes[:i]) for i, (k, x) in enumerate(zip(known, features, strict=True))])
    total = sum(sizes)
    w, bias, moves = np.zeros(total), -3.0, np.zeros((2, 2))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w", w), ("bias", np.zeros(())), ("moves", moves))}
    decays = np.repeat([decay, 50 * decay, 50 * decay], sizes)  # parts of words weigh little beside the words themselves
    pairs = inside[:, 1:] & inside[:, :-1]
    n, width = len(centre), grid.shape[1]

    def adam(key: str, value, gradient, t: int):
        m, s = state[key]
        state[key] = [m, s] = [0.9 * m + 0.1 * gradient, 0.99 * s + 0.01 * gradient**2]
        return value - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

    for t in range(1, rounds + 1):
        e = np.exp(np.clip(bias + w[slots].sum(axis=0), -12, 12))
        e = np.where(inside, e, 1.0)
        (a00, a01), (a10, a11) = np.exp(moves)
        r, q = np.empty((n, width)), np.ones((n, width))
        for k in range(width):
            step = e[:, k] * (a01 + a11 * r[:, k - 1]) / (a00 + a10 * r[:, k - 1]) if k else e[:, k]
            r[:, k] = np.where(inside[:, k], step if not k else np.where(inside[:, k - 1], step, e[:, k]), 1.0)
        for k in range(width - 2, -1, -1):
            seen = e[:, k + 1] * q[:, k + 1]
            q[:, k] = np.where(inside[:, k + 1], (a10 + a11 * seen) / (a00 + a01 * seen), 1.0)
        p = r * q / (1 + r * q)
        error = np.where(inside, p - y, 0.0) / n
        r0, e1, q1 = r[:, :-1], e[:, 1:], q[:, 1:]
        joint = np.stack([np.full_like(r0, a00), a01 * e1 * q1, a10 * r0, a11 * r0 * e1 * q1])
        joint /= joint.sum(axis=0)
        y0, y1 = y[:, :-1], y[:, 1:]
        seen = np.stack([(1 - y0) * (1 - y1), (1 - y0) * y1, y0 * (1 - y1), y0 * y1])
        by_slot = np.bincount(slots.ravel(), np.broadcast_to(error, slots.shape).ravel(), minlength=total) + decays * w
        w = adam("w", w, by_slot, t)
        bias = float(adam("bias", np.array(bias), np.array(error.sum()), t))
        moves = adam("moves", moves, ((joint - seen) * pairs).sum(axis=(1, 2)).reshape(2, 2) / n + decay * moves, t)
    split = np.split(w.astype(np.float32), np.cumsum(sizes)[:-1])
    field = Field(known, [np.append(x, np.float32(0)) for x in split], bias, np.exp(moves))
    field.slope, field.shift = calibrate(field.raw(field.marginals(words, h), words.bounds)[rest], label[rest], np.array(shares)[label[rest]] * rest.sum() / np.maximum(np.bincount(label[rest], minlength=2), 1)[label[rest]])
    return field


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1000) -> Field | None:
    rows = labelled_sample(docs, labels, "toxic", per_class, common.may_learn())
    if not rows.num_rows:
        return None
    n = {r["toxic"]: r["count"] for r in labels.where(common.may_learn() & F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    total = max(sum(n.values()), 1)
    return fit(rows.column("text").combine_chunks(), rows.column("label").to_numpy().astype(np.int64), (n.get(0, 0) / total, n.get(1, 0) / total))


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1000, keep: tuple[str, ...] = ("doc_id",), span_threshold: float = 0.5) -> DataFrame:
    """For each row: columns `keep`, score and spans (code point offsets of tokens whose marginal reaches span_threshold, neighbours merged)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    schema = common.schema_of(docs, keep, "score double, spans array<struct<start: long, end: long>>")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in common.in_chunks(batches):
            at = {name: k for k, name in enumerate(batch.schema.names)}
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            score = np.zeros(batch.num_rows)
            if field:
                data, offsets = text_bytes(batch.column(at["text"]))
                words = split_words(lowered(data), offsets, "alnum")
                p = field.marginals(words, words.hashes())
                score = field.score(p, words.bounds)
                marked = np.flatnonzero(p >= span_threshold)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for token, d in zip(marked.tolist(), (np.searchsorted(words.bounds, marked, side="right") - 1).tolist(), strict=True):
                    start, end = (int(points[x] - points[offsets[d]]) for x in (words.starts[token], words.ends[token]))
                    if spans[d] and before == token - 1:
                        spans[d][-1]["end"] = end
                    else:
                        spans[d].append({"start": start, "end": end})
                    before = token
            yield pa.RecordBatch.from_arrays([*(batch.column(at[c]) for c in keep), pa.array(score), pa.array(spans, span_type)], names=[*keep, "score", "spans"])

    return common.map_arrow(docs.select(*dict.fromkeys([*keep, "text"])), run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    out = score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
