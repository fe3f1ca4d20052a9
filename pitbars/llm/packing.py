"""Packing of examples into training sequences: vector bin packing by the dot-product heuristic.

A sequence has room for `tokens` ids, `segments` pieces and `loss` loss-bearing ids, all at once. Each task streams its rows, encodes
them and holds up to `waiting` remainders; a sequence is filled by the remainder that fits and has the largest dot product of its sizes
with the room left, each as a share of its limit, again and again. What an example has beyond a whole sequence leaves as whole sequences
first. If nothing that waits fits, or the last segment is to be placed, and `cut` is on, the remainder with the largest product that is
longer than the room is cut to fill it exactly (pieces of fewer than `min_piece` ids are not cut off; that few ids are padded). With
`cut`, the last sequence of a task is cut at powers of two, which need no padding; without, examples are cut only where they exceed a limit.

At scale: nothing is shuffled and no table is made, so skew of any key is no matter; a task holds `waiting` remainders of one sequence at
most, besides the example in hand (four bytes for each id). Sequences don't span tasks: a task that is run again after an executor is lost
makes its own sequences again. sequence_id is the task's number times 2^32 plus a running number, so ids repeat in another run only where
the input is dealt to tasks alike.

Texts are encoded chunk by chunk through a cache: the tokenizer's pieces end before white space that ends a word and between a letter and
the punctuation after it, so the ids of a text are those of its chunks (checked against whole texts in the tests).

Defined results: null and empty texts give the end id alone; repeated rows and ids are examples of their own; null ids are kept; an
empty table gives no rows. Kept columns named like a result are refused; other extra columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import _BYTES, _tokenizer

CACHE_CHUNKS = 600_000  # chunks of CACHED_LENGTH characters at most in each of the two generations of a worker's cache
CACHED_LENGTH = 48
SLICE = 1 << 20  # characters of a text that are cut into chunks at a time
BATCH_IDS = 1 << 20
_RESULT = "start long, length long, loss_tokens long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, segment int, offset long"

_SPACE, _SOLID = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"  # white space as the tokenizers have it
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A line's end between words; white space and letters up to white space or punctuation other than an apostrophe; or white space and all up to the next.
_CHUNK = re.compile(rf"(?<={_SOLID})\n(?={_SOLID})|{_SPACE}*+[{_LETTERS}]++(?=[,.;:!?]|{_SPACE}|\Z)|{_SPACE}*+{_SOLID}++|{_SPACE}++")
_PLAIN = re.compile(f" ?[{_LETTERS}]+")
_BREAK = re.compile(rf"(?<={_SOLID}) (?={_SOLID})")


class ChunkEncoder(dict):
    """Texts to little-endian 32-bit ids by a byte-level tokenizer. As a dictionary it holds the ids of chunks met of late; a full one
    becomes the older of two generations. Chunks of a space and letters take the tokenizer's model alone, all others its full encode;
    of a tokenizer that is not built so (probed on a few chunks), whole texts are encoded."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.older: dict[str, bytes] = {}
        self.model = self.tokenizer.model.tokenize
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        probes = ("Thing", " ÉAUX", " größe", "it's", ",..", " \n x", "9th", " 12,")
        self.apart = self.tokenizer.normalizer is None and self._full("".join(probes)) == b"".join(map(self._full, _CHUNK.findall("".join(probes)))) and all(self._model(p) == self._full(p) for p in probes[:3])

    def _full(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _model(self, chunk: str) -> bytes:
        four = self.four
        return b"".join([four[t.id] for t in self.model(chunk.encode().decode("latin-1").translate(_BYTES))])

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > CACHED_LENGTH:
            return self._full(chunk)
        found = self.older.get(chunk)
        if found is None:
            found = self._model(chunk) if _PLAIN.fullmatch(chunk) else self._full(chunk)
        self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if not self.apart:
            return self._full(text)
        parts, at = [], 0
        while len(text) - at > SLICE and (gap := _BREAK.search(text, at + SLICE)):
            parts.append(b"".join(map(self.__getitem__, _CHUNK.findall(text[at : gap.start()]))))
            at = gap.start()
        parts.append(b"".join(map(self.__getitem__, _CHUNK.findall(text[at:] if at else text))))
        if len(self) > CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()
        return b"".join(parts)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker."""
    return ChunkEncoder(path)


common.CACHES.append(encoder_of.cache_clear)


@dataclass(frozen=True)
class Limits:
    """What a sequence has room for."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048


@dataclass
class Piece:
    """ids[start:] of an example, up to `length`: (first, end) spans in `bearing` are the ids that bear loss."""

    own: tuple
    ids: bytes
    start: int
    length: int
    bearing: list[tuple[int, int]]
    total: int

    def loss(self, n: int) -> int:
        """Loss-bearing ids among the first n."""
        end = self.start + n
        return sum(max(0, min(b, end) - max(a, self.start)) for a, b in self.bearing)

    def within(self, tokens: int, loss: int) -> int:
        """The most leading ids within both limits."""
        n = min(tokens, self.length)
        for a, b in self.bearing:
            have = max(0, min(b, self.start + n) - max(a, self.start))
            if have > loss:
                return max(a, self.start) + loss - self.start
            loss -= have
        return n

    def split(self, n: int) -> tuple[Piece, Piece]:
        keep = [(a, b) for a, b in self.bearing if b > self.start + n]
        return Piece(self.own, self.ids[: 4 * n], self.start, n, self.bearing, self.total), Piece(self.own, self.ids[4 * n :], self.start + n, self.length - n, keep, self.total)


class Packer:
    """Sequences (lists of pieces) out of a stream of examples."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True, waiting: int = 1024, min_piece: int = 16):
        self.limits, self.cut, self.waiting, self.min_piece = limits, cut, waiting, min_piece
        self.pool: list[Piece] = []
        self.sizes = np.zeros((2 * waiting, 2))  # tokens and loss of what waits, in the pool's order

    def _wait(self, piece: Piece, at: int | None = None) -> None:
        if at is None:
            at = len(self.pool)
            self.pool.append(piece)
        else:
            self.pool[at] = piece
        self.sizes[at] = piece.length, piece.loss(piece.length)

    def _take(self, at: int) -> Piece:
        piece, last = self.pool[at], self.pool.pop()
        if at < len(self.pool):
            self.pool[at], self.sizes[at] = last, self.sizes[len(self.pool)]
        return piece

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        lim = self.limits
        while (n := piece.within(lim.tokens, lim.loss)) < piece.length:
            if n <= 0:
                raise ValueError("a limit leaves no room for any id")
            head, piece = piece.split(n)
            yield [head]
        self._wait(piece)
        if len(self.pool) >= self.waiting:
            yield self._filled()

    def end(self) -> Iterator[list[Piece]]:
        while self.pool:
            found = self._filled()
            if self.pool or not self.cut:
                yield found
            else:
                yield from self._powers(found)

    def _filled(self) -> list[Piece]:
        lim, out = self.limits, []
        room, left, loss = lim.tokens, lim.segments, lim.loss
        while self.pool and left and room:
            sizes = self.sizes[: len(self.pool)]
            product = sizes[:, 0] * (room / lim.tokens**2) + sizes[:, 1] * (max(loss, 0) / max(lim.loss, 1) ** 2)
            fits = (sizes[:, 0] <= room) & (sizes[:, 1] <= loss)
            best = int(np.argmax(np.where(fits, product, -1.0)))
            if not fits[best] or (self.cut and left == 1 and sizes[best, 0] < room):
                piece = self._cut_for(room, loss, product) if self.cut else None
                if piece is None and not fits[best]:
                    break
                piece = piece or self._take(best)
            else:
                piece = self._take(best)
            out.append(piece)
            room, left, loss = room - piece.length, left - 1, loss - piece.loss(piece.length)
        return out

    def _cut_for(self, room: int, loss: int, product: np.ndarray) -> Piece | None:
        """The head of what has the largest product and is longer than the room by min_piece or more; none if no head is long enough."""
        sizes = self.sizes[: len(self.pool)]
        longer = sizes[:, 0] >= room + self.min_piece
        if room < self.min_piece or not longer.any():
            return None
        at = int(np.argmax(np.where(longer, product, -1.0)))
        n = self.pool[at].within(room, loss)
        if n < self.min_piece:
            return None
        head, rest = self.pool[at].split(n)
        self._wait(rest, at)
        return head

    @staticmethod
    def _powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
        """Cuts a sequence into sequences whose lengths are powers of two."""
        left = sum(p.length for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left, out = left - size, []
            while size:
                piece, pieces = pieces[0], pieces[1:]
                if piece.length > size:
                    piece, rest = piece.split(size)
                    pieces = [rest, *pieces]
                out.append(piece)
                size -= piece.length
            yield out


def pack(examples: DataFrame, tokenizer: str, end_id: int, keep: tuple[str, ...] = ("doc_id",), limits: Limits = Limits(), cut: bool = True, waiting: int = 1024, min_piece: int = 16) -> DataFrame:
    """Pieces of packed sequences: the kept columns, start (ids of the example before the piece), length, loss_tokens, ids (little-endian
    32-bit integers), ids_crc32, doc_tokens (all ids of the example), sequence_id, segment and offset (the piece's place in the sequence).

    examples has `parts`, an array of (text, loss), or else `text`, of which all ids bear loss. An example's ids are those of its parts,
    each encoded by itself, and the end id, which bears loss if the last part does."""
    fields = common.schema_of(examples, keep, _RESULT)
    parts = "parts" in examples.columns
    rows = examples.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *([F.col("parts"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")] if parts else [F.col("text")]))
    end = end_id.to_bytes(4, "little")
    arrow = pa.schema([(f.name, pa.binary() if f.name == "ids" else pa.int32() if f.name == "segment" else pa.int64()) for f in fields.fields[len(keep) :]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = encoder_of(tokenizer), Packer(limits, cut, waiting, min_piece)
        task, done, found, held = TaskContext.get().partitionId() << 32, 0, [], 0
        types: list[pa.DataType] = []

        def batch_of(found: list[list[Piece]], first: int) -> pa.RecordBatch:
            out = []
            for k, pieces in enumerate(found):
                offset = 0
                for segment, p in enumerate(pieces):
                    out.append((p.own, p.start, p.length, p.loss(p.length), p.ids, zlib.crc32(p.ids), p.total, task + first + k, segment, offset))
                    offset += p.length
            own, *columns = zip(*out, strict=True)
            kept = [pa.array(x, t) for x, t in zip(zip(*own, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True))], names=fields.names)

        def sequences() -> Iterator[list[Piece]]:
            for batch in common.in_chunks(batches):
                types[:] = [batch.column(k).type for k in range(len(keep))]
                owns = zip(*(batch.column(k).to_pylist() for k in range(len(keep))), strict=True) if keep else iter([()] * batch.num_rows)
                for own, value in zip(owns, batch.column(len(keep)).to_pylist(), strict=True):
                    bearing, ids, at = [], [], 0
                    for text, loss in [(p["text"], p["loss"]) for p in value or [] if p] if parts else [(value, True)]:
                        ids.append(encoder.encode(text or ""))
                        if loss:
                            bearing.append((at, at + len(ids[-1]) // 4))
                        at += len(ids[-1]) // 4
                    if bearing and bearing[-1][1] == at:
                        bearing[-1] = (bearing[-1][0], at + 1)
                    whole = b"".join([*ids, end])
                    yield from packer.add(Piece(own, whole, 0, at + 1, bearing, at + 1))
            yield from packer.end()

        for pieces in sequences():
            found.append(pieces)
            held += sum(p.length for p in pieces)
            if held >= BATCH_IDS:
                yield batch_of(found, done)
                done, found, held = done + len(found), [], 0
        if found:
            yield batch_of(found, done)

    return common.map_arrow(rows, run, fields)


def turns(conversations: DataFrame, bearing: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Instruction examples of a table of turns: conv_id and parts, in order of turn; turns of the given roles bear loss."""
    part = F.struct(F.col("turn"), F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text"), F.coalesce(F.col("role").isin(*bearing), F.lit(False)).alias("loss"))
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p")).select("conv_id", F.transform("p", lambda x: F.struct(x["text"].alias("text"), x["loss"].alias("loss"))).alias("parts"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    packed = pack(common.table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens")
