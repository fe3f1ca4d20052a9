"""Token-ID files: one zstandard dictionary, each document compressed by itself, an offset index for single-document reads.

A store is a folder with two tables: `dictionary` (one row: its hash and bytes) and `shards`, one row for each shard of `shard_bytes` or
less (or one document): part, seq, dictionary hash, first token within the part, first and last id, index (doc_id, offset, bytes, tokens) and the frames.
Parts are ranges of ascending doc_id, cut at quantiles of the ids, so the rows of a store by (part, seq) are in order of doc_id. Spark
reads and writes both, so a store can lie wherever Spark's files can.

Texts are encoded word by word through a cache: the tokenizer's words never span white space, so a word's ids are the same alone.

Defined results: null and empty texts give the end id alone; null ids come first; repeated rows each have a frame (equal ids lie by
checksum); an empty table gives a store without shards.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CACHE_WORDS = 150_000  # words of CACHED_LENGTH bytes at most in each of the two caches of a worker
CACHED_LENGTH = 64
SLICE = 1 << 20  # characters of a text that are cut into words at a time
_ENCODED = "part int, doc_id long, n_tokens long, ids_crc32 long, frame binary"
_SHARD = "part int, seq int, dictionary string, first_token long, n_tokens long, first_id long, last_id long, index array<struct<doc_id: long, offset: long, bytes: long, tokens: long>>, frames binary"


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it is printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTES = _byte_characters()
#: ASCII punctuation other than an apostrophe, right after a letter that stays a letter when it is normalized (Latin but for a dotted
#: capital I, Cyrillic, Han): there the tokenizer begins a new piece, whatever stands around it. Letters of other scripts may end in a
#: combining mark once normalized, which takes the punctuation into its piece; words of these are encoded whole.
_TURN = re.compile("[!-&(-/:-@\\[-`{-~](?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u045f\u4e00-\u9fff].)")
#: Characters whose lower case is one character that depends on no other (Latin but for a dotted capital I; punctuation; Han). Letters
#: of these alone are in composed form already.
_FOLDS = re.compile("[\x00-\u012f\u0131-\u024f\u2000-\u206f\u3000-\u9fff]*")
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class Encoder(dict):
    """Texts to little-endian 32-bit ids, the end id appended. As a dictionary it holds the ids of words met of late: when it is full it
    becomes the older of two generations, from which words that come again are taken over.

    Punctuation is held apart from the letters before it. Words of letters take the tokenizer's model alone; all others, and all words of
    a tokenizer that isn't built of a lower-casing normalizer, a split into letters and a byte-level model, take its full encode."""

    def __init__(self, path: str, end_id: int):
        super().__init__()
        self.tokenizer, self.end = _tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
        self.older: dict[str, bytes] = {}
        self.cut, self.normalizer = self.tokenizer.model.tokenize, self.tokenizer.normalizer
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        probes = (("Thing", ","), ("Größe", "."), ("ÉAUX", "!!"), ("a", ""), ("über", "|"))
        self.direct = self.normalizer is not None and all(self._letters(a) == self._full(a) and self._full(a) + self._full(b) == self._full(a + b) for a, b in probes)
        self.folds = self.direct and self._full("ÀBÇ ŽŸ! It'S") == self._full("àbç žÿ! it's")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _full(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of letters; none where the normalizer makes anything else of it."""
        if word.isascii():
            word = word.lower()
        else:
            word = word.lower() if _FOLDS.fullmatch(word) else self.normalizer.normalize_str(word)
            if not word.isalpha():
                return None
            word = word.encode().decode("latin-1").translate(_BYTES)
        four = self.four
        return b"".join([four[t.id] for t in self.cut(word)])

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHED_LENGTH:
            return self._full(word)
        found = self.older.get(word)
        if found is None:
            found = (self._letters(word) if self.direct and word.isalpha() else None) or self._full(word)
        self[word] = found
        return found

    def _words(self, text: str) -> list[str]:
        if self.direct and not any(x in text for x in self.added):
            if self.folds and _FOLDS.fullmatch(text):  # a tokenizer without case: fewer different words
                low = text.lower()
                if not any(x in low for x in self.added):
                    text = low
            text = _TURN.sub(r" \g<0>", text)
        return text.replace("\n", " ").split(" ") if any(x in text for x in _SEPARATORS) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            parts, at = [], 0
            text = text or ""
            while len(text) - at > SLICE and (space := text.find(" ", at + SLICE)) >= 0:
                parts.append(b"".join(map(self.__getitem__, self._words(text[at:space]))))
                at = space + 1
            parts.append(b"".join(map(self.__getitem__, self._words(text[at:] if at else text))))
            out.append(b"".join([*parts, self.end]))
            if len(self) > CACHE_WORDS:
                self.older = dict(self)
                self.clear()
        return out


@lru_cache(maxsize=1)
def encoder_of(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path, end_id)


common.CACHES.append(encoder_of.cache_clear)


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample_rows: int = 1000, sample_pieces: int = 1000, piece_ids: int = 2048, size: int = 1 << 16) -> bytes:
    """A dictionary trained on whole texts chosen by hash (about `sample_rows`): their ids are cut into pieces of piece_ids, and
    sample_pieces of all pieces, wherever in a text, are taken by hash (which bounds what the driver holds). If these are too few to
    train on, the pieces themselves are the dictionary; of an empty table it is empty."""
    total = docs.count()
    if not total:
        return b""
    million = 1_000_000
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < max(1, million * sample_rows // total))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, end_id)
        for batch in common.in_chunks(batches):
            found = [x[k : k + 4 * piece_ids] for x in encoder.encode(batch.column(0).to_pylist()) for k in range(0, len(x), 4 * piece_ids)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    samples = sorted(bytes(r[0]) for r in common.map_arrow(chosen.select("text"), pieces, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(sample_pieces).collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def write_store(docs: DataFrame, store: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 4 << 20, level: int = 3) -> None:
    """Encodes docs (doc_id, text) and writes a store at the path `store`."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dictionary = train_dictionary(docs, tokenizer_path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "sha256 string, data binary").coalesce(1).write.parquet(f"{store}/dictionary")
    cuts = docs.select(F.col("doc_id").cast("long").alias("doc_id")).stat.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.001) if parts > 1 else []
    edges = np.unique(np.array(cuts, dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        for batch in common.in_chunks(batches):
            ids = encoder.encode(batch.column(1).to_pylist())
            own = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(edges, own, side="right").astype(np.int32)), batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([squeeze.compress(x) for x in ids], pa.binary())],
                names=["part", "doc_id", "n_tokens", "ids_crc32", "frame"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = None, 0, 0
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            index, offset = [], 0
            for doc_id, n, frame in held:
                index.append({"doc_id": doc_id, "offset": offset, "bytes": len(frame), "tokens": n})
                offset += len(frame)
            ids = [x[0] for x in held if x[0] is not None]
            row = {"part": part, "seq": seq, "dictionary": digest, "first_token": before, "n_tokens": sum(x[1] for x in held), "first_id": ids[0] if ids else None, "last_id": ids[-1] if ids else None, "index": index, "frames": b"".join(x[2] for x in held)}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dictionary", pa.string()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("index", pa.list_(pa.struct([(k, pa.int64()) for k in ("doc_id", "offset", "bytes", "tokens")]))), ("frames", pa.binary())]))

        for batch in batches:
            for p, doc_id, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (p != part or size + len(frame) > shard_bytes):
                    yield shard()
                    before += sum(x[1] for x in held)
                    held, size, seq = [], 0, seq + 1
                if p != part:
                    part, seq, before = p, 0, 0
                held.append((doc_id, n, frame))
                size += len(frame)
        if held:
            yield shard()

    encoded = common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, _ENCODED)
    ordered = encoded.repartition(parts, "part").sortWithinPartitions("part", "doc_id", "n_tokens", "ids_crc32")
    common.map_arrow(ordered.select("part", "doc_id", "n_tokens", "frame"), gather, _SHARD).write.parquet(f"{store}/shards")


def read_store(spark, store: str) -> DataFrame:
    """Documents of a store: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (little-endian 32-bit integers)."""
    known = spark.read.parquet(f"{store}/dictionary").first()
    dictionary, digest = bytes(known["data"]), known["sha256"]
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError("the dictionary of the store is damaged")
    shards = spark.read.schema(_SHARD).parquet(f"{store}/shards")
    # one row for each part, of which there are as many as shuffle partitions when the store was written
    sums = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = sums.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    based = shards.join(F.broadcast(base), F.col("part") == F.col("of")).select("dictionary", "index", "frames", (F.col("base") + F.col("first_token")).alias("first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != digest:
                    raise ValueError("a shard was written with another dictionary")
                frames, at, out = memoryview(row["frames"]), row["first"], []
                for entry in row["index"]:
                    ids = opened.decompress(frames[entry["offset"] : entry["offset"] + entry["bytes"]])
                    out.append((entry["doc_id"], at, len(ids) // 4, zlib.crc32(ids), ids))
                    at += len(ids) // 4
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return common.map_arrow(based, decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark, store: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document (each, where the id is repeated). The range of ids of a shard is pushed down to the files, so only row groups
    that may hold the document are read."""
    known = spark.read.parquet(f"{store}/dictionary").first()
    opened = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(known["data"])))
    shards = spark.read.schema(_SHARD).parquet(f"{store}/shards").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    hits = shards.select(F.explode(F.filter("index", lambda x: x["doc_id"] == doc_id)).alias("x"), "frames").select(F.expr("substring(frames, cast(x.offset as int) + 1, cast(x.bytes as int))").alias("frame"))
    return [np.frombuffer(opened.decompress(bytes(r[0])), dtype="<u4") for r in hits.collect()]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stored(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs into a new store in the shared folder and reads it back."""
    spark = docs.sparkSession
    store = common.fresh_path(spark, "tokens")
    write_store(docs, store, path or tokenizer_path(), end_id)
    return read_store(spark, store)


def op3_token_store(spark, sf_dir: str) -> DataFrame:
    return stored(common.table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
