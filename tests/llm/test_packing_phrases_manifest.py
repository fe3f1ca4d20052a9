"""Packing, collocations and manifests against brute force, and on nulls, empty, repeated and clashing input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitbars.llm import collocations, merkle, packing
from tests.llm.test_llm import odd

TOKENIZER = packing.tokenizer_path()


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


def test_chunks_encode_as_whole_texts():
    encoder, rng = packing.ChunkEncoder(TOKENIZER), random.Random(1)
    assert encoder.apart
    pool = [*"aZé,.;:!?'-  \n\t\r9½²\x1c\x85\xa0\u3000\u0130\u0416\u0905\u093c漢😀_<|>", "'s", "'ll", "<|endoftext|>", "  ", "\n\n"]
    for _ in range(20000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == encoder._full(text)
    long = "word, and other words. " * 100_000
    assert encoder.encode(long) == encoder._full(long)


def check_pieces(rows, limits):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append(r)
    for pieces in by.values():
        at = 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p["offset"])):
            assert p["offset"] == at and p["segment"] == k and p["length"] > 0
            at += p["length"]
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(p["loss_tokens"] for p in pieces) <= limits.loss
    return by


def test_packing_of_odd_rows(spark):
    tokenizer, docs = Tokenizer.from_file(TOKENIZER), odd(spark)
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    rows = packing.pack(docs, TOKENIZER, 1, keep=("row", "doc_id"), limits=packing.Limits(64, 6, 64)).collect()
    check_pieces(rows, packing.Limits(64, 6, 64))
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["row"]].append(r)
    for d in docs.collect():
        own = sorted(pieces[d["row"]], key=lambda p: p["start"])
        whole = ids_of(tokenizer, d["text"])
        assert b"".join(bytes(p["ids"]) for p in own) == whole and {p["doc_tokens"] for p in own} == {len(whole) // 4} and {p["doc_id"] for p in own} == {d["doc_id"]}
        at = 0
        for p in own:
            assert p["start"] == at and zlib.crc32(bytes(p["ids"])) == p["ids_crc32"]
            at += p["length"]
    assert packing.pack(docs.limit(0), TOKENIZER, 1).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs.withColumnRenamed("row", "offset"), TOKENIZER, 1, keep=("offset",))


def test_packing_pads_little(spark):
    rows = packing.op11_packing(spark, "/root/testdata/sf0.01").collect()
    by = check_pieces(rows, packing.Limits())
    sums = [sum(p["length"] for p in pieces) for pieces in by.values()]
    assert sum(2048 - n for n in sums if n & (n - 1)) < 0.01 * sum(sums)
    assert sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values()) == sum(sums)


def test_packing_of_turns_under_all_limits(spark):
    turns = spark.createDataFrame([(c, t, "assistant" if t % 2 else "user", "w " * ((c * 7 + t * 3) % 40)) for c in range(120) for t in range(4)] + [(500, 0, None, None)], "conv_id long, turn int, role string, text string")
    limits = packing.Limits(256, 5, 100)
    rows = packing.pack(packing.turns(turns), TOKENIZER, 1, keep=("conv_id",), limits=limits, cut=False).collect()
    check_pieces(rows, limits)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    due = collections.Counter()
    for r in turns.collect():
        if r["role"] == "assistant":
            due[r["conv_id"]] += len(tokenizer.encode(f"assistant: {r['text']}\n", add_special_tokens=False).ids) + (r["turn"] == 3)
    got = collections.Counter()
    for r in rows:
        got[r["conv_id"]] += r["loss_tokens"]
    assert +got == +due


def brute_phrases(rows, least, top, share):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\v\f\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) == 1 or a < least:
            continue
        if any(100 * b >= share * a for (g, x), b in f.items() if b >= least and g == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), (a, left, right, n[lang], score)))
    return {(lang, i + 1, x[2].decode(), *x[3]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top])}


@pytest.mark.parametrize("shards", [1, 3])
def test_collocations_against_brute_force(spark, shards):
    rng = random.Random(shards)
    words = ["a", "b", "B", "c", "é", "漢字", "x\x1cy", "de", "en"]
    rows = [(rng.choice(["en", "de", None, "und", "t\tb"]), "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ", ", "\n"]) for _ in range(rng.randint(0, 25)))) for _ in range(90)]
    rows += [("en", None), ("en", ""), (None, " \n"), *[("de", "New York City is big")] * 6]
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "1 as n", "2 as phrase", "3 as key")
    got = {tuple(r) for r in collocations.collocations(docs, min_count=4, shards=shards, top=15).collect()}
    assert got == brute_phrases(rows, 4, 15, 50)
    assert collocations.collocations(docs.limit(0), shards=2).count() == 0


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows, arity):
    """Of rows (doc_id, source, lang, n_chars, text): per row leaf, subroot, root and the proof's digest."""
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, h(*map(text, r)), r))

    def grow(nodes):  # levels, lowest first
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [h(*nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
            levels.append(nodes)
        return levels

    def siblings(levels, at):
        out = []
        for nodes in levels[:-1]:
            first = at - at % arity
            out += [x for k, x in enumerate(nodes[first : first + arity]) if first + k != at]
            at //= arity
        return out

    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {g: grow([x[2] for x in sorted(trees[g], key=lambda x: x[:3])]) for g in langs}
    top = grow([grown[g][-1][0] for g in langs])
    out = collections.Counter()
    for j, g in enumerate(langs):
        for i, x in enumerate(sorted(trees[g], key=lambda x: x[:3])):
            out[x[3][0], x[2], grown[g][-1][0], top[-1][0], h(*siblings(grown[g], i), *siblings(top, j)), top[-1][0], True] += 1
    return out


@pytest.mark.parametrize(("arity", "levels", "n"), [(2, 9, 300), (2, 2, 77), (3, 2, 100), (2, 3, 1)])
def test_manifest_against_brute_force(spark, arity, levels, n):
    rows = [(k % 90 if k % 11 else None, f"s{k % 3}", None if k % 7 == 0 else ["en", "de", "é", "a"][k % 4 if k % 50 else 2], None if k % 5 == 0 else k, None if k % 13 == 0 else "x" * (k % 4)) for k in range(n)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as leaf", "2 as tree", "3 as pos")
    leaves, pages = merkle.build(docs, arity=arity, page_levels=levels)
    got = collections.Counter(tuple(r) for r in merkle.prove(leaves, pages, arity).drop("proof").collect())
    assert got == brute_manifest(rows, arity)


def test_manifest_finds_what_was_changed(spark):
    docs = spark.range(200).selectExpr("id doc_id", "'s' source", "concat('l', id % 3) lang", "id n_chars", "'t' text")
    seen = merkle.leaf_digest([F.when(F.col("doc_id") == 17, "u").otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS])
    out = merkle.prove(*merkle.build(docs, seen=seen))
    assert [r["doc_id"] for r in out.where("not verified").collect()] == [17]
    assert merkle.prove(*merkle.build(docs.limit(0))).count() == 0
    with pytest.raises(ValueError):
        merkle.build(docs.withColumn("root", F.lit(1)), keep=("root",))
