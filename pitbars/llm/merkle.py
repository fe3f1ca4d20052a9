"""Merkle manifest of a table: a hash tree for each group, one tree over their roots, and a proof for every row by a recursive query.

A row is a leaf: the SHA-256 of its fields, each as its length in bytes, a colon and its value. Within a group leaves ascend by `order`;
every `arity` consecutive nodes become their hash until one remains, the group's root; the roots, by group (null first), likewise give
the root of the table. Digests are hashed as lower-case hex text and stored as 32 bytes.

The manifest is two tables. `leaves` has a row for each leaf with its place. `pages` has the nodes, level by level, in rows linked to
their parents: a row holds what lies under one node within `page_levels` levels (by default 512 leaves, 32 KB), so a tree over 10^11 rows
is five rows high and the table has some 65 bytes for each leaf. A Spark recursive query climbs from every leaf: each round joins the row
its nodes lie in, appends the siblings of each level to the proof and folds the digest upward.

At scale: places are ranks of a range partitioning (positions within sorted partitions, plus counts of the partitions before), so no
group is gathered. Rows high in the tree, which very many leaves climb through, are stored once for each `SPREAD` leaves below them and
leaves are dealt over these copies, so the joins have no hot key. Leaves, places, pages and proofs are written to the shared folder.

Defined results: null fields are `-`, an empty text `0:`; a null group is a group, the first; null order values come first; rows equal
in the order value are ordered by their digest, and equal rows are interchangeable; a group of one leaf has that leaf as its root; an
empty table gives no rows. Extra columns of any name play no part; kept columns named like a result are refused.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SPREAD = 1024  # leaves that climb through one copy of a row
TOP = "all"
_RESULT = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof")


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of a row's fields: `-` for null, else UTF-8 byte count, a colon and the value as text; 32 bytes."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds idx, the row's place in its tree by `order` (which must tell rows apart), and total, the rows of the tree."""
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = common.written(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-places")
    placed = placed.withColumns({"pid": F.shiftright("at", 33), "at": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = placed.groupBy("tree", "pid").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    base = runs.select("tree", "pid", (F.sum("n").over(tree.orderBy("pid")) - F.col("n") - F.col("low")).alias("shift"), F.sum("n").over(tree).alias("total"))
    return placed.join(base, ["tree", "pid"]).withColumn("idx", F.col("shift") + F.col("at")).drop("pid", "at", "shift")


def _pages(nodes: DataFrame, level: int, arity: int, height: int) -> DataFrame:
    """Rows of one level from its nodes (tree, idx, digest, total, leaves): `levels` has the digests of each level, concatenated; top is the last."""
    span, run = arity**height, 32 * arity
    grouped = nodes.groupBy("tree", F.floor(F.col("idx") / span).alias("page")).agg(F.max("total").alias("total"), F.sum("leaves").alias("leaves"), F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("children"))
    above = F.when(F.col("total") > span, height).otherwise(F.size(F.filter(F.array(*(F.lit(arity**k).cast("long") for k in range(height))), lambda p: p < F.col("total"))))

    def parents(low: Column) -> Column:
        last = F.floor((F.octet_length(low) - 1) / run).cast("int")
        return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), last), lambda r: F.sha2(F.lower(F.hex(F.substring(low, r * run + 1, run))), 256)), ""))

    first = F.unhex(F.array_join(F.transform("children", lambda c: F.hex(c["digest"])), ""))
    steps = F.when(above > 0, F.sequence(F.lit(1), F.greatest(above, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    levels = F.aggregate(steps, F.array(first), lambda found, _: F.concat(found, F.array(parents(F.element_at(found, -1)))))
    return grouped.withColumn("levels", levels).select("tree", F.lit(level).alias("level"), "page", "total", "leaves", "levels", F.element_at("levels", -1).alias("top"))


def _tree(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """All pages of the trees over nodes (tree, idx, digest, total, leaves), with links to their parents; a tree's root has none."""
    span, level, made = arity**height, 0, []
    while True:
        pages = common.written(_pages(nodes, level, arity, height), "merkle-pages")
        made.append(pages)
        nodes = pages.where(F.col("total") > span).select("tree", F.col("page").alias("idx"), F.col("top").alias("digest"), F.ceil(F.col("total") / span).alias("total"), "leaves")
        if nodes.isEmpty():
            break
        level += 1
    out = made[0]
    for pages in made[1:]:
        out = out.unionByName(pages)
    inner = F.col("total") > span
    link = F.struct(F.col("tree").alias("tree"), (F.col("level") + 1).alias("level"), F.floor(F.col("page") / span).alias("page"), (F.col("page") % span).cast("int").alias("pos"))
    return out.withColumn("up", F.when(inner, link))


def build(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, keep: tuple[str, ...] = ("doc_id",), seen: Column | None = None, arity: int = 2, page_levels: int = 9) -> tuple[DataFrame, DataFrame]:
    """(leaves, pages) of a table. `seen` is the digest to be proved against the tree (by default the leaf itself).

    leaves: own (a struct of the kept columns), leaf, seen, tree, page, pos. pages: tree, level, page, copy, levels, top, up (the parent
    row and the place in it), grown (whether the row ends a group's tree)."""
    common.reserved(keep, _RESULT)
    digest = leaf_digest([F.col(f) for f in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    narrow = docs.select(F.struct(*keep).alias("own"), F.col(order).alias("by"), tree.alias("tree"), digest.alias("leaf"), (digest if seen is None else seen).alias("seen"))
    with common.settings(docs.sparkSession, common.TIDY):
        return _built(narrow, arity, page_levels)


def _built(narrow: DataFrame, arity: int, page_levels: int) -> tuple[DataFrame, DataFrame]:
    span = arity**page_levels
    rows = _ranked(common.written(narrow.withColumn("no", F.monotonically_increasing_id()), "merkle-leaves"), ["by", "leaf", "no"])
    leaves = common.written(rows.select("own", "no", "leaf", "seen", "tree", "idx", "total"), "merkle-leaves")
    groups = _tree(leaves.select("tree", "idx", F.col("leaf").alias("digest"), "total", F.lit(1).cast("long").alias("leaves")), arity, page_levels)
    # the roots of the groups are the leaves of the tree of all; "-" (null) sorts before "="
    roots = _ranked(groups.where("up IS NULL").select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("top").alias("digest"), "leaves"), ["of"])
    roots = common.written(roots, "merkle-roots")
    whole = _tree(roots.drop("of"), arity, page_levels)
    into = F.struct(F.lit(TOP).alias("tree"), F.lit(0).alias("level"), F.floor(F.col("idx") / span).alias("page"), (F.col("idx") % span).cast("int").alias("pos"))
    linked = groups.join(roots.select(F.col("of").alias("tree"), into.alias("onward")), "tree", "left").withColumns({"grown": F.col("up").isNull(), "up": F.coalesce("up", "onward")}).drop("onward")
    pages = common.written(linked.unionByName(whole.withColumn("grown", F.lit(False))), "merkle-pages")
    copies = F.ceil(F.col("leaves") / SPREAD).cast("long")
    parents = pages.select(F.struct("tree", "level", "page").alias("parent"), copies.alias("up_copies"))
    known = pages.withColumn("parent", F.struct(F.col("up.tree").alias("tree"), F.col("up.level").alias("level"), F.col("up.page").alias("page"))).join(parents, "parent", "left")
    pages = common.written(known.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).select("tree", "level", "page", "copy", "levels", "top", "up", "up_copies", "grown"), "merkle-pages")
    return leaves.select("own", "no", "leaf", "seen", "tree", F.floor(F.col("idx") / span).alias("page"), (F.col("idx") % span).cast("int").alias("pos")), pages


def prove(leaves: DataFrame, pages: DataFrame, arity: int = 2) -> DataFrame:
    """For each leaf: the kept columns, leaf, subroot, root, proof (its siblings, level by level), proof_sha256, folded_root (what `seen`
    and the siblings give) and verified. Digests are lower-case hex text; proof is the siblings' bytes."""
    spark, mark = leaves.sparkSession, uuid4().hex
    run = 32 * arity
    left = f"substring(l, (x.pos div {arity}) * {run} + 1, (x.pos % {arity}) * 32)"
    right = f"substring(l, x.pos * 32 + 33, ({arity - 1} - x.pos % {arity}) * 32)"
    step = f"named_struct('pos', cast(x.pos div {arity} as int), 'folded', unhex(sha2(lower(hex(concat({left}, x.folded, {right}))), 256)), 'proof', concat(x.proof, {left}, {right}))"
    start = "named_struct('pos', c.pos, 'folded', c.folded, 'proof', c.proof)"
    leaves.createOrReplaceTempView(f"leaves_{mark}")
    pages.createOrReplaceTempView(f"pages_{mark}")
    try:
        with common.settings(spark, common.TIDY | {"spark.sql.cteRecursionRowLimit": "-1"}):
            climbed = spark.sql(f"""
                WITH RECURSIVE climb(own, no, leaf, tree, level, page, copy, pos, folded, proof, subroot, root) AS (
                  SELECT own, no, leaf, tree, 0, page, 0L, pos, seen, X'', CAST(NULL AS BINARY), CAST(NULL AS BINARY) FROM leaves_{mark}
                  UNION ALL
                  SELECT own, no, leaf, tree, level, page, copy, pos, x.folded, x.proof, subroot, root FROM (
                    SELECT c.own, c.no, c.leaf, p.up.tree AS tree, p.up.level AS level, p.up.page AS page, pmod(c.no, p.up_copies) AS copy, p.up.pos AS pos,
                      aggregate(slice(p.levels, 1, size(p.levels) - 1), {start}, (x, l) -> {step}) AS x,
                      coalesce(c.subroot, CASE WHEN p.grown THEN p.top END) AS subroot, CASE WHEN p.up IS NULL THEN p.top END AS root
                    FROM climb c JOIN pages_{mark} p ON c.tree = p.tree AND c.level = p.level AND c.page = p.page AND c.copy = p.copy))
                SELECT own, leaf, folded, proof, subroot, root FROM climb WHERE root IS NOT NULL""")
            climbed = common.written(climbed, "merkle-proofs")
    finally:
        for name in ("leaves", "pages"):
            spark.catalog.dropTempView(f"{name}_{mark}")
    text = lambda c: F.lower(F.hex(c))
    return climbed.select("own.*", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "proof", F.sha2(text("proof"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    seen = leaf_digest([F.col(f) + tampered.cast("int") if f == "n_chars" else F.col(f) for f in FIELDS])
    leaves, pages = build(docs, seen=seen)
    return prove(leaves, pages).drop("proof")


ORACLE = r"""
WITH RECURSIVE src AS (
  SELECT doc_id, lang, (SELECT list_reduce([0::UBIGINT + 4294967295] || flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT + 8589934592] || list_transform(range(8), lambda b: 17179869184::UBIGINT))),
    lambda c, x: CASE WHEN x < 17179869184 THEN xor(c, x - 8589934592) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars FROM documents),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295::UBIGINT) % 7 = 0 THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM src),
leaves AS (SELECT *, coalesce(changed, leaf) AS seen, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
lists AS (SELECT lang, list(leaf ORDER BY i) AS nodes FROM leaves GROUP BY lang),
levels AS (
  SELECT lang, 0 AS lvl, nodes FROM lists
  UNION ALL
  SELECT lang, lvl + 1, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT lang, lvl AS height, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM levels WHERE len(nodes) = 1),
tops AS (
  SELECT 0 AS lvl, (SELECT list(subroot ORDER BY j) FROM subroots) AS nodes
  UNION ALL
  SELECT lvl + 1, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], ''))) FROM tops WHERE len(nodes) > 1),
climb AS (
  SELECT l.doc_id, l.leaf, l.lang, l.i AS at, 0 AS lvl, l.seen AS folded, '' AS proof FROM leaves l
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang, c.at // 2, c.lvl + 1,
    sha256(CASE WHEN c.at % 2 = 1 THEN v.nodes[c.at] || c.folded ELSE c.folded || coalesce(v.nodes[c.at + 2], '') END),
    c.proof || CASE WHEN c.at % 2 = 1 THEN v.nodes[c.at] ELSE coalesce(v.nodes[c.at + 2], '') END
  FROM climb c JOIN levels v ON v.lang IS NOT DISTINCT FROM c.lang AND v.lvl = c.lvl WHERE len(v.nodes) > 1),
grown AS (SELECT c.doc_id, c.leaf, s.subroot, s.j, c.folded, c.proof FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang AND c.lvl = s.height),
upward AS (
  SELECT doc_id, leaf, subroot, j AS at, 0 AS lvl, folded, proof FROM grown
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.at // 2, u.lvl + 1,
    sha256(CASE WHEN u.at % 2 = 1 THEN v.nodes[u.at] || u.folded ELSE u.folded || coalesce(v.nodes[u.at + 2], '') END),
    u.proof || CASE WHEN u.at % 2 = 1 THEN v.nodes[u.at] ELSE coalesce(v.nodes[u.at + 2], '') END
  FROM upward u JOIN tops v ON v.lvl = u.lvl WHERE len(v.nodes) > 1)
SELECT u.doc_id, u.leaf, u.subroot, t.nodes[1] AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = t.nodes[1] AS verified
FROM upward u JOIN tops t ON t.lvl = u.lvl WHERE len(t.nodes) = 1
"""
