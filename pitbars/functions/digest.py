"""Order-free content digests. Doubles never go into a digest: they are written as decimals with two places first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitbars.functions import canonical


def money(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def canonical_record(**parts: Column) -> Column:
    """Canonical JSON of a record, every value as text or null: different records never read alike."""
    items = [p for k, name in enumerate(sorted(parts)) for p in (F.concat(F.lit("," if k else ""), canonical.string(F.lit(name)), F.lit(":")), F.coalesce(canonical.string(parts[name].cast("string")), F.lit("null")))]
    return F.concat(F.lit("{"), *items, F.lit("}"))


def record_sha256(**parts: Column) -> Column:
    return F.sha2(canonical_record(**parts), 256)


#: Sums of the four 64-bit words of row digests: equal multisets of rows have equal sums, in whatever order and parts they are added up.
WORDS = ["s0", "s1", "s2", "s3"]


def wrap() -> Column:
    """2^64: where sums of words wrap around."""
    return F.lit(str(1 << 64)).cast("decimal(38,0)")


def tree_nodes(rows: DataFrame, parts: dict[str, Column], by: dict[str, Column] | None = None) -> DataFrame:
    """A node (columns of `by`, n, s0 to s3) for each part of a table: row count and sums of the words of its rows' digests. Nodes of parts
    add up to that of the whole; no array of digests is ever gathered."""
    word = lambda k: F.conv(F.substring("d", 16 * k + 1, 16), 16, 10).cast("decimal(28,0)")
    hashed = rows.select(*((c.alias(k)) for k, c in (by or {}).items()), record_sha256(**parts).alias("d"))
    return hashed.groupBy(*(by or {})).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(word(k)), F.lit(0)).cast("decimal(38,0)").alias(s) for k, s in enumerate(WORDS)))


def node_digest() -> Column:
    """SHA-256 of a node: its count and its sums, each modulo 2^64."""
    return F.sha2(F.concat_ws(",", F.col("n").cast("string"), *((F.col(s) % wrap()).cast("decimal(20,0)").cast("string") for s in WORDS)), 256)


def root_digest(nodes: DataFrame) -> DataFrame:
    """One row (digest, row_count) of all nodes together."""
    whole = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *(F.coalesce(F.sum(F.col(s) % wrap()), F.lit(0)).cast("decimal(38,0)").alias(s) for s in WORDS))
    return whole.select(node_digest().alias("digest"), F.col("n").alias("row_count"))


def content_digest(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """One row (digest, row_count) of a table's content, whatever the order of its rows."""
    return root_digest(tree_nodes(rows, parts))


def panel_sha256(entries: Column) -> Column:
    """SHA-256 of the canonical list of a panel's cells (array of symbol@date), sorted: the identity of a registered panel, of a readiness
    report and of an export alike. A panel is bounded by its registration; it is one row."""
    return F.sha2(canonical.encode(F.array_sort(entries), T.ArrayType(T.StringType())), 256)


def panel_digest(panel: DataFrame) -> DataFrame:
    """One row (digest, entries) of a panel's different cells (column panel_entry)."""
    return panel.agg(F.collect_set("panel_entry").alias("e")).select(panel_sha256(F.col("e")).alias("digest"), F.size("e").cast("long").alias("entries"))
