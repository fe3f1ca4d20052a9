"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Candidates are found by pattern in each text; their hashes are counted over the corpus by distinct repositories and owners, copies of
one text counting as one repository. A value that more than `max_owners` owners hold, or that stands in more than `max_repositories`
different texts (of one owner, too), is a widely copied example; any other is owner-specific and looks live. So a key in a document and
a copy of it stays live, and an example repeated all through one owner's documents does not. Base kinds (assign,
access, hex) are always reported; values of vendor-prefixed tokens (kind "key") are added as spans where they look live.

Positions come from the lengths of matches and of the pieces between them, summed within a document; the pattern engine runs in full only
on texts that have a match at all. Counting goes owner by owner first, so an example that a third of all documents hold reaches the
last step as one row for each owner.

Defined results: a null text is empty; a null owner or repository is a value like any other; equal secrets in one document count once
for its owner; repeated rows each give a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: Patterns of the contract; kind, pattern, group of the value, least length of the value.
BASE = (
    ("assign", "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]{16,}", 0, 20),  # a run that is too short holds no long one, so the least length stands in the pattern
    ("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Prefixed tokens of public services, added where owner-specific.
ADDED = (("key", r"gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 16),)

def matches_of(text: Column, number: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches of a text in order: kind, number, code points before it since the last, its own, ok, hash."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"))
    rows = F.transform(zipped, lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("n"), (F.length(x["v"]) >= least).alias("ok"), F.sha2(x["v"], 256).alias("hash")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:bigint,n:bigint,ok:boolean,hash:string>>"))


def _written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in (*BASE, *ADDED)))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str | None = None, max_owners: int = 2, max_repositories: int = 9, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: columns `keep`, base, added, all_spans (arrays of start, kind, end), their texts base_text and all_text, n_live, n_examples.
    repository: a column that names it; by default the text itself."""
    common.reserved(keep, ("base", "added", "all_spans", "base_text", "all_text", "n_live", "n_examples"))
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(owner).cast("string").alias("owner"), (F.col(repository).cast("string") if repository else F.xxhash64(text).cast("string")).alias("repository"), text.alias("text"))
    found = F.concat(*(matches_of(F.col("text"), i, *x) for i, x in enumerate((*BASE, *ADDED))))
    # written once: the pattern engine runs once, and row numbers stay what they are
    found = common.written(narrow.select(F.monotonically_increasing_id().alias("row"), *(f"k{i}" for i in range(len(keep))), "owner", "repository", found.alias("matches")), "secrets")
    one = found.select("row", "owner", "repository", F.explode("matches").alias("x")).select("row", "owner", "repository", "x.*").where("n is not null")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far)).where("ok").select("row", "owner", "repository", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "hash")
    owners = one.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("_")).groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))
    judged = one.join(owners, "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))
    n_base = len(BASE)
    span = F.struct("start", "kind", "end")
    by_row = judged.groupBy("row").agg(
        F.collect_list(F.when(F.col("kind") < n_base, span)).alias("base"),
        F.collect_list(F.when((F.col("kind") >= n_base) & F.col("live"), span)).alias("added"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_examples"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    out = found.drop("matches", "owner", "repository").join(by_row, "row", "left").withColumns({"base": F.coalesce("base", none), "added": F.coalesce("added", none)})
    every = F.concat("base", "added")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "base", "added", every.alias("all_spans"), _written(F.col("base")).alias("base_text"), _written(every).alias("all_text"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2("base_text", 256).alias("base_sha256"), F.col("all_text").alias("spans"), "n_live", "n_examples")


def _oracle() -> str:
    parts = []
    for i, (kind, pattern, group, least) in enumerate((*BASE, *ADDED)):
        p = pattern.replace("'", "''")
        parts.append(f"""SELECT r, owner, t, {i} AS k, '{kind}' AS kind, len(g) AS a, len(m) AS n, v, i FROM (
            SELECT r, owner, t, i, ms[i] AS m, vs[i] AS v, array_to_string(ps[1:i], '') || array_to_string(ms[1:i - 1], '') AS g FROM (
            SELECT r, owner, t, ms, vs, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
            SELECT r, owner, t, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')))) WHERE len(v) >= {least}""")
    n = len(BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
o AS (SELECT v, count(DISTINCT coalesce('s' || owner, 'n')) <= 2 AND count(DISTINCT (coalesce('s' || owner, 'n'), t)) <= 9 AS live FROM s GROUP BY v),
x AS (SELECT s.*, o.live, kind || ':' || a || ':' || (a + n) AS w FROM s JOIN o USING (v)),
y AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
      string_agg(w, ',' ORDER BY a, k) FILTER (k < {n}) AS base, string_agg(w, ',' ORDER BY a, k) FILTER (k < {n} OR live) AS spans,
      count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM d LEFT JOIN y USING (r)
"""


ORACLE = _oracle()
