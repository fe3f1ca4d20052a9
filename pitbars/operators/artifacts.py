"""Snapshots and artifacts: a table and a one-row manifest under an id made of their content, and their verification.

Every artifact is a folder `root/id` with `rows` (Parquet, in parts), `tree` (a digest node for each part; nodes add up to the digest of the
whole), `files` (name, length and time of each file of a part) and `manifest` (JSON). Writing one that is there already verifies it
instead. A part whose files are as they were when written need not be read again to verify the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pitbars.functions import symbols
from pitbars.functions.digest import WORDS, content_digest, node_digest, root_digest, tree_nodes, wrap
from pitbars.operators import evidence, store
from pitbars.operators.panels import panel_product_missing
from pitbars.shared import written

EXECUTION_KINDS = ["execution_prices", "signal_prices", "universe", "instrument_status", "corporate_actions", "market_rules"]


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _parts(rows: DataFrame) -> dict[str, Column]:
    return {c: F.col(f"`{c}`") for c in rows.columns if not c.startswith(PART)}


def table_digest(rows: DataFrame) -> tuple[str, int]:
    """Digest and count of a whole table."""
    found = content_digest(rows, _parts(rows)).first()
    return found["digest"], found["row_count"]


#: Buckets of codes that a year of a snapshot is cut into.
CODE_BUCKETS = 16
#: Columns that name a part of an artifact begin so.
PART = "part_"


def _part_name(columns: list[str]) -> Column:
    """The folder of a part, as Spark names it; of an artifact in one part, an empty text."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns)) if columns else F.lit("")


def part_nodes(rows: DataFrame) -> DataFrame:
    """(part, n, s0 to s3): the digest tree's nodes of rows that carry part columns."""
    return tree_nodes(rows, _parts(rows), {"part": _part_name([c for c in rows.columns if c.startswith(PART)])})


def file_states(spark: SparkSession, root: str) -> DataFrame:
    """(id, part, name, length, modified) of every file of rows below root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    at = r"/([^/]+)/rows/(.*?)/?([^/]+)$"
    return files.where(F.col("path").rlike(at)).select(*(F.regexp_extract("path", at, k).alias(c) for k, c in ((1, "id"), (2, "part"), (3, "name"))), "length", "modified")


def write_artifact(rows: DataFrame, root: str, prefix: str, kind: str, more: dict[str, str] | None = None, by: dict[str, Column] | None = None) -> str:
    """Writes rows under `prefix-<digest>` in parts by the columns `by`, and returns the id; one that is there is verified and kept."""
    spark = rows.sparkSession
    keyed = rows.withColumns({PART + k: c.cast("string") for k, c in (by or {}).items()})
    columns = [PART + k for k in by or {}]
    nodes = written(part_nodes(keyed), "tree")
    found = root_digest(nodes).first()
    name = f"{prefix}-{found['digest'][:16]}"
    if exists(spark, f"{root}/{name}/manifest"):
        problems = verify_artifact(spark, root, name)
        if problems:
            raise ValueError(f"{name} is there and not what it says: {problems}")
        return name
    dealt = keyed.hint("rebalance", *columns) if columns else keyed  # small parts to one file each, large ones to several
    dealt.write.mode("overwrite").partitionBy(*columns).parquet(f"{root}/{name}/rows")
    nodes.write.mode("overwrite").parquet(f"{root}/{name}/tree")
    file_states(spark, f"{root}/{name}").write.mode("overwrite").parquet(f"{root}/{name}/files")
    manifest = {"id": name, "prefix": prefix, "kind": kind, "digest": found["digest"], "row_count": found["row_count"], "columns": ",".join(rows.columns), "details": str(sorted((more or {}).items()))}
    spark.createDataFrame([tuple(manifest.values())], "id string, prefix string, kind string, digest string, row_count long, columns string, details string").coalesce(1).write.mode("overwrite").json(f"{root}/{name}/manifest")
    return name


def artifact_rows(spark: SparkSession, root: str, name: str, parts: list[str] | None = None) -> DataFrame:
    """Rows of an artifact with their part columns; of the given parts, only their files are read."""
    base = f"{root}/{name}/rows"
    reader = spark.read.option("basePath", base)
    return reader.parquet(base) if parts is None else reader.parquet(*(f"{base}/{p}" for p in parts))


def part_problems(spark: SparkSession, root: str, name: str, changed_only: bool = False) -> DataFrame:
    """(part, problem): missing, added, or drifted where a part's rows are not those of the tree. With changed_only, only parts are read
    whose files have another name, length or time than when they were written."""
    tree = spark.read.parquet(f"{root}/{name}/tree")
    if changed_only:
        key = ["part", "name", "length", "modified"]
        said, here = spark.read.parquet(f"{root}/{name}/files").select(*key), file_states(spark, f"{root}/{name}").select(*key)
        parts = [r["part"] for r in evidence.same_set(said, here).select("part").distinct().collect()]  # a folder each
        tree = tree.where(F.col("part").isin(parts))
        there = [r["part"] for r in here.where(F.col("part").isin(parts)).select("part").distinct().collect()]
        nodes = part_nodes(artifact_rows(spark, root, name, there)) if there else tree.limit(0)
    else:
        nodes = part_nodes(artifact_rows(spark, root, name))
    facts = ["n", *WORDS]
    both = tree.select("part", F.struct(*facts).alias("said")).join(nodes.select("part", F.struct(*facts).alias("found")), "part", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("said").isNull(), "added").when(F.col("said") != F.col("found"), "drifted")
    return both.select("part", problem.alias("problem")).where("problem is not null")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, prefix string, kind string, digest string, row_count long, columns string, details string").json(path)


def verify_artifact(spark: SparkSession, root: str, name: str) -> list[str]:
    """What differs between an artifact and its manifest: nothing, if it is what it says."""
    said = _manifest(spark, f"{root}/{name}/manifest").first()
    if said is None:
        return ["manifest_missing"]
    rows = artifact_rows(spark, root, name)
    columns = ",".join(c for c in rows.columns if not c.startswith(PART))
    nodes = written(part_nodes(rows), "tree")
    found, tree = root_digest(nodes).first(), root_digest(spark.read.parquet(f"{root}/{name}/tree")).first()
    checks = {"digest_drifted": found["digest"] != said["digest"], "count_drifted": found["row_count"] != said["row_count"], "tree_drifted": tree["digest"] != said["digest"], "columns_drifted": columns != said["columns"], "id_drifted": name != said["id"] or name != f"{said['prefix']}-{said['digest'][:16]}"}
    return [k for k, bad in checks.items() if bad]


def write_snapshot(bars: DataFrame, root: str, as_of: str, mode: str, codes: DataFrame | None = None, source: str | None = None) -> str:
    """Final bars up to as_of of one price identity, in parts by year and bucket of codes; several identities are an error."""
    rows = store.snapshot_rows(bars, as_of, mode, codes, source)
    store.require_one_identity(rows)
    return write_artifact(rows, root, as_of, "snapshot", {"as_of": as_of, "mode": mode}, {"year": F.year("date"), "bucket": F.pmod(F.crc32("code"), F.lit(CODE_BUCKETS))})


def verify_snapshot(spark: SparkSession, root: str, name: str) -> list[str]:
    """verify_artifact, and: one identity, all rows final and no later than the day of the id."""
    rows = artifact_rows(spark, root, name)
    late = rows.where(~F.col("is_final") | (F.col("date") > F.lit(name[:10]).cast("date"))).limit(1).count()
    several = rows.select(*store.IDENTITY).distinct().limit(2).count() > 1
    return [*verify_artifact(spark, root, name), *(["rows_out_of_range"] if late else []), *(["several_identities"] if several else [])]


def execution_manifest(artifacts: dict[str, DataFrame]) -> DataFrame:
    """One row (kind, digest, row_count, columns) for each of the six artifacts; all are mandatory, and none may repeat a row."""
    missing = sorted(set(EXECUTION_KINDS) - set(artifacts))
    if missing:
        raise ValueError(f"missing artifacts: {missing}")
    parts = []
    for kind in EXECUTION_KINDS:
        rows = artifacts[kind]
        own = {c: F.col(f"`{c}`") for c in rows.columns}
        parts.append(content_digest(rows, own).select(F.lit(kind).alias("kind"), "digest", "row_count", F.lit(",".join(rows.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, parts)


#: What a guard sees of rows as they are written, and what is wrong with that (nothing: null).
Guard = tuple[Observation, Callable[[dict], str | None]]


def _removed(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_execution_snapshot(artifacts: dict[str, DataFrame], authorities: DataFrame, root: str, coverage_end: str, guards: tuple[Guard, ...] = ()) -> str:
    """Six artifacts and their authorities under one id, made of the digests of all. Rows are evaluated once, into a folder beside their place;
    digests are those of what was written. If a guard finds a fault, or an artifact is missing, nothing is left under the id."""
    spark = authorities.sparkSession
    missing = sorted(set(EXECUTION_KINDS) - set(artifacts))
    if missing:
        raise ValueError(f"missing artifacts: {missing}")
    staged = f"{root}/_staged-{uuid4().hex}"
    try:
        for kind, rows in (artifacts | {"authorities": authorities}).items():
            rows.write.parquet(f"{staged}/{kind}")
        faults = [x for seen, fault in guards if (x := fault(seen.get))]
        if faults:
            raise ValueError(f"not exported: {faults}")
        held = {kind: spark.read.parquet(f"{staged}/{kind}") for kind in [*artifacts, "authorities"]}
        if held["authorities"].isEmpty():
            raise ValueError("an execution snapshot without authorities")
        manifest = execution_manifest({k: held[k] for k in artifacts}).unionByName(execution_part(held["authorities"], "authorities"))
        manifest = written(manifest, "manifest")
        digest, _ = table_digest(manifest)
        name = f"{coverage_end}-{digest[:16]}"
        if exists(spark, f"{root}/{name}/manifest"):
            problems = verify_execution_snapshot(spark, root, name)
            if problems:
                raise ValueError(f"{name} is there and not what it says: {problems}")
            return name
        manifest.coalesce(1).write.json(f"{staged}/manifest")
        place = spark._jvm.org.apache.hadoop.fs.Path
        place(staged).getFileSystem(spark._jsc.hadoopConfiguration()).rename(place(staged), place(f"{root}/{name}"))
        return name
    finally:
        _removed(spark, staged)


def execution_part(rows: DataFrame, kind: str) -> DataFrame:
    digest, count = table_digest(rows)
    return rows.sparkSession.createDataFrame([(kind, digest, count, ",".join(rows.columns))], "kind string, digest string, row_count long, columns string")


def verify_execution_snapshot(spark: SparkSession, root: str, name: str) -> list[str]:
    said = spark.read.schema("kind string, digest string, row_count long, columns string").json(f"{root}/{name}/manifest")
    held = {r["kind"]: r for r in said.collect()}  # seven rows
    out = [f"missing:{k}" for k in [*EXECUTION_KINDS, "authorities"] if k not in held]
    for kind, r in held.items():
        digest, count = table_digest(spark.read.parquet(f"{root}/{name}/{kind}"))
        if (digest, count) != (r["digest"], r["row_count"]):
            out.append(f"drifted:{kind}")
    return out if name.endswith(table_digest(said)[0][:16]) else [*out, "id_drifted"]


#: Key columns of each kind of research artifact.
RESEARCH_KEYS = {"calendar": ["date"], "corporate_actions": [], "index_membership": ["requested_date", "index", "code"], "history": ["code", "date"]}


def write_research_artifact(kind: str, rows: DataFrame, root: str, prefix: str) -> str:
    """A research table: keys are unique (whole rows where a kind has no key); never of execution grade."""
    keys = RESEARCH_KEYS[kind] or rows.columns
    if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated rows in a {kind} artifact")
    return write_artifact(rows, root, prefix, kind, {"execution_grade": "false", "authoritative": "false"})


def verify_research_artifact(spark: SparkSession, kind: str, root: str, name: str) -> list[str]:
    said = _manifest(spark, f"{root}/{name}/manifest").first()
    rows = artifact_rows(spark, root, name)
    keys = RESEARCH_KEYS[kind] or rows.columns
    more = {"kind_drifted": said["kind"] != kind, "grade_drifted": said["details"] != "[('authoritative', 'false'), ('execution_grade', 'false')]", "rows_repeated": rows.groupBy(*keys).count().where("count > 1").limit(1).count() > 0}
    if kind == "calendar":
        ends = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
        more["spine_broken"] = evidence.spine_errors(rows, ends).limit(1).count() > 0
    return [*verify_artifact(spark, root, name), *(k for k, bad in more.items() if bad)]


def bootstrap_rows(universe: DataFrame, status: DataFrame, panel: DataFrame, cap: int = 100_000, per_date: int = 10_000) -> DataFrame:
    """(kind, code, date, is_tradable, status, authoritative = false): the whole universe of each day of the panel, and the status of its cells.

    A cell that universe or status lack is an error, as are a panel that may need more than `cap` rows (per_date for each of its days, and
    its cells), more rows than that, and an empty panel."""
    cells = panel.select("code", "date").distinct()
    if cells.isEmpty():
        raise ValueError("bootstrap of an empty panel")
    members = universe.select("code", "date").distinct().join(cells.select("date").distinct(), "date", "left_semi").select("code", "date")
    planned = cells.agg(F.count_distinct("date") * per_date + F.count("*")).scalar()
    held = members.agg(F.count("*")).scalar() + cells.agg(F.count("*")).scalar()
    small = F.when(planned > cap, F.raise_error(F.lit("bootstrap may need more rows than its cap"))).when(held > cap, F.raise_error(F.lit("bootstrap has more rows than its cap"))).otherwise(True)
    joined = cells.join(members.withColumn("member", F.lit(True)), ["code", "date"], "left").join(status.select("code", "date", "is_tradable", "status"), ["code", "date"], "left")
    sure = F.when(F.col("member").isNotNull() & F.col("status").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("bootstrap is incomplete at "), evidence.cell())))
    rows = joined.where(sure).select(F.lit("instrument_status").alias("kind"), "code", "date", "is_tradable", "status")
    whole = members.select(F.lit("universe").alias("kind"), "code", "date", F.lit(None).cast("boolean").alias("is_tradable"), F.lit(None).cast("string").alias("status"))
    return rows.unionByName(whole).where(small).withColumn("authoritative", F.lit(False))


def verify_artifact_refs(spark: SparkSession, folder: str, references: DataFrame) -> DataFrame:
    """(name, problem) of references (name: a path below the folder; sha256) whose file is missing or has other bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    held = files.select(F.regexp_replace("path", "^.*?" + folder.rstrip("/").split("/")[-1] + "/", "").alias("name"), F.sha2("content", 256).alias("found"))
    return references.join(held, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("name", F.when(F.col("found").isNull(), "missing").otherwise("drifted").alias("problem"))


def artifact_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(id, kind, row_count, valid) of every artifact below root, in one plan that reads no rows: valid where the tree adds up to the
    manifest's digest, which the id is made of, and the files are those that were written. verify_artifact reads the rows too."""
    said = _manifest(spark, f"{root}/*/manifest").where("id is not null")
    at = lambda what: F.regexp_extract("_metadata.file_path", f"/([^/]+)/{what}/", 1)
    trees = spark.read.parquet(f"{root}/*/tree").withColumn("id", at("tree"))
    sums = trees.groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(F.col(s) % wrap()).cast("decimal(38,0)").alias(s) for s in WORDS)).select("id", node_digest().alias("root"), "n")
    key = ["id", "part", "name", "length", "modified"]
    due, here = (x.select(*key) for x in (spark.read.parquet(f"{root}/*/files"), file_states(spark, root)))
    changed = evidence.same_set(due, here).select("id").distinct().withColumn("changed", F.lit(True))
    joined = said.join(sums, "id", "left").join(changed, "id", "left")
    named = F.col("id") == F.concat("prefix", F.lit("-"), F.substring("digest", 1, 16))
    return joined.select("id", "kind", "row_count", F.coalesce(named & F.col("changed").isNull() & (F.col("root") == F.col("digest")) & (F.col("n") == F.col("row_count")), F.lit(False)).alias("valid"))


def export_execution_panel(bars: DataFrame, receipts: DataFrame, panel: DataFrame, listings: DataFrame, daily: DataFrame, actions: DataFrame, universe: DataFrame, rules: DataFrame, coverage_start: str, coverage_end: str) -> tuple[dict[str, DataFrame], tuple[Guard, ...]]:
    """(artifacts, guards) for write_execution_snapshot: the six tables of a frozen panel (code, date; warm-up days among them).

    listings: code, ipo, out; daily: code, date, is_st, is_suspended; actions: code, effective_date, cash, multiplier, announced_at, seq;
    universe: code, date, available_at; rules: rule_id, rule_type, parameters. Prices come with their evidence. A cell without price,
    status or membership, a cell of codes and dates that the panel lacks, and a code with no listing or several, are errors where they are
    met. The guards watch the rows go by, in the jobs that write them: the panel's bounds must be those of the coverage, and the ledger of
    actions must not be empty."""
    cells, prices, ledger = panel.select("code", "date").distinct(), Observation("panel"), Observation("ledger")
    start, end = F.lit(coverage_start).cast("date"), F.lit(coverage_end).cast("date")
    lacks = lambda what, ok: F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), evidence.cell())))
    priced = evidence.priced_panel(bars, receipts, panel).select("code", "date", "open", "high", "low", "close", "volume", "receipt_id")
    due = cells.unionByName(panel_product_missing(cells))  # a full panel adds nothing
    whole = due.join(priced, ["code", "date"], "left").where(lacks("evidence", F.col("close").isNotNull()))
    known = listings.groupBy("code").agg(F.count("*").alias("times"), F.max("ipo").alias("ipo"), F.max("out").alias("out"))
    status = cells.join(known, "code", "left").where(lacks("single listing", F.col("times") == 1)).join(daily, ["code", "date"], "left").where(lacks("status", F.col("is_st").isNotNull() & F.col("is_suspended").isNotNull()))
    listed = (F.col("ipo") <= F.col("date")) & (F.col("out").isNull() | (F.col("date") < F.col("out")))
    members = cells.join(universe, ["code", "date"], "left").where(lacks("membership", F.col("available_at").isNotNull()))
    events = actions.where(F.col("effective_date").between(start, end)).join(cells.select("code").distinct(), "code", "left_semi")
    kind = F.when(F.col("multiplier") == 1, "cash_dividend").otherwise("dividend_and_share_distribution")
    different = store.last_by(events, ["code", "effective_date", "cash", "multiplier"], [F.col("seq")]).drop("seq").withColumn("action_type", kind)
    artifacts = {
        "execution_prices": whole.observe(prices, F.min("date").alias("low"), F.max("date").alias("high")),
        "signal_prices": whole.select("code", "date", "close", "receipt_id"),
        "instrument_status": status.select("code", "date", F.when(listed, "listed").otherwise("unlisted").alias("listing_status"), F.col("ipo").alias("listing_date"), symbols.board(F.col("code"), "export").alias("board"), "is_st", "is_suspended"),
        "corporate_actions": different.observe(ledger, F.count("*").alias("n")),
        "universe": members,
        "market_rules": rules.withColumn("effective_date", start),
    }

    def bounds(seen: dict) -> str | None:
        found = str(seen.get("low")), str(seen.get("high"))
        return None if found == (coverage_start, coverage_end) else f"a panel of {found[0]} to {found[1]}"

    return artifacts, ((prices, bounds), (ledger, lambda seen: None if seen.get("n") else "no corporate action"))
