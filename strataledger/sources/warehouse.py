"""A workspace on disk: documents with their chunks and losses, the files they came from, search indexes, an audit log.

Everything that a change touches is committed as one version of the tables (see ``sources.tables``).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.functions.text import slug
from strataledger.operators import retrieval as R
from strataledger.operators import search_index as SI
from strataledger.operators.digests import tree_digest
from strataledger.operators.matching import matched
from strataledger.sources.folder import ids
from strataledger.sources.storage import written
from strataledger.sources.tables import Transaction, Warehouse

# What an index was built with; hours that a ledger row and a report's entry of one loss may differ by.
EMBEDDER, K1, B = "hashing-512", 1.5, 0.75
SAME_HOURS = 0.05
MANIFEST = "path string, sha256 string, size long, doc_ids array<string>, status string, reason string"
#: Tables that hold rows of documents, filed by ``doc_id``.
OF_DOCUMENTS = ("documents", "events", "chunks", "daily", "finals", "incidents")


@dataclass(frozen=True)
class Parsed:
    """What files hold: documents, losses of reports, manifest rows, further tables by ``doc_id``, the losses that ledger
    rows claim, and what is to be said about single rows (``path, line, kind, message``)."""

    documents: DataFrame
    events: DataFrame
    files: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    claims: DataFrame | None = None
    messages: DataFrame | None = None


def _put_documents(now: Transaction, documents: DataFrame, events: DataFrame | None, tables: dict[str, DataFrame] | None = None) -> None:
    now.merge("documents", documents)
    now.merge("chunks", R.chunk_documents(documents.select("doc_id", "tenant", "text")))
    # a document's rows go even where it has none any more
    for name, rows in {"events": events, **(tables or {})}.items():
        if rows is not None:
            now.delete(name, documents.select("doc_id"))
            now.merge(name, rows)


def put_documents(house: Warehouse, documents: DataFrame, events: DataFrame | None = None) -> None:
    """Documents, their chunks and their losses, in place of what stood under their ids."""
    house.commit(lambda now: _put_documents(now, documents, events))


def _delete(now: Transaction, doc_ids: DataFrame) -> None:
    for table in OF_DOCUMENTS:
        now.delete(table, doc_ids.select("doc_id"))


def delete_documents(house: Warehouse, doc_ids: DataFrame) -> None:
    """Drop documents from every table that holds rows of theirs."""
    house.commit(lambda now: _delete(now, doc_ids))


def _delete_files(now: Transaction, paths: DataFrame) -> None:
    manifest = now.read("files", MANIFEST)
    gone = written(manifest.join(paths.select("path"), "path", "left_semi"), "gone-files")
    ids = gone.select(F.explode("doc_ids").alias("doc_id")).distinct()
    rest = manifest.join(paths.select("path"), "path", "left_anti").select(F.explode("doc_ids").alias("doc_id"))
    _delete(now, written(ids.join(rest, "doc_id", "left_anti"), "gone-documents"))
    now.delete("files", gone.select("path"))


def delete_files(house: Warehouse, paths: DataFrame) -> None:
    """Drop files from the manifest, and the documents that no other file produced; unknown paths change nothing."""
    house.commit(lambda now: _delete_files(now, paths))


def chunk_scan(house: Warehouse, tenant: str | None = None) -> DataFrame:
    """Chunks in order, of one tenant if it is named."""
    chunks = house.read("chunks")
    return (chunks if tenant is None else chunks.where(F.col("tenant") == tenant)).orderBy("doc_id", "n")


def register(daily: DataFrame) -> DataFrame:
    """``entity, tenant, rig, first_day, deepest, sections, formations`` of every entity with daily reports."""
    names = lambda c: F.sort_array(F.collect_set(c)).alias(f"{c}s")
    latest = F.max_by("rig", F.struct("day", "doc_id")).alias("rig")
    return daily.where("entity is not null").groupBy("entity").agg(
        F.max("tenant").alias("tenant"), latest, F.min("day").alias("first_day"), F.max("depth_end").alias("deepest"), names("section"), names("formation")
    )


def extraction(daily: DataFrame) -> dict[str, float | None]:
    """Shares of daily reports in which each attribute was found; None without reports."""
    found = {
        "depth": F.col("depth_end").isNotNull(), "section": F.coalesce("section", F.lit("")) != "", "formation": F.coalesce("formation", F.lit("")) != "",
        "mud_weight": F.col("mud_weight").isNotNull(), "npt_blocks": F.col("text").rlike(r"(?m)^NPT DETAIL\s*$"),
    }
    return daily.agg(*(F.avg(F.when(c, 1.0).otherwise(0.0)).alias(k) for k, c in found.items())).first().asDict()


def recorded(now: Transaction, events: DataFrame, documents: DataFrame) -> DataFrame:
    """Losses of daily reports: of this run, and of those on record that this run does not replace."""
    keys = ("entity", "day", "code", "hours")
    if not (now.has("events") and now.has("documents")):
        return events.select(*keys)
    reports = now.read("documents").where("doc_type = 'ddr'").select("doc_id").join(documents.select("doc_id"), "doc_id", "left_anti")
    return events.select(*keys).unionByName(now.read("events").join(reports, "doc_id", "left_semi").select(*keys))


def ingest(
    house: Warehouse, files: DataFrame, read: Callable[[DataFrame], Parsed | tuple], prune: bool = False, dry_run: bool = False
) -> dict:
    """Read what is new or changed, replace what those files produced before, and report; a dry run writes nothing.

    A claim of a ledger row that a daily report records (of the same entity, day and code, within ``SAME_HOURS``) adds no
    loss; its document stays. Claims are never held against each other. The new state is one version of the tables.
    """
    # ids go by all files that are there, whether they are read again or not
    names = [c for c in ("path", "sha256", "stem") if c in files.columns]
    listing = written(files.select(*names), "found-files")
    files = files.join(ids(listing), "path") if "stem" in names else files
    manifest = house.read("files", MANIFEST)
    known = manifest.where("status = 'ingested'").select("path", "sha256")
    fresh = written(listing.join(known, ["path", "sha256"], "left_anti").select("path"), "fresh-files")
    found = read(files.join(fresh, "path", "left_semi"))
    found = found if isinstance(found, Parsed) else Parsed(*found)
    # all of it is read once, before any table changes
    kept = lambda d: d if d is None else written(d, "ingested")
    found = Parsed(kept(found.documents), kept(found.events), kept(found.files), {k: kept(d) for k, d in found.tables.items()}, kept(found.claims), kept(found.messages))
    gone = written(manifest.join(listing.select("path"), "path", "left_anti"), "gone-files")
    counts = {r.status: r["count"] for r in found.files.groupBy("status").count().collect()}
    seen = listing.count()
    events, merged = found.events, 0
    if found.claims is not None:
        marked = written(matched(found.claims, recorded(house.begin(), found.events, found.documents), ["entity", "day", "code"], "hours", SAME_HOURS), "claims")
        merged = marked.where("matched").count()
        events = events.unionByName(marked.where("not matched").drop("matched"), allowMissingColumns=True)
    report = {
        "files": seen, "read": counts, "unchanged": seen - sum(counts.values()), "gone": gone.count(), "pruned": False, "documents": found.documents.count(),
        "events": events.count(), "merged": merged,
    }
    if "daily" in found.tables:
        report["extraction"] = extraction(found.tables["daily"].join(found.documents.select("doc_id", "text"), "doc_id"))
    if "tenant" in found.documents.columns:
        report["tenants"] = found.documents.select("tenant").distinct().count()
    if found.messages is not None:
        report["messages"] = {r.kind: r["count"] for r in found.messages.groupBy("kind").count().collect()}
    if dry_run:
        return report

    def change(now: Transaction) -> None:
        before = now.read("files", MANIFEST).join(found.files.select("path"), "path", "left_semi").select(F.explode("doc_ids").alias("doc_id"))
        stale = written(before.join(found.documents.select("doc_id"), "doc_id", "left_anti").distinct(), "stale-documents")
        _delete(now, stale)
        _put_documents(now, found.documents, events, found.tables)
        now.merge("files", found.files, "path")
        if prune and report["gone"]:
            _delete_files(now, gone)
        if "daily" in found.tables:
            now.write("entities", register(now.read("daily")), "entity")
        if found.messages is not None:
            now.write("messages", found.messages)

    house.commit(change)
    report["pruned"] = bool(prune and report["gone"])
    return report


def simple_load(spark: SparkSession, folder: str, doc_type: str = "ddr") -> DataFrame:
    """Text files of a folder as documents of one type, with the digests of their texts."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "false").load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.txt$", 1)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    return files.select("path", stem.alias("doc_id"), F.lit(doc_type).alias("doc_type"), text.alias("text"), F.sha2(text, 256).alias("sha256"))


def corpus_hash(documents: DataFrame) -> DataFrame:
    """One digest over all ids and digests of texts, whatever their order."""
    return tree_digest(documents.select(F.concat("doc_id", F.lit(" "), F.sha2("text", 256), F.lit("\n")).alias("line")))


def tenant_hashes(documents: DataFrame) -> DataFrame:
    """``tenant, corpus_hash``: an order-free digest of every tenant, by sums of row digests."""
    row = F.sha2(F.concat_ws("\u0000", "doc_id", F.sha2("text", 256)), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return documents.groupBy("tenant").agg(F.sha2(F.concat_ws("-", F.count("*").cast("string"), *parts), 256).alias("corpus_hash"))


def build_index(house: Warehouse, k1: float = K1, b: float = B, rebuild: bool = True) -> None:
    """Bring the stored index up to the documents, or build it anew; and what it was built from."""
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    built = {"embedder": F.lit(EMBEDDER), "k1": F.lit(k1), "b": F.lit(b), "built_at": F.lit(now), "slug": slug(F.col("tenant"))}

    def change(transaction: Transaction) -> None:
        SI.update(transaction, rebuild)
        transaction.write("index_manifest", tenant_hashes(transaction.read("documents")).withColumns(built))

    house.commit(change)


def index_status(house: Warehouse, k1: float = K1, b: float = B) -> DataFrame:
    """Per tenant: documents, chunks, losses, digest, the index's age in seconds and whether it is stale."""
    documents, chunks = house.read("documents"), house.read("chunks")
    now = tenant_hashes(documents)
    counts = documents.groupBy("tenant").agg(F.count("*").alias("documents"))
    counts = counts.join(chunks.groupBy("tenant").agg(F.count("*").alias("chunks")), "tenant", "left")
    events = house.read("events", "doc_id string, tenant string").groupBy("tenant").agg(F.count("*").alias("events"))
    built = house.read("index_manifest", "tenant string, corpus_hash string, embedder string, k1 double, b double, built_at string, slug string")
    built = built.withColumnRenamed("corpus_hash", "indexed_hash")
    same = F.col("indexed_hash").eqNullSafe(F.col("corpus_hash")) & F.col("embedder").eqNullSafe(EMBEDDER) & F.col("k1").eqNullSafe(k1) & F.col("b").eqNullSafe(b)
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp("built_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    joined = now.join(counts, "tenant").join(events, "tenant", "left").join(built, "tenant", "left")
    return joined.select(
        "tenant", "documents", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("events", F.lit(0)).alias("events"),
        "corpus_hash", "embedder", "built_at", age.alias("age_seconds"), (~same).alias("stale"),
    )


def ensure_index(house: Warehouse, k1: float = K1, b: float = B, rebuild: bool = False) -> bool:
    """Bring the index up to date if any tenant's is missing or old; whether that was needed."""
    if not house.has("documents"):
        return False
    needed = rebuild or not house.has("index_members") or not index_status(house, k1, b).where("stale").isEmpty()
    if needed:
        build_index(house, k1, b, rebuild)
    return needed


def index_hash(house: Warehouse) -> str:
    """A digest of the index's manifest; empty without one."""
    if not house.has("index_manifest"):
        return ""
    lines = house.read("index_manifest").select(F.concat(F.to_json(F.struct("tenant", "corpus_hash", "embedder", "k1", "b")), F.lit("\n")).alias("line"))
    return tree_digest(lines).first().digest


def log(house: Warehouse, kind: str, payload: dict) -> None:
    """Append a line to the audit log."""
    line = {"at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "kind": kind, "payload": json.dumps(payload, default=str, sort_keys=True)}
    house.spark.createDataFrame([line], "at string, kind string, payload string").coalesce(1).write.mode("append").json(f"{house.root}/audit")


def logged(house: Warehouse) -> DataFrame:
    return house.spark.read.schema("at string, kind string, payload string").json(f"{house.root}/audit")
