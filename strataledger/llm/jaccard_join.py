"""Exact join of documents by Jaccard similarity of word shingles, over a token-group matrix.

1. Every task hashes the shingles of its documents; ranges of the hash space are counted apart, and the shingles of
   two documents or more, with their numbers of documents, become sorted arrays that workers map into memory.
2. A document can only link to another where enough of its shingles are in those arrays. Such documents keep their
   set; documents of equal sets form classes, and one row stands for a class from here on.
3. Classes are put into groups by the least hash among their shared shingles; a group is split beyond a size. The
   matrix holds, for each shingle, the groups with it in the union of their members' rarest shingles. A class queries
   the groups that have one of its own rarest shingles, which no link can do without.
4. A group task gets its members and its queries. The overlap with the union of the members' sets bounds any link; a
   group that may qualify is opened, and overlaps with all members are counted over its postings at once.
5. Links become components by alternating star contractions.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.llm.hash_arrays import (
    MappedFiles,
    WordHashes,
    chain,
    dealt,
    find,
    from_bytes,
    local_folder,
    mix,
    save,
    size_of,
    sorted_from_bytes,
    sorted_to_bytes,
    sum_by_key,
    to_bytes,
    unique_counts,
    width_of,
)
from strataledger.llm.storage import estimated_bytes, new_path, partitions_for, remove, written, written_at
from strataledger.llm.words import plain_words

#: Shingles that a task gathers before it passes on what it has counted.
GATHERED = 4_000_000
#: Classes in a group, and queries that one task answers for it; and shingles of either, but for one set beyond it.
GROUP_SIZE = 1024
QUERY_SIZE = 2048
MOST_SHINGLES = 8_000_000


def shingle_set(words: WordHashes, text: str | None, size: int) -> np.ndarray:
    """Ascending hashes of the distinct shingles of ``size`` words; of the whole sequence, if that is shorter."""
    h = words.hashes(plain_words(text))
    if not len(h):
        return h
    if len(h) < size:
        return chain(np.array([len(h)], np.uint64), *(h[k : k + 1] for k in range(len(h))))
    return np.unique(chain(*(h[k : len(h) - size + 1 + k] for k in range(size))))


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """How many of its rarest shingles a set of ``n`` must be looked up by, and indexed by for larger sets."""
    probe = n + (-num * n // den) + 1
    index = n + (-2 * num * n // (num + den)) + 1
    return min(n, probe), max(1, min(n, index))


def _parts_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "keys", "more"])


def _edges(bits: int, shards: int) -> np.ndarray:
    """Where equal ranges of hashes of so many bits begin, but for the first."""
    return (np.arange(1, shards, dtype=np.float64) * (2.0**bits / shards)).astype(np.uint64)


def _cut(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """Ascending keys and their counts, by range."""
    cut = np.append(0, np.append(np.searchsorted(keys, edges), len(keys)))
    return [
        (k, sorted_to_bytes(keys[cut[k] : cut[k + 1]]), to_bytes(counts[cut[k] : cut[k + 1]] - 1))
        for k in np.flatnonzero(np.diff(cut)).tolist()
    ]


def _summed(keys: list[bytes], more: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.concatenate([from_bytes(b) for b in more]) + np.uint64(1)
    return sum_by_key(np.concatenate([sorted_from_bytes(b) for b in keys]), counts)


def _shared_shingles(docs: DataFrame, size: int) -> tuple[str, list[str], int, int]:
    """Sorted files of the shingles that more than one row has; folder, names by shard, shards, bits of the hash."""
    spark = docs.sparkSession
    shards = 2 * partitions_for(docs, 8 << 20)
    bits = min(62, max(40, estimated_bytes(docs).bit_length() + 11))
    folder = local_folder(new_path(spark, "shared-shingles"))
    edges, width = _edges(bits, shards), width_of(shards)
    coarse = edges[width - 1 :: width]

    def count(batches):
        words, held, n = WordHashes(), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(shingle_set(words, text.as_py(), size))
                n += len(held[-1])
                if n >= GATHERED:
                    yield _parts_batch(_cut(*unique_counts(np.concatenate(held) >> np.uint64(64 - bits)), coarse))
                    held, n = [], 0
        if n:
            yield _parts_batch(_cut(*unique_counts(np.concatenate(held) >> np.uint64(64 - bits)), coarse))

    def again(batches):
        held, n, before = ([], []), 0, None
        for batch in batches:
            for shard, keys, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and (shard != before or n >= GATHERED):
                    yield _parts_batch(_cut(*_summed(*held), edges))
                    held, n = ([], []), 0
                held[0].append(keys)
                held[1].append(more)
                n, before = n + size_of(keys), shard
        if n:
            yield _parts_batch(_cut(*_summed(*held), edges))

    def merge(table: pa.Table) -> pa.Table:
        keys, n = _summed(table["keys"].to_pylist(), table["more"].to_pylist())
        kept = n > 1
        name = save(folder, keys=keys[kept], n=np.minimum(n[kept], (1 << 32) - 1).astype(np.uint32))
        return pa.table({"shard": table["shard"][:1], "name": [name]}, schema=pa.schema([("shard", pa.int32()), ("name", pa.string())]))

    counted = dealt(docs.select("text").mapInArrow(count, "shard int, keys binary, more binary"), shards, again)
    files = written(counted.groupBy("shard").applyInArrow(merge, "shard int, name string"), "shared-shingle-files")
    names = {r.shard: r.name for r in files.collect()}  # one row per shard
    return folder, [names.get(k) for k in range(shards)], shards, bits


class SharedShingles:
    """Numbers of rows by shingle, from the files."""

    def __init__(self, folder: str, names: list[str | None], shards: int, bits: int) -> None:
        self.files, self.names, self.bits, self.edges = MappedFiles(folder), names, bits, _edges(bits, shards)

    def rows(self, shingles: np.ndarray) -> np.ndarray:
        """For ascending shingles: how many rows have each; 1 stands for one alone."""
        wanted = shingles >> np.uint64(64 - self.bits)
        out = np.ones(len(wanted), np.int64)
        cut = np.append(0, np.append(np.searchsorted(wanted, self.edges), len(wanted)))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            if self.names[k] is None:
                continue
            arrays = self.files.arrays(self.names[k])
            keys, n = arrays["keys"], arrays["n"]
            own = slice(cut[k], cut[k + 1])
            at = find(keys, wanted[own])
            out[own] = np.where(at >= 0, n[np.maximum(at, 0)] if len(n) else 1, 1)
        return out


def _sketches(docs: DataFrame, size: int, num: int, den: int, found: tuple) -> DataFrame:
    """Every row with a hash of its text and its set's size and digest; the set itself only where a link is possible."""

    def run(batches):
        words, shared = WordHashes(), SharedShingles(*found)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(words, t.as_py(), size) for t in part.column(1)]
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                order = np.argsort(flat, kind="stable")
                rows = np.empty(len(flat), np.int64)
                rows[order] = shared.rows(flat[order])
                bounds = np.cumsum([0, *map(len, sets)])
                out = []
                for k, s in enumerate(sets):
                    n, own = len(s), rows[bounds[k] : bounds[k + 1]]
                    digest = xxhash.xxh3_128_digest(s.tobytes()) if n else None
                    if not n or (own > 1).sum() * den < num * n:
                        out.append((n, digest, None, None, None, None))
                        continue
                    probe, index = prefix_lengths(n, num, den)
                    rare = s[np.lexsort((s, own))][:probe].view(np.int64)
                    key = int(mix(s[own > 1] ^ np.uint64(0x5BD1E995)).min().view(np.int64))
                    out.append((n, digest, s.astype("<u8").tobytes(), rare, index, key))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.int64())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *columns],
                    names=["doc_id", "mark", "n", "node", "set", "rare", "n_index", "near"],
                )

    schema = "doc_id long, mark long, n long, node binary, set binary, rare array<long>, n_index int, near long"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    return written(ids.mapInArrow(run, schema), "shingle-sketches")


def _answer(num: int, den: int):
    """Links between the members of a group and its queries."""
    arrow = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64())])

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u8") for b in table["set"].to_pylist()]

    def run(members: pa.Table, queries: pa.Table) -> pa.Table:
        if not members.num_rows or not queries.num_rows:
            return arrow.empty_table()
        order = [("n", "ascending"), ("node", "ascending")]
        members, queries = members.sort_by(order), queries.sort_by(order)
        sets = sets_of(members)
        size = np.array(list(map(len, sets)))
        nodes, asked = members["node"].to_pylist(), queries["node"].to_pylist()
        copies, asked_copies = members["copies"].to_numpy(), queries["copies"].to_numpy()
        keys = list(zip(size.tolist(), nodes, strict=True))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        by_token = np.argsort(flat, kind="stable")
        flat, owner = flat[by_token], owner[by_token]
        starts = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
        union, ends = flat[starts], np.append(starts[1:], len(flat))
        label = np.arange(len(sets))
        edges, degree, asked_degree = [], np.zeros(len(sets), np.int64), np.zeros(len(asked), np.int64)
        for q, (own, node) in enumerate(zip(sets_of(queries), asked, strict=True)):
            n = len(own)
            before = bisect.bisect_left(keys, (n, node))  # members that come first in order of size and node
            at = find(union, own)
            at = at[at >= 0]
            if not before or len(at) * den < num * n:
                continue
            lengths = ends[at] - starts[at]
            places = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            both = np.bincount(owner[places], minlength=len(sets))[:before]
            linked = np.flatnonzero(both * den >= num * (size[:before] + n - both))
            if not len(linked):
                continue
            degree[linked] += asked_copies[q]
            asked_degree[q] += copies[linked].sum()
            roots = np.unique(label[linked])
            edges += [(nodes[r], node) for r in roots.tolist()]
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
        rows = [(a, b, None) for a, b in edges]
        rows += [(nodes[k], None, int(degree[k])) for k in np.flatnonzero(degree).tolist()]
        rows += [(asked[k], None, int(asked_degree[k])) for k in np.flatnonzero(asked_degree).tolist()]
        if not rows:
            return arrow.empty_table()
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    return run


def _links(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges ``a, b`` that connect what is linked, and rows ``a, links`` whose sums are numbers of linked rows."""
    parts = F.greatest(F.ceil(F.count("*") / GROUP_SIZE), F.ceil(F.sum("n") / MOST_SHINGLES))
    sizes = classes.groupBy("near").agg(parts.alias("parts"), F.count("*").alias("alike"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    grouped = classes.join(sizes, "near").withColumn("group", F.xxhash64("near", part))
    grouped = written(grouped.drop("parts"), "shingle-groups")
    index = grouped.select("group", "n", F.explode(F.slice("rare", 1, F.col("n_index"))).alias("token"))
    matrix = index.groupBy("token", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    probes = grouped.select("node", "n", F.col("group").alias("own"), "alike", F.explode("rare").alias("token"))
    fits = (F.col("least") <= F.col("n")) & (F.col("most") * den >= F.col("n") * num)
    alone = (F.col("group") == F.col("own")) & (F.col("alike") == 1)
    asks = probes.join(matrix, "token").where(fits & ~alone).select("node", "n", "group").distinct()
    asks = written(asks, "shingle-asks")
    turns = F.greatest(F.ceil(F.count("*") / QUERY_SIZE), F.ceil(F.sum("n") / MOST_SHINGLES))
    tasks = asks.groupBy("group").agg(turns.alias("turns"))
    tasks = written(tasks, "shingle-tasks")
    members = (
        grouped.select("group", "node", "n", "set", "copies")
        .join(tasks, "group")
        .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)))
        .select("group", "turn", "node", "n", "set", "copies")
    )
    queries = (
        asks.join(tasks, "group")
        .withColumn("turn", F.pmod(F.xxhash64("node", "group"), F.col("turns")))
        .select("group", "turn", "node")
        .join(grouped.select("node", "n", "set", "copies"), "node")
        .toDF("node", "group_q", "turn_q", "n", "set", "copies")
    )
    answers = (
        members.groupBy("group", "turn")
        .cogroup(queries.groupBy("group_q", "turn_q"))
        .applyInArrow(_answer(num, den), "a binary, b binary, links long")
    )
    return written(answers, "shingle-links")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the least node of its component.

    Large-star and small-star steps alternate until nothing changes. Every step is written, so a lost executor costs no
    more than a step; the step before is deleted once the next stands.
    """
    edges, path = written_at(edges.where(F.col("a") != F.col("b")).distinct(), "stars")
    before = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.inline(pairs)).where(F.col("u") != F.col("v")).distinct()
        edges, after = written_at(small.toDF("a", "b"), "stars")
        remove(edges.sparkSession, path)
        path = after
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def jaccard_components(docs: DataFrame, size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``.

    Words are runs of ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Two rows link if ``den`` times the intersection
    of their shingle sets is at least ``num`` times the union. ``component_id`` is the least doc_id that links reach;
    null ids are never the least unless all are null. Rows without words have ``n_shingles`` 0, no links, and their
    own id. Repeated rows link to each other. Shingles are told apart by 64-bit hashes. An empty table gives no rows.
    """
    sketches, labelled = _labelled(docs, size, num, den)
    first = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_class = labelled.join(first, "root").select("node", "component_id", "copies", "links")
    out = sketches.select("doc_id", "n", "node").join(per_class, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    n_links = F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies"), F.lit(1)) - 1
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), n_links.cast("long").alias("n_links"))


def _labelled(docs: DataFrame, size: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows; and for each distinct set its component's ``root``, its copies, links and first row.

    The first row is that of the least id, null last, then of the least hash of its text.
    """
    narrow = docs.select("doc_id", "text")
    sketches = _sketches(narrow, size, num, den, _shared_shingles(narrow, size))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    by_set = sketches.where(F.col("n") > 0).groupBy("node")
    totals = written(by_set.agg(F.min("doc_id").alias("first_id"), F.min(row).alias("first_row"), F.count("*").alias("copies")), "shingle-classes")
    with_sets = sketches.where(F.col("set").isNotNull()).select("node", "n", "set", "rare", "n_index", "near")
    one = with_sets.groupBy("node").agg(*(F.max(c).alias(c) if c != "rare" else F.max("rare").alias(c) for c in with_sets.columns[1:]))
    classes = written(one.join(totals.select("node", "copies"), "node"), "shingle-sets")
    answers = _links(classes, num, den)
    roots = components(answers.where(F.col("b").isNotNull()).select("a", "b"))
    linked = answers.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labelled = totals.join(roots, "node", "left").join(linked, "node", "left")
    return sketches, labelled.withColumn("root", F.coalesce("root", "node"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with exactly one row of each component; rows without words all stay.

    It is a row of the least doc_id, null last; of several such rows one of the text whose hash is least.
    """
    _, labelled = _labelled(docs, size, num, den)
    first = labelled.groupBy("root").agg(F.min("first_row").alias("row"))
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    kept = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    keep = written(first.select(kept.alias("__id"), F.col("row.mark").alias("__text")), "shingle-survivors")
    has_words = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r")) != ""
    full = docs.where(has_words).withColumns({"__id": key, "__text": F.xxhash64("text")})
    full = full.join(keep, ["__id", "__text"], "left_semi").dropDuplicates(["__id", "__text"])
    return full.select(*docs.columns).unionByName(docs.where(~has_words))
