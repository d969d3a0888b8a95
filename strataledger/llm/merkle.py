"""A Merkle manifest of a table: leaves by row, trees by group, one tree over the groups' roots.

Leaves get their places from ranges: the table is dealt by order, each range is numbered by itself, and sums over the
ranges give what lies ahead. A level is one window over the runs of ``ARITY`` neighbours, whatever the size of a group:
the whole frame, collected in order, is both the preimage of the parent and the siblings of each member. Parents come
once from the first member of each run. Ways to the root are put together from the top down.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataledger.llm.storage import partitions_for, written

ARITY = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def group_key(value: Column) -> Column:
    """A key that sorts as null first and then bytewise, and that is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` from 0 within ``group`` by ``order``, and ``n``, the group's size.

    ``order`` must tell rows apart, so that no range has to hold what cannot be split.
    """
    ranges = partitions_for(rows, 16 << 20)
    dealt = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    # the low 33 bits number the rows of a partition
    dealt = dealt.withColumns({"__range": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    dealt = written(dealt, "merkle-ranges")
    spans = dealt.groupBy(group, "__range").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    # one row for each range that holds rows of a group: as many as ranges and groups together
    ahead = F.coalesce(F.sum("__n").over(W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(group, "__range", (ahead - F.col("__first")).alias("__shift"), F.sum("__n").over(W.partitionBy(group)).alias("n"))
    return dealt.join(spans, [group, "__range"]).withColumn("place", F.col("__row") + F.col("__shift")).drop("__range", "__row", "__shift")


def with_runs(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent``, their run's number, and ``run``, the digests of the run in order."""
    nodes = nodes.withColumn("parent", F.floor(F.col("place") / ARITY))
    whole = W.partitionBy("group", "parent").orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return nodes.withColumn("run", F.collect_list("node").over(whole))


def parents(nodes: DataFrame) -> DataFrame:
    """``group, place, n, node`` of the level above, each once; groups that are down to one node have none."""
    runs = with_runs(nodes.where("n > 1").select("group", "place", "n", "node"))
    first = runs.where(F.col("place") % ARITY == 0)
    up = F.ceil(F.col("n") / ARITY)
    return first.select("group", F.col("parent").alias("place"), up.alias("n"), digest(F.array_join("run", "")).alias("node"))


def climb(leaves: DataFrame) -> list[DataFrame]:
    """All levels of the trees, the leaves first; a row with ``n = 1`` is the root of its group."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(parents(levels[-1]), "merkle-level"))
        most = -(-most // ARITY)
    return levels


def roots(levels: list[DataFrame]) -> DataFrame:
    """``group, node``: the root of every group."""
    out = levels[0].where("n = 1").select("group", "node")
    for level in levels[1:]:
        out = out.unionByName(level.where("n = 1").select("group", "node"))
    return out


def _step(place: Column, run: Column) -> Column:
    """What stands to the left and to the right of a node in its run."""
    at = (place % ARITY).cast("int")
    left = F.array_join(F.slice(run, 1, at), "")
    right = F.array_join(F.slice(run, at + 2, ARITY), "")
    return F.struct(left.alias("left"), right.alias("right"))


def with_paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with the columns of ``tops`` (by ``group``) and ``path``, from the leaf up to where ``tops`` starts.

    ``tops``: ``group, path`` and more, for the root of each group.
    """
    extra = [c for c in tops.columns if c not in ("group", "path")]
    above: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        found = levels[k].where("n = 1").join(tops, "group")
        if above is not None:
            side = above.select("group", F.col("place").alias("parent"), F.col("path").alias("__path"), *extra)
            inner = with_runs(levels[k].where("n > 1")).join(side, ["group", "parent"])
            step = F.array(_step(F.col("place"), F.col("run")))
            inner = inner.withColumn("path", F.concat(step, "__path")).drop("parent", "run", "__path")
            found = found.unionByName(inner)
        above = found if k == 0 else written(found, "merkle-paths")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives along its path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows' own columns with ``group, place, n, node, subroot, root, path``; ``levels``: the trees'
    nodes ``group, place, n, node``, leaves first; ``top``: the levels of the tree over the groups' roots."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]


def manifest(rows: DataFrame, order: list[str]) -> Manifest:
    """Trees over ``rows`` with ``group`` (not null), ``node`` (the leaf's digest) and columns that ``order`` names.

    Rows of equal ``order`` and ``node`` are interchangeable, and keep apart by a number of their own.
    """
    rows = written(rows.withColumn("__id", F.monotonically_increasing_id()), "merkle-leaves")
    # leaves are read once for each way, so their places are written
    leaves = written(numbered(rows, "group", [*order, "node", "__id"]).drop("__id"), "merkle-places")
    levels = climb(leaves)
    subroots = roots(levels).select(F.lit("").alias("group"), F.col("group").alias("name"), "node")
    top = climb(written(numbered(subroots, "group", ["name"]), "merkle-subroots"))
    first = roots(top).select("group", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    tops = with_paths(top, first).select(F.col("name").alias("group"), "path", F.col("node").alias("subroot"), "root")
    return Manifest(with_paths(levels, written(tops, "merkle-tops")), levels, top)


def verify_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row of ``docs``.

    A leaf is the digest of ``doc_id, source, lang, n_chars, text``. Leaves stand by ``lang`` in order of ``doc_id``;
    null ids come first, and rows that share an id stand in order of their leaves, so rows repeated whole are leaves of
    their own. Runs of eight become one node until one is left, the subroot; the subroots, null first and then bytewise
    by ``lang``, give the root in the same way. ``proof_sha256`` is the digest of all siblings on the way to the root.
    Where 3 divides the unsigned CRC-32 of the id, the leaf is folded from the text with A-Z in lower case, so
    ``verified`` shows whether that changed the text; a null id changes nothing. Empty texts are values like any other,
    texts may have any length, an empty table gives no rows, and other columns are not read.
    """
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    leaf = lambda text: digest(*(field(F.col(c)) for c in COLUMNS[:-1]), field(text))
    rows = docs.select(
        "doc_id", group_key(F.col("lang")).alias("group"), leaf(F.col("text")).alias("node"), leaf(changed).alias("shown")
    )
    leaves = manifest(rows, ["doc_id"]).leaves
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = leaves.select(
        "doc_id", F.col("node").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.col("shown"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
