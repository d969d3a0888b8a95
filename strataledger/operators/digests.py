"""Digests of whole tables as trees, and what differs between two.

Lines are filed by the first digits of their own SHA-256: a leaf is the digest of its lines in order, a node that of its
children in order. Leaves are chosen so small that each is a bounded group, whatever the table's size, and lines that
repeat are one line with a count.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataledger.sources.storage import written

#: Lines that a leaf should hold at most, and the least number of digits that name one.
LEAF, DIGITS = 1_000, 2


def leaf_digests(lines: DataFrame, column: str = "line", digits: int | None = None) -> DataFrame:
    """``prefix, n, digest`` of every leaf that holds lines; null lines don't count.

    A leaf's digest is that of its distinct lines in ascending order, each followed by ``*`` and its count where it repeats.
    ``digits`` name a leaf; by default as many as keep one below ``LEAF`` lines.
    """
    each = lines.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("line")).agg(F.count("*").alias("n"))
    if digits is None:
        each = written(each, "digest-lines")
        digits = max(DIGITS, math.ceil(math.log(max(1, each.count()) / LEAF, 16)))
    filed = each.withColumn("prefix", F.substring(F.sha2("line", 256), 1, digits))
    text = F.when(F.col("n") > 1, F.concat("line", F.lit("*"), F.col("n").cast("string"))).otherwise(F.col("line"))
    told = F.transform(F.sort_array(F.collect_list(F.struct("line", text.alias("text")))), lambda x: x["text"])
    return filed.groupBy("prefix").agg(F.sum("n").alias("n"), F.sha2(F.array_join(told, ""), 256).alias("digest"))


def parents(nodes: DataFrame) -> DataFrame:
    """The nodes one digit up: each the digest of up to sixteen children in order."""
    children = F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"])
    up = F.expr("substring(prefix, 1, length(prefix) - 1)")
    return nodes.groupBy(up.alias("prefix")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(children, ""), 256).alias("digest"))


def tree_digest(lines: DataFrame, column: str = "line", digits: int | None = None) -> DataFrame:
    """``digest``: that of the whole table, of no text for an empty one."""
    level = written(leaf_digests(lines, column, digits), "digest-leaves")
    size = level.agg(F.max(F.length("prefix"))).first()[0] or 0
    for _ in range(size):
        level = parents(level)
    return level.agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def differing_leaves(a: DataFrame, b: DataFrame) -> DataFrame:
    """``prefix`` of the leaves of which two trees of equal digits hold different digests, or one none."""
    left, right = a.select("prefix", F.col("digest").alias("a")), b.select("prefix", F.col("digest").alias("b"))
    return left.join(right, "prefix", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")


def differences(a: DataFrame, b: DataFrame, column: str = "line") -> DataFrame:
    """``line, n_a, n_b`` of lines that two tables don't hold equally often; only differing leaves are compared by line."""
    distinct = max(x.select(column).distinct().count() for x in (a, b))
    digits = max(DIGITS, math.ceil(math.log(max(1, distinct) / LEAF, 16)))
    odd = written(differing_leaves(leaf_digests(a, column, digits), leaf_digests(b, column, digits)), "differing-leaves")
    sides = []
    for rows, name in ((a, "n_a"), (b, "n_b")):
        filed = rows.select(F.col(column).alias("line"), F.substring(F.sha2(column, 256), 1, digits).alias("prefix")).join(odd, "prefix", "left_semi")
        sides.append(filed.groupBy("line").agg(F.count("*").alias(name)))
    both = sides[0].join(sides[1], "line", "full").select("line", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n_a", "n_b")))
    return both.where("n_a <> n_b")
