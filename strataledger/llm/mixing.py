"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents stand in key order, in ranges of the key;
prefix sums of word counts over ranges and within ranges say where the source's budget ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataledger.llm.storage import written

#: One row per source is sent to every task only below this many sources.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]+``; 0 for null.

    Each run becomes one letter and the separators go, so no array of words is built.
    """
    runs = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(runs, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """Budget of each source: ``source, source_no, source_size, target``.

    ``sizes``: ``source, source_size``, one row per source. Sources by code point, null last, weigh ``weights`` in
    turn. Targets share ``share`` of all words by weight and stop at ``max_epochs`` times the source; the excess goes
    to the others by weight. That is ``least(max_epochs * size, weight * level)`` for the one level at which the
    targets sum to the total; sources ordered by the level at which they are full give it by prefix sums. The windows
    below see one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_full = W.orderBy("__full", "source_no")
    every = W.partitionBy()
    numbered = sizes.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = (
        numbered.withColumn("__w", weight.cast("double"))
        .withColumn("__cap", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("__full", F.col("__cap") / F.col("__w"))
        .withColumn("__total", F.sum("source_size").over(every) * F.lit(share))
    )
    before = by_full.rowsBetween(W.unboundedPreceding, -1)
    onward = by_full.rowsBetween(0, W.unboundedFollowing)
    level = (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__w").over(onward)
    # the level at which everything fits, were the sources before this one full and no later one
    tried = ranked.withColumn("__level", level)
    first = F.min(F.when(F.col("__level") <= F.col("__full"), F.struct("__full", "source_no", "__level"))).over(every)
    chosen = tried.withColumn("__chosen", first["__level"])
    target = F.when(F.col("__full") <= F.col("__chosen"), F.col("__cap")).otherwise(F.col("__w") * F.col("__chosen"))
    return chosen.select("source", "source_no", "source_size", F.coalesce(target, F.col("__cap")).alias("target"))


def mix(
    rows: DataFrame,
    source: str = "source",
    size: str = "size",
    key: str = "doc_id",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: int = 2,
    salt: str = "mix-1",
    mark: str | None = None,
    range_digits: int | None = None,
) -> DataFrame:
    """Rows with ``source_size``, ``target`` and ``taken``, the words that the mix takes of each row.

    A source's budget is its target rounded down to whole words. Whole epochs take every row once; the rest is taken
    from rows in the order of ``md5(key + salt + mark)``, ties by size, and ends inside a row; null keys and marks count
    as empty. The mark tells rows of one key apart, so that rows without a key don't stand in one range. Rows alike in
    key, mark and size are interchangeable. Null sources are a source; rows of size 0 take 0; an empty table gives an
    empty result. ``range_digits``: hexadecimal digits of the key that name a range, by default so many that a range
    holds some thousands of rows; it changes no result.
    Columns named ``source_size``, ``target`` or ``taken`` in the input are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("source_size", "target", "taken", "source_no")
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"), F.count("*").alias("__n"))
    sizes = written(sizes, "mix-sources")
    n_sources, most = sizes.agg(F.count("*"), F.coalesce(F.max("__n"), F.lit(0))).first()
    targets = written(source_targets(sizes.drop("__n"), weights, share, max_epochs).repartition(1), "mix-targets")
    range_digits = range_digits or min(8, max(2, math.ceil(math.log(most / 5_000 + 1, 16))))
    side = targets.select(F.col("source").alias("__source"), "source_no", "source_size", "target")
    tie = F.coalesce(F.col(mark), F.lit("")) if mark else F.lit("")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    keyed = (
        rows.join(side, rows[source].eqNullSafe(side["__source"]))
        .drop("__source")
        .withColumn("__key", F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(salt), tie)))
        .withColumn("__range", F.substring("__key", 1, range_digits))
    )
    ranges = keyed.groupBy("source_no", "__range").agg(F.sum(size).alias("__sum"))
    # one row per source and range
    ahead = W.partitionBy("source_no").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("source_no", "__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    inside = W.partitionBy("source_no", "__range").orderBy("__key", size).rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(
        ranges, ["source_no", "__range"]
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - F.col("__epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0), F.least(F.col(size), rest - F.col("__ahead") - F.col("__inside")))
    taken = (F.col("__epochs") * F.col(size) + cut).cast("long")
    out = placed.withColumn("__epochs", epochs).withColumn("taken", taken)
    return out.select(*rows.columns, "source_size", "target", "taken")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of whole documents; see :func:`mix`. Null texts have size 0."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("mark"))
    return mix(written(sized, "mix-sizes"), mark="mark", **options).select("doc_id", "size", "source_size", "target", "taken")


def mix_copies(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: every document as often as it is taken, whole, with the columns of ``docs``.

    The row in which a source's budget ends stays if at least half of it is taken. Documents without words stay once,
    as they use nothing of a budget by words.
    """
    names = docs.columns
    # names of their own first, so that no column of the input can stand for one of the mix's
    own = docs.withColumnsRenamed({c: f"__own_{i}" for i, c in enumerate(names) if c not in ("doc_id", "source")})
    text = F.col(f"__own_{names.index('text')}")
    sized = own.withColumns({"__size": word_count(text), "__mark": F.md5(text)})
    mixed = mix(sized, size="__size", mark="__mark", **options)
    copies = F.when(F.col("__size") > 0, F.floor(F.col("taken") / F.col("__size") + 0.5)).otherwise(1).cast("int")
    out = mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return out.select(*(F.col(c if c in ("doc_id", "source") else f"__own_{i}").alias(c) for i, c in enumerate(names)))
