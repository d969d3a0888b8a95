"""Joins and set operations over ledgers and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Hours that two accounts of one loss may differ by.
HOURS_TOLERANCE = "0.1"


def without_recorded(claims: DataFrame, recorded: DataFrame, tolerance: str = HOURS_TOLERANCE) -> DataFrame:
    """Claims of no recorded loss of that entity, day and code within the tolerance.

    Existence decides, so one recorded loss answers any number of equal claims.
    """
    r = recorded.select(
        F.col("entity").alias("r_entity"), F.col("day").alias("r_day"), F.col("code").alias("r_code"), F.col("hours").alias("r_hours")
    )
    same = (F.col("entity") == F.col("r_entity")) & (F.col("day") == F.col("r_day")) & (F.col("code") == F.col("r_code"))
    near = F.abs(F.col("hours") - F.col("r_hours")) <= F.lit(tolerance).cast("decimal(18,2)")
    return claims.join(r, same & near, "left_anti")


def matched(claims: DataFrame, recorded: DataFrame, keys: list[str], value: str, tolerance: float, most: int = 1_000_000) -> DataFrame:
    """``claims`` with ``matched``: whether a recorded row of equal keys lies within ``tolerance`` of its value.

    A band join over bins as wide as the band: what is recorded becomes one row a bin, with its least and greatest value
    and those of both neighbours, so that a claim meets one row at most. Bins with more than ``most`` claims are dealt
    over several tasks. Null keys and values match nothing.
    """
    bin_of = lambda v: F.floor(v.cast("double") / F.lit(tolerance))
    spans = recorded.where(F.col(value).isNotNull()).groupBy(*keys, bin_of(F.col(value)).alias("__bin")).agg(
        F.min(F.col(value).cast("double")).alias("__low"), F.max(F.col(value).cast("double")).alias("__high")
    )
    # what a claim of a bin can meet: the greatest value below, the bin's own two, the least value above
    near = F.array(
        F.struct((F.col("__bin") - 1).alias("b"), F.array("__low").alias("v")),
        F.struct(F.col("__bin").alias("b"), F.array("__low", "__high").alias("v")),
        F.struct((F.col("__bin") + 1).alias("b"), F.array("__high").alias("v")),
    )
    reach = spans.select(*keys, F.inline(near)).groupBy(*keys, F.col("b").alias("__bin")).agg(F.flatten(F.collect_list("v")).alias("__near"))
    rows = claims.withColumn("__bin", bin_of(F.col(value)))
    crowded = rows.groupBy(*keys, "__bin").agg(F.ceil(F.count("*") / most).alias("__parts")).where("__parts > 1")
    at = [*keys, "__bin"]
    part = F.coalesce("__parts", F.lit(1).cast("long"))
    reach = reach.join(crowded, at, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), part - 1))).drop("__parts")
    # a crowded bin holds more than ``most`` rows, so there are few of them
    rows = rows.join(F.broadcast(crowded), at, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), part)).drop("__parts")
    met = F.exists("__near", lambda v: F.abs(v - F.col(value).cast("double")) <= F.lit(tolerance))
    out = rows.join(reach, [*at, "__part"], "left")
    return out.select(*claims.columns, F.coalesce(met, F.lit(False)).alias("matched"))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether two closed intervals meet; an interval without a start is its end alone."""
    return (F.coalesce(start, end) <= high) & (end >= low)


def depth_band(depth: Column, centre: float, width: float = 100.0) -> Column:
    return depth.between(max(0.0, centre - width), centre + width)


def nearest_in_band(ledger: DataFrame, centre: float, width: float = 100.0) -> DataFrame:
    """Reports with a loss in the band, and how near their nearest one is."""
    inside = ledger.where(depth_band(F.col("depth"), centre, width))
    return inside.groupBy("report_id").agg(F.min(F.abs(F.col("depth") - F.lit(centre))).alias("distance"))


def clean_entities(exposures: DataFrame, losses: DataFrame, place: list[str]) -> DataFrame:
    """Entities exposed in a place that lost nothing there to a code: ``place..., code, entity``."""
    exposed = exposures.select(*place, "entity").distinct()
    codes = losses.select(*place, "code").distinct()
    affected = losses.select(*place, "code", "entity").distinct()
    return exposed.join(codes, place).join(affected, [*place, "code", "entity"], "left_anti")


def clean_of_equipment(exposures: DataFrame, losses: DataFrame, kind: str, name: str, code: str) -> DataFrame:
    """Entities that never used the equipment and never lost hours to the code."""
    used = exposures.where(F.col(kind) == name).select("entity")
    lost = losses.where(F.col("code") == code).select("entity")
    return exposures.select("tenant", "entity").distinct().join(used, "entity", "left_anti").join(lost, "entity", "left_anti")


def entries_of(hits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each hit with its losses in ledger order."""
    rows = ledger.join(hits.select("report_id"), "report_id", "left_semi")
    entries = F.sort_array(F.collect_list(F.struct("line", "code", F.col("hours").cast("double").alias("hours"))))
    return rows.groupBy("report_id").agg(
        F.count("*").alias("n_entries"),
        F.concat_ws(";", F.transform(entries, lambda e: F.concat_ws(":", e["line"].cast("string"), e["code"]))).alias("entries"),
    )


def multiset_match(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of what matches, is missed and is invented, where equal rows match one to one."""
    f = found.groupBy(*keys).agg(F.count("*").alias("f"))
    t = truth.groupBy(*keys).agg(F.count("*").alias("t"))
    both = f.join(t, keys, "full").select(F.coalesce("f", F.lit(0)).alias("f"), F.coalesce("t", F.lit(0)).alias("t"))
    return both.agg(
        F.coalesce(F.sum(F.least("f", "t")), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.greatest(F.col("t") - F.col("f"), F.lit(0))), F.lit(0)).alias("missed"),
        F.coalesce(F.sum(F.greatest(F.col("f") - F.col("t"), F.lit(0))), F.lit(0)).alias("invented"),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def squeezed(text: Column) -> Column:
    """Text with runs of white space as single spaces, as citations are compared."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", " "))


def is_verbatim(text: Column, quote: Column) -> Column:
    return F.contains(squeezed(text), squeezed(quote))


def verbatim_matches(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """``item_id, doc_id`` where the squeezed text of a document holds a squeezed quote: ``doc_id, t``; ``item_id, q``.

    A word inside a quote, between two others, must be a word of the document. Each quote is looked up by that of its
    inner words which the fewest documents have; quotes of less than three words, which have none, meet every document.
    """
    inner = quotes.withColumn("w", F.split("q", " ")).withColumn("w", F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))))
    by_word = docs.select("doc_id", F.explode(F.array_distinct(F.split("t", " "))).alias("word"))
    asked = inner.select("item_id", "q", F.explode("w").alias("word"))
    held = by_word.join(asked.select("word").distinct(), "word")
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    rarest = asked.join(df, "word").groupBy("item_id", "q").agg(
        F.min_by("word", F.struct("df", "word")).alias("word"), F.count("*").alias("n")
    )
    # a quote with a word that no document has is in none
    complete = rarest.join(inner.select("item_id", "q", F.size("w").alias("n")), ["item_id", "q", "n"])
    long = complete.join(by_word, "word").join(docs, "doc_id").where(F.contains("t", "q")).select("item_id", "doc_id")
    short = inner.where(F.size("w") == 0).join(docs, F.contains("t", "q")).select("item_id", "doc_id")
    return long.unionByName(short)
