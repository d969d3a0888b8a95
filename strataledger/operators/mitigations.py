"""Recorded practices that answer a problem: sentences of final reports and corrective actions of incidents."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataledger.operators.passages import quote_of
from strataledger.sources.storage import written

# Verbs that open an instruction; phrases of practices and of failures.
VERBS = (
    "run", "confirm", "hold", "condition", "inspect", "pump", "place", "keep", "weight", "record", "spot", "monitor", "replace", "log",
    "pressure", "plan", "call", "review", "raise", "reduce", "maintain", "install",
)
PRACTICES = (
    "hold at least", "held gauge", "only seepage", "inspected and changed", "inspect and change", "rated to", "reduce flow", "cut to",
    "cut flow rate", "sweep", "spot", "spotted",
)
FAILURES = ("packed off", "total losses were taken", "failed", "washout", "required repeated", "stuck", "tight hole", "leaked")
NO_FAILURE = r"\bno\b[^.;]{0,30}\bfailures?\b|\bno\s+pump\s+npt\b"
LOST_VOLUME = r"\blost\b[^.;]{0,20}\bbbl\b"
# Words that put a sentence in the subject of a code.
KEYWORDS = {
    "STUCK_PIPE": ["pack-off", "mud weight", "sg", "salt", "trip"],
    "FISHING": ["fish", "jar", "bha"],
    "WELLBORE_INSTABILITY": ["salt", "sg", "mud weight", "overpull", "tight hole"],
    "HOLE_CLEANING": ["cuttings", "sweep", "hole cleaning", "reaming", "annular velocity"],
    "LOST_CIRCULATION": ["losses", "lcm", "flow rate", "pill"],
    "DOWNHOLE_TOOL_FAILURE": ["mwd", "temperature rating", "temperature"],
    "RIG_REPAIR": ["mud pump", "fluid end"],
    "BOP_TEST_FAILURE": ["bop", "preventer", "pressure test"],
    "CEMENT_ISSUE": ["cement"],
    "WAIT_ON_MATERIALS": ["barite", "materials", "logistics"],
    "WAIT_ON_WEATHER": ["weather", "forecast"],
    "THIRD_PARTY_STANDBY": ["standby", "third party", "third-party"],
    "HSE_STOP": ["hse", "stop work", "lifting", "safety"],
}
KIND_ORDER = ("lesson", "recommendation", "corrective_action")


def phrases(words: Iterable[str]) -> str:
    """A pattern of any of some phrases between word borders, in any case."""
    return r"(?i)\b(?:" + "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in words) + r")\b"


def sentence_kind(sentence: Column) -> Column:
    """``practice`` for an instruction or a success, else ``failure``, else ``neutral``."""
    text = F.trim(F.regexp_replace(sentence, r"\s+", " "))
    told = text.rlike(rf"(?i)^(?:{'|'.join(VERBS)})\b") | text.rlike(phrases(PRACTICES)) | text.rlike("(?i)" + NO_FAILURE)
    went_wrong = text.rlike(phrases(FAILURES)) | text.rlike("(?i)" + LOST_VOLUME)
    return F.when(told, "practice").when(went_wrong, "failure").otherwise("neutral")


def keyword_score(sentence: Column, code: str, keywords: Mapping[str, list[str]] = KEYWORDS) -> Column:
    """How many of a code's keywords a sentence has."""
    score = F.lit(0)
    for word in keywords.get(code, ()):
        score = score + F.when(sentence.rlike(phrases([word])), 1).otherwise(0)
    return score


def names_place(sentence: Column, section: str, formation: str) -> Column:
    """Whether a sentence names the formation, or has the digits of the section among its own; true without a place."""
    if not (section or formation):
        return F.lit(True)
    out = F.lit(False)
    if formation:
        out = out | F.contains(F.lower(sentence), F.lit(formation.lower()))
    digits = re.sub("[^0-9/]", "", section)
    if digits:
        out = out | F.contains(F.regexp_replace(sentence, "[^0-9/]", ""), F.lit(digits))
    return out


def near(words: Column, lead: Column, other_words: Column, other_lead: Column, least: float = 0.8) -> Column:
    """Word sets of enough Jaccard similarity, or the same first 90 letters and digits."""
    union = F.size(F.array_union(words, other_words))
    similar = F.when(union > 0, F.size(F.array_intersect(words, other_words)) / union >= least).otherwise(False)
    return similar | ((lead != "") & (lead == other_lead))


def candidates(
    finals: DataFrame,
    incidents: DataFrame,
    code: str,
    section: str = "",
    formation: str = "",
    tenants: list[str] | None = None,
    clean: DataFrame | None = None,
    keywords: Mapping[str, list[str]] = KEYWORDS,
) -> DataFrame:
    """``score, kind, quote, doc_id, entity, source`` of practice sentences on a code, at a place if one is named.

    ``finals``: ``doc_id, tenant, entity, text, lessons, recommendations``, of the ``clean`` entities if those are known;
    ``incidents``: ``doc_id, tenant, entity, text, code, section, formation, actions``, of any entity.
    """
    in_scope = F.lit(True) if not tenants else F.col("tenant").isin(tenants)
    own = finals.where(in_scope)
    if clean is not None:
        own = own.join(clean.select("entity").distinct(), "entity", "left_semi")
    def marked(column: str, kind: str) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("sentence")))

    listed = F.concat(marked("lessons", "lesson"), marked("recommendations", "recommendation"))
    told = own.select("doc_id", "entity", "text", F.inline(listed)).where(names_place(F.col("sentence"), section, formation))
    there = incidents.where(in_scope & (F.col("code") == code))
    for column, wanted in (("section", section), ("formation", formation)):
        there = there.where(F.col(column) == wanted) if wanted else there
    acted = there.select("doc_id", "entity", "text", F.lit("corrective_action").alias("kind"), F.explode("actions").alias("sentence"))
    every = told.select(*acted.columns).unionByName(acted).withColumn("score", keyword_score(F.col("sentence"), code, keywords))
    every = every.where((F.col("score") > 0) & (sentence_kind(F.col("sentence")) == "practice"))
    quoted = every.withColumn("quote", quote_of("text", "sentence", F.lit(None).cast("string"))).where(F.col("quote").isNotNull())
    source = F.when(F.col("kind") == "corrective_action", "incident").otherwise("eowr")
    return quoted.select("score", "kind", "quote", "doc_id", "entity", source.alias("source"))


def mined(found: DataFrame, most: int = 3, by: tuple[str, ...] = (), few: int = 10_000) -> DataFrame:
    """The best ``most`` candidates of each group ``by`` without near duplicates: ``by, rank, quote, doc_id, entity, source``.

    Equal quotes are one first. Then, ``most`` times, each group's best candidate is taken, and what is near to it goes: the
    same as reading best first, and an aggregate and a filter over all tasks each time. What is taken is broadcast for up to
    ``few`` groups.
    """
    order = F.struct((-F.col("score")).alias("s"), F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind")).alias("k"), "doc_id", "quote")
    single = found.groupBy(*by, "quote").agg(
        F.min(order).alias("order"), F.min_by("entity", order).alias("entity"), F.min_by("source", order).alias("source")
    )
    words = F.array_distinct(F.filter(F.split(F.lower("quote"), "[^a-z0-9]+"), lambda w: w != ""))
    lead = F.substring(F.regexp_replace(F.lower("quote"), "[^a-z0-9]", ""), 1, 90)
    left = written(single.withColumns({"words": words, "lead": lead, "group": F.struct(*by) if by else F.lit(0)}), "candidates")
    picks = []
    for rank in range(1, most + 1):
        kept = F.struct("quote", F.col("order.doc_id").alias("doc_id"), "entity", "source", "words", "lead")
        pick = written(left.groupBy("group").agg(F.min_by(kept, "order").alias("pick")), "mined")
        picks.append(pick.withColumn("rank", F.lit(rank)))
        if rank < most:
            side = F.broadcast(pick) if pick.count() <= few else pick
            gone = near(F.col("words"), F.col("lead"), F.col("pick.words"), F.col("pick.lead")) | (F.col("quote") == F.col("pick.quote"))
            left = left.join(side, "group").where(~gone).drop("pick")
    out = picks[0]
    for pick in picks[1:]:
        out = out.unionByName(pick)
    groups = [F.col(f"group.{c}").alias(c) for c in by]
    return out.select(*groups, "rank", *(F.col(f"pick.{c}").alias(c) for c in ("quote", "doc_id", "entity", "source")))


# What stands above groups of mitigations.
AVOIDED = "Recorded mitigations on wells that avoided it"
GENERAL = "Lessons and recommendations from end-of-well reports"
INCIDENT = "Corrective actions from incident reports with the same NPT code"


def grouped(mitigations: DataFrame, avoided: bool) -> DataFrame:
    """``heading, mitigations``: sentences of final reports and of incidents never share a heading."""
    heading = F.when(F.col("source") == "eowr", F.lit(AVOIDED if avoided else GENERAL)).otherwise(F.lit(INCIDENT))
    row = F.sort_array(F.collect_list(F.struct("rank", "quote", "doc_id", "entity")))
    return mitigations.groupBy(heading.alias("heading"), F.col("source")).agg(row.alias("mitigations")).orderBy("source").drop("source")
