"""A stored search index that grows by segments, and exact top-k from it by block maxima.

Chunks of a segment are dealt into shares by document, each put in order of tenant and id and cut into *spans* of at
most ``SPAN``; ``index_members`` names each chunk once, by its span and its place in it. A block is what one term has in
one span: places of chunks with their counts, and the greatest count and the least length among them, which bound the
score of any of them whatever the means become. Blocks are filed by term, so a question reads the buckets of its own
terms.

A segment is never changed. A document that is replaced or dropped leaves its old blocks behind: ``index_gone`` names it
with the segment from which on it counts again, and ``index_terms`` and ``index_sizes`` take what it had off again, so
that statistics are those of an index made anew. ``compact`` makes all segments one.

A question reads the bounds of its terms' blocks first. Spans with the greatest sums of bounds are scored; the k-th best
score of a tenant so far rules out every span that cannot reach it, and only the others are read. Nothing is lost: a
chunk's score is never above the sum of the bounds of its span.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataledger.functions.text import normalise, term_score, tokenize
from strataledger.operators import retrieval as R
from strataledger.sources.storage import new_path, written
from strataledger.sources.tables import BUCKETS, Transaction, Warehouse, bucket_of

#: Chunks in a span; segments beyond which an update makes all of them one; spans that a first pass reads of each tenant.
SPAN, SEGMENTS, FIRST = 128, 8, 8
#: Bounds are widened by this share, which covers the rounding of sums.
WIDER = 1e-9
TABLES = ("index_blocks", "index_members", "index_terms", "index_sizes", "index_gone", "index_chunks")
BLOCK_KEY = ["tenant", "segment", "span"]
CHUNKS = "doc_id string, tenant string, chunk_id string, chunk string"


def index_text(chunk: Column) -> Column:
    """Chunks as they are indexed."""
    return normalise(chunk)


Split = Callable[[Column], Column]


def terms_of(chunks: DataFrame, split: Split = tokenize) -> DataFrame:
    """``doc_id, tenant, chunk_id, length, tokens``."""
    cut = chunks.select("doc_id", "tenant", "chunk_id", split(index_text(F.col("chunk"))).alias("tokens"))
    return cut.select("doc_id", "tenant", "chunk_id", F.size("tokens").cast("long").alias("length"), "tokens")


def in_spans(chunks: DataFrame, count: int, partitions: int, split: Split = tokenize) -> DataFrame:
    """``tenant, share, span, place, chunk_id, doc_id, length, text`` of ``count`` chunks, with the text as it is indexed.

    Chunks that tie in all of the order are named alike, so that spans are the same each time they are made.
    """
    texts = chunks.select("tenant", "chunk_id", "doc_id", index_text(F.col("chunk")).alias("text"))
    sized = texts.withColumn("length", F.size(split(F.col("text"))).cast("long")).where("length > 0")
    shares = count // (4 * SPAN) + 1
    dealt = sized.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares))).repartitionByRange(partitions, "share")
    # a share is some spans, whatever the table's size
    n = F.row_number().over(W.partitionBy("share").orderBy("tenant", "chunk_id", "doc_id", "length")) - 1
    numbered = dealt.withColumn("n", n)
    span, place = F.col("share") * (1 << 32) + F.floor(F.col("n") / SPAN), (F.col("n") % SPAN).cast("int")
    return numbered.select("tenant", "share", span.alias("span"), place.alias("place"), "chunk_id", "doc_id", "length", "text")


def blocks_of(spans: DataFrame, segment: int, split: Split = tokenize) -> DataFrame:
    """Blocks of one segment: ``tenant, term, segment, span, n, top_tf, least_length, place, tf``, the last two arrays.

    Texts travel, not their terms, which take more than twice the bytes. A share is in one partition, and is told by
    both counts so that neither moves rows.
    """
    each = spans.select("tenant", "share", "span", "place", "length", F.explode(split(F.col("text"))).alias("term"))
    counts = each.groupBy("share", "tenant", "term", "span", "place", "length").agg(F.count("*").alias("tf"))
    entry = F.struct("place", F.col("tf").cast("int").alias("tf"))
    # a block holds SPAN chunks at most
    blocks = counts.groupBy("share", "tenant", "term", "span").agg(
        F.lit(segment).alias("segment"), F.count("*").alias("n"), F.max("tf").alias("top_tf"), F.min("length").alias("least_length"),
        F.sort_array(F.collect_list(entry)).alias("entries"),
    )
    return blocks.select("tenant", "term", "segment", "span", "n", "top_tf", "least_length", F.col("entries.place").alias("place"), F.col("entries.tf").alias("tf"))


def _counted(cut: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """What chunks add to the numbers of each term, and of each tenant, or take off."""
    one = F.lit(sign).cast("long")
    terms = cut.select("tenant", "chunk_id", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("tenant", "term").agg((F.count("*") * one).alias("df"))
    sizes = cut.where("length > 0").groupBy("tenant").agg((F.count("*") * one).alias("n"), (F.sum("length") * one).alias("total"))
    return terms, sizes


def update(now: Transaction, rebuild: bool = False, split: Split = tokenize, dense: bool = True) -> str:
    """Bring the index up to ``chunks``; whether that ``added`` a segment, made one of all (``built``), or found ``nothing``.

    Chunks that are not those last indexed, by document and digest of texts, are new; documents of theirs and those that
    are gone leave the index first. ``dense``: whether an index made anew gets vectors of chunks, which only dense search reads.
    """
    chunks = now.read("chunks").select("doc_id", "tenant", "chunk_id", "chunk")
    segment = (now.read("index_sizes").agg(F.max("segment")).first()[0] or 0) + 1 if now.has("index_sizes") else 1
    # an index without members is one of an earlier layout
    rebuild = rebuild or not now.has("index_chunks") or not now.has("index_members") or segment > SEGMENTS
    state = F.sha2(F.concat_ws("\u0000", F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", F.sha2("chunk", 256)))), lambda c: F.concat(c["chunk_id"], c["col2"]))), 256)
    current = written(chunks.groupBy("doc_id", "tenant").agg(state.alias("state")), "index-state")
    if rebuild:
        for table in TABLES:
            now.drop(table)
        segment, fresh = 1, chunks
    else:
        known = now.read("index_state").select("doc_id", "tenant", "state")
        old = written(known.join(current, ["doc_id", "tenant", "state"], "left_anti").select("doc_id"), "index-old")
        new = written(current.join(known, ["doc_id", "tenant", "state"], "left_anti").select("doc_id"), "index-new")
        if old.isEmpty() and new.isEmpty():
            return "nothing"
        was = now.read("index_chunks").join(old, "doc_id", "left_semi")
        terms, sizes = _counted(written(terms_of(was, split), "index-was"), -1)
        now.append("index_terms", terms, "term", ("term",))
        now.append("index_sizes", sizes.withColumn("segment", F.lit(segment)), "tenant")
        now.append("index_gone", old.withColumn("since", F.lit(segment)), "doc_id")
        now.delete("index_chunks", old)
        now.delete("index_vectors", old)
        now.delete("index_state", old)
        fresh = written(chunks.join(new, "doc_id", "left_semi"), "index-fresh")
    count = fresh.count()
    partitions = max(1, min(int(now.spark.conf.get("spark.sql.shuffle.partitions", "200")), count // (16 * SPAN) + 1))
    spans = in_spans(fresh, count, partitions, split)
    members = spans.select("tenant", F.lit(segment).alias("segment"), "span", "place", "chunk_id", "doc_id", "length")
    now.append("index_members", members, "span", ("tenant", "span", "place"))
    now.append("index_blocks", blocks_of(spans, segment, split), "term", ("tenant", "term", "span"), max(BUCKETS, min(4096, count // 200_000)))
    # blocks and members hold all there is to count
    own = F.col("segment") == segment
    terms = now.read("index_blocks").where(own).groupBy("tenant", "term").agg(F.sum("n").alias("df"))
    sizes = now.read("index_members").where(own).groupBy("tenant").agg(F.count("*").alias("n"), F.sum("length").alias("total"))
    now.append("index_terms", terms, "term", ("term",))
    now.append("index_sizes", sizes.withColumn("segment", F.lit(segment)), "tenant")
    vectors = fresh.select("doc_id", "tenant", "chunk_id", R.embed(index_text(F.col("chunk"))).alias("vector"))
    if rebuild:
        if not now.share("index_chunks", "chunks", "doc_id", fresh.columns):
            now.write("index_chunks", fresh, "doc_id")
        if dense:
            now.write("index_vectors", vectors, "doc_id")
        now.write("index_state", current, "doc_id")
        now.write("index_gone", now.spark.createDataFrame([], "doc_id string, since int"), "doc_id")
        return "built"
    now.merge("index_chunks", fresh)
    now.merge("index_vectors", vectors)
    now.merge("index_state", current.join(new, "doc_id", "left_semi"))
    return "added"


def compact(house: Warehouse) -> int:
    """All segments as one, without what is gone; the version."""
    return house.commit(lambda now: update(now, rebuild=True))


@dataclass(frozen=True)
class StoredIndex:
    """The index of one version of a warehouse."""

    now: Transaction
    k1: float = 1.5
    b: float = 0.75

    @staticmethod
    def of(house: Warehouse, k1: float = 1.5, b: float = 0.75) -> StoredIndex:
        return StoredIndex(house.begin(), k1, b)

    def _of_terms(self, table: str, terms: list[str]) -> DataFrame:
        """Rows of some terms: only their buckets are read, and only row groups that may hold one."""
        n = self.now.tables[table].n
        names = self.now.spark.createDataFrame([(t,) for t in terms], "term string")
        buckets = {r[0] for r in names.select(bucket_of(F.col("term"), n)).distinct().collect()}  # as many as the question has words
        return self.now.read(table, buckets=buckets).where(F.col("term").isin(terms))

    def statistics(self, query: Counter, tenants: list[str] | None = None) -> DataFrame:
        """``tenant, term, qtf, df, n, mean_length`` of the terms that a tenant has."""
        asked = self.now.spark.createDataFrame(sorted(query.items()), "term string, qtf long")
        df = self._of_terms("index_terms", list(query)).groupBy("tenant", "term").agg(F.sum("df").alias("df")).where("df > 0")
        sizes = self.now.read("index_sizes").groupBy("tenant").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_length"))
        sizes = sizes if not tenants else sizes.where(F.col("tenant").isin(tenants))
        return df.join(F.broadcast(asked), "term").join(sizes, "tenant")  # one question

    def _score(self, tf: str, length: str) -> Column:
        return term_score(F.col(tf), F.col("df"), F.col("n"), F.col(length), F.col("mean_length"), self.k1, self.b) * F.col("qtf")

    def bounds(self, query: Counter, tenants: list[str] | None = None) -> DataFrame:
        """``tenant, segment, span, bound, blocks``: what a chunk of each span may score at most."""
        blocks = self._of_terms("index_blocks", list(query)).select(*BLOCK_KEY, "term", "top_tf", "least_length")
        each = blocks.join(self.statistics(query, tenants), ["tenant", "term"])
        most = F.sum(self._score("top_tf", "least_length")) * (1 + WIDER)
        return each.groupBy(*BLOCK_KEY).agg(most.alias("bound"), F.count("*").alias("blocks"))

    def _read(self, query: Counter, spans: DataFrame, tenants: list[str] | None, allowed: DataFrame | None) -> DataFrame:
        """``tenant, chunk_id, score`` of all chunks of some spans."""
        spans = spans.select(*BLOCK_KEY)
        blocks = self._of_terms("index_blocks", list(query)).select(*BLOCK_KEY, "term", "place", "tf").join(spans, BLOCK_KEY, "left_semi")
        gone = self.now.read("index_gone").groupBy("doc_id").agg(F.max("since").alias("since"))
        members = self.now.read("index_members").join(spans, BLOCK_KEY, "left_semi").join(gone, "doc_id", "left").where("since is null or segment >= since")
        if allowed is not None:
            members = members.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        hits = blocks.select(*BLOCK_KEY, "term", F.inline(F.arrays_zip("place", "tf"))).join(members, [*BLOCK_KEY, "place"])
        scored = hits.join(self.statistics(query, tenants), ["tenant", "term"])
        return scored.groupBy("tenant", "chunk_id").agg(F.sum(self._score("tf", "length")).alias("score"))

    def best(self, words: list[str], k: int, allowed: DataFrame | None = None, tenants: list[str] | None = None, first: int = FIRST, told: dict | None = None) -> DataFrame:
        """``tenant, chunk_id, score, rank`` of the ``k`` best chunks of each tenant; ties by id.

        ``allowed``: chunks that may be found. ``told`` is filled with numbers of spans and blocks, and of those read.
        """
        query = Counter(words)
        if not query:
            return self.now.spark.createDataFrame([], "tenant string, chunk_id string, score double, rank int")
        spans = written(self.bounds(query, tenants), "index-bounds")
        order = W.partitionBy("tenant").orderBy(F.col("bound").desc(), "segment", "span")
        # the limit by rank is applied before the exchange, so a tenant with most spans sends a few from each task
        top = written(spans.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= first).drop("__r"), "index-first")
        sure = written(R.best(self._read(query, top, tenants, allowed), k, "chunk_id", ["tenant"]), "index-sure")
        bar = sure.groupBy("tenant").agg(F.count("*").alias("found"), F.min("score").alias("bar"))
        # without k scores nothing is proved, so every span may count
        rest = spans.join(top, BLOCK_KEY, "left_anti").join(bar, "tenant", "left").where((F.coalesce("found", F.lit(0)) < k) | (F.col("bound") >= F.col("bar")))
        rest = written(rest.select(*BLOCK_KEY, "blocks"), "index-rest")
        if told is not None:
            sums = lambda d: tuple(x or 0 for x in d.agg(F.count("*"), F.sum("blocks")).first())
            (told["spans"], told["blocks"]), one, two = sums(spans), sums(top), sums(rest)
            told["spans_read"], told["blocks_read"] = one[0] + two[0], one[1] + two[1]
        more = self._read(query, rest, tenants, allowed)
        return R.best(sure.drop("rank").unionByName(more), k, "chunk_id", ["tenant"])

    def vectors(self, allowed: DataFrame | None = None) -> DataFrame:
        """``tenant, chunk_id, vector``."""
        vectors = self.now.read("index_vectors").select("tenant", "chunk_id", "vector")
        return vectors if allowed is None else vectors.join(allowed.select("chunk_id"), "chunk_id", "left_semi")

    def chunks(self, documents: DataFrame | None = None) -> DataFrame:
        """``doc_id, chunk_id`` of the chunks of some documents."""
        chunks = self.now.read("chunks").select("doc_id", "chunk_id")
        return chunks if documents is None else chunks.join(documents.select("doc_id"), "doc_id", "left_semi")


def of_chunks(chunks: DataFrame, k1: float = 1.5, b: float = 0.75, split: Split = tokenize, dense: bool = True) -> StoredIndex:
    """An index of ``chunks`` (``doc_id, tenant, chunk_id, chunk``) in the session's folder for intermediate tables; without
    ``dense`` it has no vectors and serves searches by terms."""
    house = Warehouse(chunks.sparkSession, new_path(chunks.sparkSession, "index"))

    def change(now: Transaction) -> None:
        now.write("chunks", chunks.select("doc_id", "tenant", "chunk_id", "chunk"), "doc_id")
        update(now, True, split, dense)

    house.commit(change)
    return StoredIndex.of(house, k1, b)
