"""Search: postings, BM25, hashed vectors, and fusion of rankings."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strataledger.functions.text import term_score

RRF_K = 60
DIM = 512
WHOLE, MOST = 4000, 1500
#: A line that stands as a heading: capitals, digits and light punctuation.
HEADING = re.compile(r"""\d{0,2}\.?\s*[A-Z][A-Z0-9 /()"'.,:&-]{1,78}""")


def break_points(text: str) -> list[int]:
    """Where a chunk may begin: below a blank line, and at a heading of two letters or more."""
    out = set()
    for m in re.finditer(r"[^\n]*(?:\n|\Z)", text):
        words = m[0].strip()
        if not words and m[0]:
            out |= {m.end()} if m[0].endswith("\n") else set()
        elif HEADING.fullmatch(words) and len(re.findall("[A-Z]", words)) > 1:
            out.add(m.start())
    return sorted(out)


def split_text(text: str) -> list[tuple[int, int, int, str]]:
    """Contiguous chunks ``(n, start, end, text)`` of a document.

    A short document is one chunk. A longer one is cut at the last blank line or heading that keeps a chunk within its
    size, else at its size.
    """
    if len(text) <= WHOLE:
        return [(0, 0, len(text), text)]
    points, cuts = break_points(text), [0]
    while cuts[-1] + MOST < len(text):
        limit = cuts[-1] + MOST
        last = bisect.bisect_right(points, limit) - 1
        cuts.append(points[last] if last >= 0 and points[last] > cuts[-1] else limit)
    return [(n, a, b, text[a:b]) for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True))]


CHUNK = T.StructType(
    [
        T.StructField("n", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("chunk", T.StringType()),
    ]
)
#: Documents that are cut at a time, whatever a batch holds.
AT_ONCE = 64


def chunk_documents(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document's chunks, keyed ``document#n``; offsets count code points."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(start, AT_ONCE)
                found = [(row, *cut) for row, text in enumerate(some.column("text").to_pylist()) for cut in split_text(text or "")]
                row, n, begin, end, chunk = zip(*found, strict=True)
                own = [some.column(c).take(pa.array(row, pa.int32())) for c in kept]
                cuts = [pa.array(x, pa.int32()) for x in (n, begin, end)]
                yield pa.RecordBatch.from_arrays([*own, *cuts, pa.array(chunk, pa.string())], names=[*kept, *CHUNK.names])

    out = docs.select(*kept, "text").mapInArrow(run, T.StructType([docs.schema[c] for c in kept] + CHUNK.fields))
    return out.withColumn("chunk_id", F.concat_ws("#", F.col(key).cast("string"), F.col("n").cast("string")))


def postings(chunks: DataFrame, tokens: Column, tenant: str, key: str) -> DataFrame:
    """``tenant, term, key, tf, length`` of every term of every chunk.

    Tokens are made and counted below the explosion, once for each chunk. Chunks are dealt out by key before it, which is
    the only exchange: all terms of a key are then in one task.
    """
    cut = chunks.repartition(key).select(tenant, key, tokens.alias("__tokens"))
    sized = cut.select(tenant, key, F.size("__tokens").alias("length"), "__tokens")
    terms = sized.select(tenant, key, "length", F.explode("__tokens").alias("term"))
    return terms.groupBy(tenant, "term", key).agg(F.count("*").alias("tf"), F.max("length").alias("length"))


def length_stats(index: DataFrame, tenant: str, key: str) -> DataFrame:
    """Chunks and mean length of each tenant; of chunks that have any term."""
    lengths = index.groupBy(tenant, key).agg(F.sum("tf").alias("length"))
    return lengths.groupBy(tenant).agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("mean_length"))


def bm25(index: DataFrame, query: list[str], tenant: str, key: str, allowed: DataFrame | None = None) -> DataFrame:
    """Scores of the chunks with a term of ``query``.

    Statistics cover each whole tenant, whatever ``allowed`` keeps. A repeated term weighs by its count.
    """
    spark = index.sparkSession
    asked = spark.createDataFrame(sorted(Counter(query).items()), "term string, qtf long")
    stats = length_stats(index, tenant, key)
    hits = index.join(F.broadcast(asked), "term")  # one question
    df = hits.groupBy(tenant, "term").agg(F.count("*").alias("df"))
    if allowed is not None:
        hits = hits.join(allowed, key, "left_semi")
    weight = term_score(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean_length"))
    scored = hits.join(df, [tenant, "term"]).join(stats, tenant)
    return scored.groupBy(tenant, key).agg(F.sum(weight * F.col("qtf")).alias("score"))


def best(scores: DataFrame, n: int, key: str, partition: list[str] | None = None) -> DataFrame:
    """The ``n`` best of each partition with their ranks; ties by key."""
    order = W.partitionBy(*(partition or [])).orderBy(F.col("score").desc(), key)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def fuse(rankings: list[DataFrame], key: str, partition: list[str] | None = None) -> DataFrame:
    """Reciprocal rank fusion of rankings with a ``rank`` column."""
    keys = [*(partition or []), key]
    every = rankings[0].select(*keys, "rank")
    for other in rankings[1:]:
        every = every.unionByName(other.select(*keys, "rank"))
    return every.groupBy(*keys).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("score"))


def best_chunk(scores: DataFrame, document: str, chunk: str) -> DataFrame:
    """Each document's best chunk."""
    return scores.groupBy(document).agg(
        F.min_by(chunk, F.struct(-F.col("score"), F.col(chunk))).alias(chunk), F.max("score").alias("score")
    )


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in order of their elements; 0 where lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def dense(vectors: DataFrame, query: Column, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("score", dot(F.col(column), query))


def hashed_vector(text: str) -> np.ndarray:
    """Words and their 3- and 4-grams, hashed into signed slots, damped and normalised."""
    counts: Counter[str] = Counter()
    for word in re.findall(r"[a-z0-9_]+", text.lower()):
        marked = f"^{word}$"
        counts[word] += 1
        counts.update(marked[k : k + n] for n in (3, 4) for k in range(len(marked) - n + 1))
    out = np.zeros(DIM)
    for gram, tf in counts.items():
        digest = hashlib.blake2b(gram.encode(), digest_size=8).digest()
        out[int.from_bytes(digest[:4], "little") % DIM] += (1 if digest[4] & 1 else -1) * (1 + math.log(tf))
    norm = float(np.sqrt((out**2).sum()))
    return out / norm if norm else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: hashed_vector(t or "").astype(np.float32))


def search(
    chunks: DataFrame, index: DataFrame, query: list[str], query_vector: np.ndarray, k: int = 8, mode: str = "hybrid"
) -> DataFrame:
    """Documents by fused ranks of their chunks, per tenant and then over tenants.

    ``chunks``: ``tenant, doc_id, chunk_id, vector``; ``index``: postings of the same chunks. ``mode`` is ``bm25``,
    ``dense`` or ``hybrid``.
    """
    pool = max(5 * k, 40)
    rankings = []
    if mode in ("bm25", "hybrid"):
        rankings.append(best(bm25(index, query, "tenant", "chunk_id"), pool, "chunk_id", ["tenant"]))
    if mode in ("dense", "hybrid"):
        vector = F.array(*(F.lit(float(x)) for x in query_vector))
        scored = dense(chunks.select("tenant", "chunk_id", "vector"), vector, "vector")
        rankings.append(best(scored, pool, "chunk_id", ["tenant"]))
    fused = fuse(rankings, "chunk_id", ["tenant"])
    docs = best_chunk(fused.join(chunks.select("chunk_id", "doc_id"), "chunk_id"), "doc_id", "chunk_id")
    owners = chunks.select("doc_id", "tenant").distinct()
    within = best(docs.join(owners, "doc_id"), pool, "doc_id", ["tenant"])
    across = fuse([within], "doc_id")
    top = across.join(docs.select("doc_id", "chunk_id"), "doc_id").orderBy(F.col("score").desc(), "doc_id")
    return top.limit(k)
