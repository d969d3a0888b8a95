"""Exact top-k by inner product: an impact-ordered index of postings, read score at a time.

1. Vectors are dealt into blocks by the nearest of a few pivots, which come from a bounded sample; every row is
   indexed. A block is written once, as postings: for each quantised impact, from the largest down, and each dimension,
   the vectors whose component has that impact, with the component. The box and the ball that hold it stand beside it.
2. Each query reads one block of its own pivot, which gives it ``k`` scores that it can be sure of.
3. Boxes and balls bound what any other block can hold. Only blocks that may reach the sure scores are read, so what
   cannot count is left out before queries and blocks are dealt to tasks.
4. In a block, segments are read from the largest impact down into the scores of a batch of queries. What unread
   segments can still add is bounded; a vector that cannot reach the ``k`` sure scores is out. Reading stops when the
   vectors that are still possible cost less to score anew, and those are scored exactly; read to the end, the scores
   are exact as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataledger.llm.storage import written

LONG = (-(1 << 63), (1 << 63) - 1)
#: Bounds are computed in doubles; they are widened by this share, which covers their rounding.
WIDER = 1e-9
#: Impacts in a block, and queries that are scored at once.
LEVELS, TOGETHER = 64, 256
#: Shares of postings still unread at which a block asks whether it may stop.
ASKS = (0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)


def as_integers(column: pa.Array | pa.ChunkedArray, scale: int) -> np.ndarray:
    """Rows of ``floor(scale * x)``, whole numbers that doubles hold."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(lists), -1)


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers, for sums that doubles don't hold."""
    return np.array(list(map(int, values.ravel().tolist())), object).reshape(values.shape)


class Block:
    """Postings of some vectors; ``ids`` ascend."""

    def __init__(self, ids: np.ndarray, dim: int, impact: np.ndarray, axis: np.ndarray, place: np.ndarray, component: np.ndarray):
        self.ids, self.dim, self.impact, self.axis, self.place, self.component = ids, dim, impact, axis, place, component

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Block:
        size = np.abs(vectors)
        most = size.max(initial=0)
        # in two steps, as the quotient may exceed what a double holds
        impact = np.minimum(size / (most or 1) * LEVELS, LEVELS - 1).astype(np.int64)
        axis, place = np.nonzero(vectors.T)
        impact = impact[place, axis]
        order = np.lexsort((place, axis, -impact))
        axis, place = axis[order], place[order]
        return cls(ids, vectors.shape[1], impact[order], axis, place, vectors[place, axis])

    def to_bytes(self) -> dict[str, bytes]:
        kinds = {"impact": np.uint8, "axis": "<i4", "place": "<i4", "component": "<f8"}
        return {"ids": self.ids.astype("<i8").tobytes()} | {k: getattr(self, k).astype(t).tobytes() for k, t in kinds.items()}

    @classmethod
    def from_bytes(cls, dim: int, ids: bytes, impact: bytes, axis: bytes, place: bytes, component: bytes) -> Block:
        of = np.frombuffer
        return cls(of(ids, "<i8"), dim, of(impact, np.uint8), of(axis, "<i4"), of(place, "<i4"), of(component, "<f8"))

    def vectors(self) -> np.ndarray:
        out = np.zeros((len(self.ids), self.dim))
        out[self.place, self.axis] = self.component
        return out

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The box (least, greatest) and the ball (centre, radius) that hold the vectors."""
        x = self.vectors()
        centre = (x / len(x)).sum(0)
        low, high = x.min(0), x.max(0)
        with np.errstate(over="ignore", invalid="ignore"):
            radius = np.sqrt(((x - centre) ** 2).sum(1)).max(initial=0)
        return low, high, centre, float(radius) if math.isfinite(radius) else math.inf

    def top(self, query_ids: np.ndarray, queries: np.ndarray, k: int, sure: np.ndarray) -> tuple[list, int]:
        """For each query the positions and scores of its best ``k`` that reach ``sure``; and the products this took.

        ``sure``: a score that ``k`` vectors elsewhere are known to reach, or minus infinity. A query's own id takes no
        part. Ties go to smaller ids.
        """
        out, work = [], 0
        x = self.vectors()
        most = np.abs(queries).sum(1).max(initial=0) * np.abs(self.component).max(initial=0)
        exact = most < 2**53
        for a in range(0, len(query_ids), TOGETHER):
            own = slice(a, a + TOGETHER)
            if exact:
                found, n = self._batch(x, query_ids[own], queries[own], k, sure[own], self.component)
            else:
                found, n = self._batch(_whole(x), query_ids[own], _whole(queries[own]), k, sure[own], _whole(self.component))
            out += found
            work += n
        return out, work

    def _batch(self, x, query_ids, queries, k, sure, component):
        n, m, work, total = len(self.ids), len(query_ids), 0, len(self.component)
        score = np.zeros((n, m), queries.dtype)
        columns = np.ascontiguousarray(queries.T)
        size = np.abs(columns).astype(np.float64)
        length = np.sqrt(((size / (size.max(initial=0) or 1)) ** 2).sum(0)) * (size.max(initial=0) or 1)
        own = self.ids[:, None] == query_ids[None, :]
        starts = np.flatnonzero(np.append(True, (np.diff(self.impact.astype(int)) != 0) | (np.diff(self.axis) != 0))) if total else np.zeros(0, int)
        ends = np.append(starts[1:], total).astype(int)
        asks = [total * s for s in ASKS]
        possible = None
        for start, end in zip(starts.tolist(), ends.tolist(), strict=False):
            at = self.place[start:end]
            score[at] += component[start:end, None] * columns[self.axis[start]]
            work += (end - start) * m
            unread = total - end
            if not (asks and unread <= asks[0] and end < total and self.impact[end] != self.impact[start]):
                continue
            while asks and unread <= asks[0]:
                asks.pop(0)
            alive = ~own & self._reachable(score, size, length, own, k, sure, end)
            if alive.sum() * self.dim <= unread * m:
                possible = alive
                break
        out = []
        for i in range(m):
            if possible is None:
                at = np.flatnonzero(~own[:, i])
                found = score[at, i]
            else:
                at = np.flatnonzero(possible[:, i])
                found = x[at] @ queries[i] if len(at) else np.zeros(0, score.dtype)
                work += len(at) * self.dim
            if sure[i] > -np.inf:
                reach = np.flatnonzero(found >= sure[i])
                at, found = at[reach], found[reach]
            found = np.clip(found, *LONG) if found.dtype == object else found
            found = found.astype(np.int64)
            best = np.lexsort((at, -found.astype(object) if found.min(initial=0) == LONG[0] else -found))[:k]
            out.append((at[best], found[best]))
        return out, work

    def _reachable(self, score, size, length, own, k, sure, end) -> np.ndarray:
        """Which vectors may still be among the best ``k``, or reach ``sure``, once the postings before ``end`` are read."""
        n, scale = len(self.ids), np.abs(self.component[end:]).max(initial=0) or 1.0
        small = np.abs(self.component[end:]) / scale
        norm = np.sqrt(np.bincount(self.place[end:], small**2, n)) * scale
        largest = np.zeros(self.dim)
        np.maximum.at(largest, self.axis[end:], small)
        with np.errstate(over="ignore"):
            by_axis = (largest * scale) @ size
            slack = np.minimum(norm[:, None] * length[None, :], by_axis[None, :]) * (1 + WIDER)
            now = score.astype(np.float64)
            rounding = np.abs(now) * WIDER
            floor = sure.copy()
            if n > k:
                low = np.where(own, -np.inf, now - slack - rounding)
                floor = np.maximum(floor, np.partition(low, n - k, axis=0)[n - k])
            return now + slack + rounding >= floor[None, :]


def best_possible(queries: np.ndarray, low: np.ndarray, high: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """A score that no vector of each block exceeds, for each query."""
    with np.errstate(over="ignore", invalid="ignore"):
        box = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        ball = queries @ centre.T + np.sqrt((queries**2).sum(1))[:, None] * radius[None, :]
        rounding = np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T * WIDER
        return np.nan_to_num(np.fmin(box, ball) + rounding, nan=np.inf)


def pivots_of(vectors: np.ndarray, n: int) -> np.ndarray:
    """Some of the vectors, each far from those before."""
    picked = [0]
    with np.errstate(over="ignore", invalid="ignore"):
        distance = np.nan_to_num(((vectors - vectors[0]) ** 2).sum(1))
        while len(picked) < min(n, len(vectors)) and distance.max() > 0:
            picked.append(int(distance.argmax()))
            distance = np.minimum(distance, np.nan_to_num(((vectors - vectors[picked[-1]]) ** 2).sum(1)))
    return vectors[picked]


DOUBLES = "array<double>"
ROW = f"vec_id long, dim int, pivot int, embedding {DOUBLES}"
PARTS = ("ids", "impact", "axis", "place", "component")
INDEX = "dim int, block long, " + ", ".join(f"{c} binary" for c in PARTS) + f", low {DOUBLES}, high {DOUBLES}, centre {DOUBLES}, radius double"
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("query", "query_id", "vec_id", "score")])
ARROW = pa.schema([(c, pa.int64()) for c in FOUND.names])


def _with_pivots(rows: DataFrame, sample_rows: int, n_pivots: int) -> DataFrame:
    """Rows with the number of their nearest pivot. Pivots come from the ``sample_rows`` rows of least hash."""
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample_rows).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r.dim, []).append(r.embedding)
    chosen = {d: pivots_of(np.array(v, float).reshape(len(v), d), n_pivots) for d, v in by_dim.items() if d}
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            pivot = np.zeros(len(dims), np.int32)
            for d in np.unique(dims).tolist():
                centres = shared.value.get(d)
                if centres is None:  # a length that the sample lacks makes one group
                    continue
                own = np.flatnonzero(dims == d)
                x = batch.column(2).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                with np.errstate(over="ignore", invalid="ignore"):
                    pivot[own] = np.argmax(2 * x @ centres.T - (centres**2).sum(1)[None, :], axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(pivot, pa.int32()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "pivot", "embedding"])

    return rows.mapInArrow(run, ROW)


def _index_row(scale: int):
    """A block's rows as one row: postings and bounds."""
    double = pa.list_(pa.float64())
    schema = pa.schema(
        [("dim", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in PARTS)]
        + [("low", double), ("high", double), ("centre", double), ("radius", pa.float64())]
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        block = Block.of(table["vec_id"].to_numpy(), as_integers(table["embedding"], scale))
        low, high, centre, radius = block.bounds()
        bounds = {"low": low.tolist(), "high": high.tolist(), "centre": centre.tolist(), "radius": radius}
        return pa.Table.from_pylist([{k: table[k][0].as_py() for k in ("dim", "block")} | block.to_bytes() | bounds], schema)

    return run


def _read(index: DataFrame, asked: DataFrame, k: int, scale: int, block_queries: int) -> DataFrame:
    """The best of each asked block for its queries: ``dim, block, query, query_id, sure, embedding`` in."""
    turns = asked.groupBy("dim", "block").agg(F.ceil(F.count("*") / block_queries).alias("turns"))
    blocks = index.select("dim", "block", *PARTS).join(turns, ["dim", "block"])
    blocks = blocks.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")
    asked = asked.join(turns, ["dim", "block"]).withColumn("turn", F.pmod(F.xxhash64("query", "block"), F.col("turns")))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in ("dim", "block", "turn")), "query", "query_id", "sure", "embedding")

    def run(some: pa.Table, wanted: pa.Table) -> pa.Table:
        if not some.num_rows or not wanted.num_rows:
            return ARROW.empty_table()
        block = Block.from_bytes(some["dim"][0].as_py(), *(some[c][0].as_py() for c in PARTS))
        own = wanted["query_id"].to_numpy()
        sure = np.array([-np.inf if x is None else x for x in wanted["sure"].to_pylist()], float)
        found, _ = block.top(own, as_integers(wanted["embedding"], scale), k, sure)
        sizes = [len(at) for at, _ in found]
        columns = [
            np.repeat(wanted["query"].to_numpy(), sizes),
            np.repeat(own, sizes),
            block.ids[np.concatenate([at for at, _ in found])],
            np.concatenate([s for _, s in found]),
        ]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW)

    return blocks.groupBy("dim", "block", "turn").cogroup(asked.groupBy("q_dim", "q_block", "q_turn")).applyInArrow(run, FOUND)


def _promising(queries: DataFrame, index: DataFrame, scale: int, most: int = 4096) -> DataFrame:
    """``dim, query, block`` of blocks other than a query's home whose bounds reach what the query is sure of."""
    limits = index.select("dim", "block", "low", "high", "centre", "radius")
    n = F.broadcast(  # one row for each length of vectors
        limits.groupBy("dim").agg(F.ceil(F.count("*") / most).cast("long").alias("n_b")).join(
            queries.groupBy("dim").agg(F.ceil(F.count("*") / most).cast("long").alias("n_q")), "dim"
        )
    )
    left = limits.join(n, "dim").withColumn("b", F.pmod(F.xxhash64("block"), F.col("n_b")))
    left = left.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_q") - 1))).drop("n_b", "n_q")
    right = queries.join(n, "dim").withColumn("q", F.pmod("query", F.col("n_q")))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_b") - 1)))
    right = right.select(*(F.col(c).alias(f"q_{c}") for c in ("dim", "b", "q")), "query", "home", "sure", "embedding")
    schema = pa.schema([("dim", pa.int32()), ("query", pa.int64()), ("block", pa.int64())])

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return schema.empty_table()
        dim, blocks = some["dim"][0].as_py(), some["block"].to_numpy()
        low, high, centre = (np.array(some[c].to_pylist(), float).reshape(len(blocks), dim) for c in ("low", "high", "centre"))
        y = as_integers(asked["embedding"], scale)
        sure = np.array([-np.inf if x is None else x for x in asked["sure"].to_pylist()], float)
        reach = best_possible(y, low, high, centre, some["radius"].to_numpy()) >= sure[:, None]
        reach &= blocks[None, :] != asked["home"].to_numpy()[:, None]
        q, b = np.nonzero(reach)
        columns = [np.full(len(q), dim), asked["query"].to_numpy()[q], blocks[b]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return left.groupBy("dim", "b", "q").cogroup(right.groupBy("q_dim", "q_b", "q_q")).applyInArrow(run, "dim int, query long, block long")


def top_k(
    vectors: DataFrame,
    k: int = 20,
    modulus: int = 20,
    scale: int = 64,
    block_vectors: int = 4096,
    block_queries: int = 4096,
    sample_rows: int = 2000,
    n_pivots: int = 16,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of every query among all rows but its own.

    Components become ``floor(scale * x)``. Queries are rows whose vec_id is divisible by ``modulus``. Rows with a
    null id, a null vector, or a component that is null or not finite take no part. Vectors meet only vectors of their
    own length. A query meets no row of its own id; queries that repeat id and vector are one query. Scores beyond 64
    bits stand at the limit. An empty table gives no rows.

    A task holds one block of about ``block_vectors`` vectors and some ``block_queries`` queries. Pivots come from
    ``sample_rows`` rows; they decide how rows are grouped, so how much can be left unread, and never what is found.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.col("embedding").cast(DOUBLES).alias("embedding")
    )
    near = written(_with_pivots(rows, sample_rows, n_pivots), "top-k-rows")
    sizes = near.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / block_vectors).cast("long").alias("parts"))
    # equal rows are dealt apart by a random number of the written rows, as a third of them may be equal
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts"))
    dealt = near.join(F.broadcast(sizes), ["dim", "pivot"])  # one row for each pivot and length
    dealt = written(dealt.select("vec_id", "dim", "embedding", (F.col("pivot") * F.lit(1 << 32) + part).alias("block")), "top-k-dealt")
    index = written(dealt.groupBy("dim", "block").applyInArrow(_index_row(scale), INDEX), "top-k-index")
    queries = dealt.where(F.col("vec_id") % modulus == 0).withColumn("query", F.xxhash64("vec_id", "embedding"))
    queries = queries.groupBy("dim", "query").agg(
        F.first("vec_id").alias("query_id"), F.first("embedding").alias("embedding"), F.min("block").alias("home")
    )
    queries = written(queries, "top-k-queries")
    at_home = queries.select("dim", F.col("home").alias("block"), "query", "query_id", F.lit(None).cast("long").alias("sure"), "embedding")
    first = written(_read(index, at_home, k, scale, block_queries), "top-k-home")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    sure = first.withColumn("rank", rank).where(F.col("rank") == k).select("query", F.col("score").alias("sure"))
    known = written(queries.join(sure, "query", "left"), "top-k-known")
    asked = _promising(known, index, scale)
    others = written(known.join(asked, ["dim", "query"]).select("dim", "block", "query", "query_id", "sure", "embedding"), "top-k-asked")
    every = first.unionByName(_read(index, others, k, scale, block_queries))
    ranked = every.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
