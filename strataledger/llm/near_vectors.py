"""Near duplicates among vectors by product quantisation.

1. Rows of equal vectors become one class, so copies are counted and never compared.
2. A coarse quantiser and codebooks for residuals are learned from a bounded sample of classes. Every class is indexed:
   the list of its nearest centre, one code for each subspace of its residual, and the error that the codes leave.
3. A class is looked up in the lists of its own and later centres that a near vector may be filed under: by the
   distance to the plane between two centres.
4. Lists are cut into blocks, and those who ask into turns, so that a task's size has a bound whatever a list holds. A
   task looks distances up in tables, one for each query and subspace; by the triangle inequality, the stored error
   makes that test safe. What is left is compared exactly, in double precision.
5. A task returns counts, and one edge for each class that it has connected; components follow from these.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataledger.llm.jaccard_join import components
from strataledger.llm.storage import partitions_for, shuffle_partitions, written

#: Members and queries of one task; queries that are looked up at once; pairs that are compared exactly at once.
BLOCK, TURN, TOGETHER, PAIRS = 8192, 8192, 128, 1 << 16
#: Room for the rounding of distances in single precision.
SLACK = 1e-4


def unit_rows(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of length 1 in double precision, filled up with zeros to ``dim``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths(), np.int64)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim) < sizes[:, None]] = np.asarray(lists.flatten(), np.float64)
    if len(out):
        out /= np.abs(out).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
        out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * (x @ centres.T), 0)


def cluster(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of up to ``k`` clusters by Lloyd's rounds from rows drawn at random; empty ones keep their place."""
    distinct = np.unique(x, axis=0)
    centres = np.random.default_rng(seed).permutation(distinct)[:k].copy()
    for _ in range(rounds if len(distinct) > k else 0):
        nearest = np.concatenate([_distances(part, centres).argmin(axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])
        sizes = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


@dataclass(frozen=True)
class Quantiser:
    """``centres``: one row a list; ``books``: one codebook for each of the subspaces that ``cuts`` bound."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @staticmethod
    def learned(sample: np.ndarray, lists: int, subspaces: int, codes: int) -> Quantiser:
        centres = cluster(sample, lists)
        residuals = sample - centres[_distances(sample, centres).argmin(axis=1)]
        cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int).tolist()
        books = [cluster(np.ascontiguousarray(residuals[:, a:b]), codes) for a, b in zip(cuts, cuts[1:])]
        return Quantiser(centres, books, cuts)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Squared distances to the centres, list, codes, and the length of what the codes leave of the residual."""
        far = _distances(x, self.centres)
        own = far.argmin(axis=1)
        residual = x - self.centres[own]
        codes = np.stack([_distances(p, b).argmin(axis=1) for p, b in zip(self.parts(residual), self.books)], axis=1)
        known = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return far, own, codes.astype(np.uint8), np.sqrt(((residual - known) ** 2).sum(axis=1))

    def probes(self, far: np.ndarray, own: np.ndarray, margin: float, gaps: np.ndarray) -> np.ndarray:
        """Whether a vector within ``margin`` across the plane to a list's centre may be filed there; ``gaps``: distances
        of centres. Of two lists, the earlier one's members ask."""
        beyond = far - far[np.arange(len(far)), own][:, None]
        reach = beyond <= 2 * margin * gaps[own] + SLACK
        return reach & (np.arange(far.shape[1]) >= own[:, None])

    def tables(self, queries: np.ndarray, centre: int) -> list[np.ndarray]:
        """For each subspace, squared distances of the queries' residuals to all its codewords."""
        residual = queries - self.centres[centre]
        return [_distances(p, b).astype(np.float32) for p, b in zip(self.parts(residual), self.books)]


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least known neighbour of each node) after links between ``a`` and ``b``."""
    while True:
        low = np.minimum(label[a], label[b])
        if np.array_equal(low, label[a]) and np.array_equal(low, label[b]):
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def _compare(model, dim: int, threshold: float):
    """Counts and edges of one block and those who ask it in one turn."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        order = np.lexsort((table["node"].to_numpy(), asks))
        table = table.take(pa.array(order))
        n_members = int((~asks).sum())
        if n_members in (0, len(asks)):
            return arrow.empty_table()
        node, copies, home, block = (table[c].to_numpy() for c in ("node", "copies", "home", "block"))
        width = np.asarray(table["vector"].combine_chunks().value_lengths())
        units = unit_rows(table["vector"], dim)
        codes = np.frombuffer(b"".join(table["codes"].slice(0, n_members).to_pylist()), np.uint8).reshape(n_members, -1)
        error, list_no, block_no = table["error"].to_numpy()[:n_members], int(table["list"][0].as_py()), int(block[0])
        limit = ((reach + error) * (1 + SLACK) + SLACK).astype(np.float32) ** 2
        quantiser = model.value
        # a class may stand both as a member and as one that asks
        nodes, at = np.unique(node, return_inverse=True)
        label, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for start in range(n_members, len(node), TOGETHER):
            asked = np.arange(start, min(start + TOGETHER, len(node)))
            found = np.zeros((len(asked), n_members), np.float32)
            for m, row in enumerate(quantiser.tables(units[asked], list_no)):
                found += row[:, codes[:, m]]
            near = found <= limit
            # inside a block, of two classes the earlier one asks
            same = (home[asked] == list_no) & (block[asked] == block_no)
            near &= ~same[:, None] | (node[asked][:, None] < node[:n_members])
            near &= width[asked][:, None] == width[:n_members]
            q, c = np.nonzero(near)
            for k in range(0, len(q), PAIRS):
                a, b = asked[q[k : k + PAIRS]], c[k : k + PAIRS]
                linked = np.einsum("ij,ij->i", units[a], units[b]) >= threshold
                a, b = a[linked], b[linked]
                if len(a):
                    np.add.at(links, at[a], copies[b])
                    np.add.at(links, at[b], copies[a])
                    label = _join_labels(label, at[a], at[b])
        edge, counted = np.flatnonzero(label != np.arange(len(nodes))), np.flatnonzero(links)
        none = lambda k: pa.nulls(k, pa.int64())
        edges = pa.table([nodes[edge], nodes[label[edge]], none(len(edge))], schema=arrow)
        return pa.concat_tables([edges, pa.table([nodes[counted], none(len(counted)), links[counted]], schema=arrow)])

    return run


def _index_row(model, dim: int, margin: float):
    """Lists, codes, errors and probes of classes."""

    def run(batches):
        quantiser = model.value
        gaps = np.sqrt(_distances(quantiser.centres, quantiser.centres))
        for batch in batches:
            names = batch.schema.names
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                far, own, codes, error = quantiser.encode(unit_rows(part.column(names.index("vector")), dim))
                row, probe = np.nonzero(quantiser.probes(far, own, margin, gaps))
                offsets = np.searchsorted(row, np.arange(part.num_rows + 1))
                probes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(probe, pa.int32()))
                coded = [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes]
                yield pa.RecordBatch.from_arrays([*part.columns, *coded], names=[*names, "home", "codes", "error", "probes"])

    return run


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, vec_id, vector`` (null where a vector takes no part), and classes ``vector, node, copies, first_id``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    sound = F.coalesce(finite & some, F.lit(False))
    rows = vectors.select("vec_id", F.when(sound, F.col("embedding")).alias("vector"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vector-rows")
    of_class = [F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id")]
    classes = rows.where("vector is not null").groupBy("vector").agg(*of_class)
    return rows, written(classes, "vector-classes")


def _answers(classes: DataFrame, threshold: float, sample_rows: int, lists: int | None, subspaces: int, codes: int, sigmas: float) -> DataFrame:
    """``a, b, links`` as tasks give them: edges, and counts of linked rows."""
    spark = classes.sparkSession
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if n < 2:
        return spark.createDataFrame([], "a long, b long, links long")
    sample = classes.select("vector").orderBy(F.xxhash64("vector"), "node").limit(sample_rows).toArrow()["vector"]
    lists = lists or min(sample_rows // 4, math.isqrt(n - 1) + 1)
    model = spark.sparkContext.broadcast(Quantiser.learned(unit_rows(sample, dim), max(1, lists), subspaces, codes))
    margin = math.sqrt(max(0.0, 2 - 2 * threshold)) * min(1.0, sigmas / math.sqrt(dim))
    element = classes.schema["vector"]
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), element])
    added = [("home", T.IntegerType()), ("codes", T.BinaryType()), ("error", T.DoubleType()), ("probes", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*schema.fields, *(T.StructField(*f) for f in added)])
    dealt = classes.select("node", "copies", "vector").repartition(partitions_for(classes, 4 << 20), "node")
    index = written(dealt.mapInArrow(_index_row(model, dim, margin), schema), "vector-index")

    # one row for each list: at most a quarter of the sample
    members = index.groupBy(F.col("home").alias("list")).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asking = index.select(F.explode("probes").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / TURN).alias("turns"))
    sizes = F.broadcast(written(members.join(asking, "list"), "vector-lists"))
    own = sizes.select(F.col("list").alias("home"), F.col("blocks").alias("parts"))
    filed = index.join(F.broadcast(own), "home").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    long = lambda x: F.lit(x).cast("long")
    held = (
        filed.withColumn("list", F.col("home")).join(sizes, "list")
        .withColumn("turn", F.explode(F.sequence(long(0), F.col("turns") - 1)))
        .withColumns({"target": F.col("block"), "asks": F.lit(False)})
    )
    asked = (
        filed.withColumn("list", F.explode("probes")).join(sizes, "list")
        .withColumn("turn", F.pmod(F.xxhash64("node", "list"), F.col("turns")))
        .withColumn("first", F.when(F.col("list") == F.col("home"), F.col("block")).otherwise(long(0)))
        .withColumn("target", F.explode(F.sequence("first", F.col("blocks") - 1)))
        .withColumns({"asks": F.lit(True), "codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("double")})
    )
    names = ["list", "target", "turn", "asks", "node", "copies", "home", "block", "vector", "codes", "error"]
    tasks = held.select(*names).unionByName(asked.select(*names)).repartition(shuffle_partitions(spark), "list", "target", "turn")
    compared = tasks.groupBy("list", "target", "turn").applyInArrow(_compare(model, dim, threshold), "a long, b long, links long")
    out = written(compared, "vector-links")
    model.destroy()
    return out


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, sample_rows: int = 8192, lists: int | None = None,
    subspaces: int = 8, codes: int = 256, sigmas: float = 4.0,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``).

    Two rows link if the cosine of their vectors, in double precision, is at least ``threshold`` and their lengths are
    equal. A vector that is null, empty, all zero, or holds a null or a component that is not finite links with nothing.
    Rows that repeat a vector link with each other, whatever their ids. ``component_id`` is the least id that links
    reach, null if there is none; ``kept`` says whether it is the row's own. Other columns are not read; an empty table
    gives no rows.

    No link below the threshold is returned. ``sample_rows`` bounds the sample that quantiser and codebooks (at most 256
    codes) are learned from; every row is indexed and compared. A pair can be missed only if its difference, across the
    plane between the centres of two lists, is more than ``sigmas`` times what a difference in random direction comes to;
    at the default that is some 3 in 100,000 for each plane. With ``sigmas`` of the root of the dimension or more, every
    link is found, by proof.
    """
    rows, classes = _classes(vectors)
    answers = _answers(classes, threshold, sample_rows, lists, subspaces, codes, sigmas)
    found = components(answers.where("b is not null").select("a", "b"))
    links = answers.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labelled = classes.drop("vector").join(found, "node", "left").join(links, "node", "left")
    labelled = labelled.withColumns({"root": F.coalesce("root", "node"), "n_links": F.col("copies") - 1 + F.coalesce("links", F.lit(0))})
    least = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labelled = written(labelled.join(least, "root").select("node", "n_links", "component_id"), "vector-labels")
    labelled = classes.select("vector", "node").join(labelled, "node").select("vector", "n_links", "component_id")
    linked = rows.where("vector is not null").join(labelled, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
