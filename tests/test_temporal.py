"""Joins along an axis, digests as trees, quantile sketches and streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from strataledger.operators import digests as D
from strataledger.operators import ledger as L
from strataledger.operators import temporal as TM
from strataledger.sources.tables import Warehouse
from strataledger.streaming import state as ST


@pytest.mark.parametrize("ranges", [1, 7])
def test_asof_join_against_all_pairs(spark, ranges):
    rng = random.Random(ranges)
    left = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([*range(30), None])) for k in range(120)]
    right = [(k, rng.choice(["a", "a", "c", None]), rng.choice([*range(30), None]), f"v{k}") for k in range(60)]
    want = set()
    for k, key, t in left:
        known = [(rt, rk, v) for rk, rkey, rt, v in right if key is not None and rkey == key and t is not None and rt is not None and rt <= t]
        want.add((k, key, t, max(known)[2] if known else None))
    found = TM.asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "n int, k string, t int, v string"), ["k"], "t", ["v"], "n", ranges)
    assert found.columns == ["id", "k", "t", "last_v"] and set(map(tuple, found.collect())) == want
    empty = spark.createDataFrame([], "n int, k string, t int, v string")
    assert TM.asof_join(spark.createDataFrame(left, "id int, k string, t int"), empty, ["k"], "t", ["v"], "n", ranges).where("last_v is not null").count() == 0


@pytest.mark.parametrize("most", [1_000_000, 2])
def test_interval_join_against_all_pairs(spark, most):
    rng = random.Random(most)

    def intervals(n, name):
        out = []
        for k in range(n):
            start = rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 5)), None])
            size = rng.choice([0.0, rng.uniform(0, 2), rng.uniform(0, 400), 64.0, -1.0])
            out.append((f"{name}{k}", rng.choice(["x", "x", "y", None]), start, rng.choice([None, (start or 0.0) + size, (start or 0.0) + size])))
        return out

    a, b = intervals(60, "a"), intervals(60, "b")
    whole = lambda s, e: None if e is None or (s if s is not None else e) > e else (e if s is None else s, e)
    want = {(i, j) for i, k, s, e in a for j, m, t, f in b if k is not None and k == m and (p := whole(s, e)) and (q := whole(t, f)) and p[0] <= q[1] and q[0] <= p[1]}
    found = TM.interval_join(spark.createDataFrame(a, "i string, k string, s double, e double"), spark.createDataFrame(b, "j string, k string, t double, f double"), ["k"], ("s", "e"), ("t", "f"), 1.0, most)
    rows = [(r.i, r.j) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) > 30


def test_tree_digests_name_what_differs(spark):
    lines = spark.range(3000).select(F.concat(F.lit("row "), (F.col("id") % 2500).cast("string")).alias("line"))
    one = D.tree_digest(lines).first().digest
    assert D.tree_digest(lines.repartition(5)).first().digest == one and D.tree_digest(lines, digits=4).first().digest != one
    other = lines.where("line <> 'row 7'").union(spark.createDataFrame([("row 9",), ("new",), (None,)], "line string"))
    assert D.tree_digest(other).first().digest != one
    assert {tuple(r) for r in D.differences(lines, other).collect()} == {("row 7", 2, 0), ("row 9", 2, 3), ("new", 0, 1)}
    assert D.differing_leaves(D.leaf_digests(lines, digits=3), D.leaf_digests(other, digits=3)).count() == 3
    assert D.tree_digest(lines.limit(0)).first().digest == D.tree_digest(lines.limit(0)).first().digest != one


def test_sketches_merge_and_keep_their_bound(spark):
    rows = spark.range(40_000).select((F.col("id") % 8).alias("day"), F.lit("c").alias("code"), (F.col("id") * 7919 % 40_000).cast("double").alias("hours"))
    days = L.quantile_sketches(rows, ["code", "day"])
    found = L.merged_sketches(days, ["code"]).select("n", *(L.sketched_quantile("sketch", q).alias(f"q{k}") for k, q in enumerate((0.1, 0.5, 0.9)))).first()
    assert found.n == 40_000 and all(abs(found[f"q{k}"] / 40_000 - q) <= 0.01 for k, q in enumerate((0.1, 0.5, 0.9)))
    assert days.select(F.max(F.length("sketch"))).first()[0] < 20_000


LOSS = "id string, entity string, at timestamp, hours double"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def arrive(spark, folder, n, *rows):
    spark.createDataFrame([(i, e, at(m), h) for i, e, m, h in rows], LOSS).coalesce(1).write.json(f"{folder}/{n}", timestampFormat="yyyy-MM-dd HH:mm:ss")


def read(spark, folder):
    return spark.readStream.schema(LOSS).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def test_streams_count_each_loss_once_over_restarts(spark, tmp_path):
    folder, house = tmp_path / "in", Warehouse(spark, f"file://{tmp_path}/house")

    def run():
        first = ST.first_of_each(read(spark, folder), ["id"], "at", "30 minutes")
        ST.into_table(first, house, "losses", "id", f"file://{tmp_path}/marks").awaitTermination()
        return {r.id: r.hours for r in house.read("losses").collect()}

    arrive(spark, folder, 1, ("a", "w", 0, 1.0), ("b", "w", 5, 2.0), ("a", "w", 6, 9.0))
    assert run() == {"a": 1.0, "b": 2.0}
    arrive(spark, folder, 2, ("a", "w", 8, 8.0), ("c", "w", 100, 3.0))  # a again, after a restart
    assert run() == {"a": 1.0, "b": 2.0, "c": 3.0}
    arrive(spark, folder, 3, ("late", "w", 1, 7.0), ("d", "w", 90, 4.0))  # one behind the watermark, one in time
    assert run() == {"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0} == run()


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, monkeypatch):
    folder, house = tmp_path / "in", Warehouse(spark, f"file://{tmp_path}/house")
    arrive(spark, folder, 1, ("a", "w", 0, 1.0), ("b", "v", 5, 2.0))
    real = Warehouse.merge

    def stop(self, *args):
        real(self, *args)
        raise RuntimeError("stopped after the commit")

    run = lambda: ST.into_table(ST.first_of_each(read(spark, folder), ["id"], "at", "1 hour"), house, "losses", "id", f"file://{tmp_path}/marks").awaitTermination()
    with monkeypatch.context() as patch:
        patch.setattr(Warehouse, "merge", stop)
        with pytest.raises(Exception, match="stopped after the commit"):
            run()
    run()
    assert sorted(r.id for r in house.read("losses").collect()) == ["a", "b"]


def test_sessions_with_late_rows(spark, tmp_path):
    folder, house = tmp_path / "in", Warehouse(spark, f"file://{tmp_path}/house")

    def run():
        rows = ST.sessions(read(spark, folder), ["entity"], "at", "10 minutes", "20 minutes")
        keyed = rows.withColumn("id", F.concat_ws("|", "entity", F.col("begun").cast("string")))
        ST.into_table(keyed, house, "sessions", "id", f"file://{tmp_path}/marks").awaitTermination()
        return {(r.entity, r.begun, r.n, r.hours) for r in house.read("sessions", "entity string, begun timestamp, n long, hours double").collect()}

    arrive(spark, folder, 1, ("1", "w", 0, 1.0), ("2", "w", 15, 1.0), ("3", "v", 3, 5.0))
    run()
    arrive(spark, folder, 2, ("4", "w", 8, 1.0))  # late but in time: joins two runs
    run()
    arrive(spark, folder, 3, ("5", "w", 90, 1.0))
    run()
    arrive(spark, folder, 4, ("6", "w", 2, 9.0), ("7", "w", 200, 1.0))  # far behind: dropped
    assert run() >= {("w", at(0), 3, 3.0), ("v", at(3), 1, 5.0), ("w", at(90), 1, 1.0)} and not any(h == 9.0 for *_, h in run())
