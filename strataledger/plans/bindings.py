"""The ledger's roles over tables that supply them.

An *exposure* row is one report of one entity; a *loss* row is an exposure row with lost hours. Operators know only
the columns below, so another source needs another binding and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.sources.storage import written

#: Columns of a ledger, in order. ``hours`` is a decimal so that sums don't depend on their order.
LEDGER = ("report_id", "line", "tenant", "entity", "code", "section", "formation", "rig", "tool", "hours", "day", "depth")

#: Bytes of suppliers' keys in files, by Spark's estimate, up to which every executor gets suppliers with their places
#: whole: about two million suppliers, or 100 MB.
PLACES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports from the star schema: order lines of a supplier stand for daily reports of an entity."""
    places = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    places = places.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select("s_suppkey", "n_name", "r_name")
    keys = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    if int(str(keys._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= PLACES:
        places = F.broadcast(places)  # else Spark decides
    # order lines travel for their order and their part; names of places come last, so that they don't travel with them
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.select(
        F.col("l_orderkey").alias("report_id"),
        F.col("l_linenumber").alias("line"),
        F.col("r_name").alias("tenant"),
        F.col("s_suppkey").alias("entity"),
        F.col("p_type").alias("code"),
        F.concat(F.lit("S"), F.floor(F.col("p_size") / 10).cast("string")).alias("section"),
        F.col("o_orderpriority").alias("formation"),
        F.col("n_name").alias("rig"),
        F.col("p_brand").alias("tool"),
        F.col("l_quantity").cast("decimal(18,1)").alias("hours"),
        F.col("l_shipdate").cast("date").alias("day"),
        F.col("p_retailprice").alias("depth"),
        (F.col("l_returnflag") == "R").alias("is_loss"),
    )


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exposures(spark, sf_dir).where("is_loss").select(*LEDGER)


def ledger(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Some columns of exposures and losses from one written table, so that what reads both joins the tables once."""
    rows = written(exposures(spark, sf_dir).select(*columns, "is_loss"), "ledger")
    return rows.drop("is_loss"), rows.where("is_loss").drop("is_loss")


#: The same views as DuckDB reads them.
LEDGER_SQL = """
exposures as (
  select l_orderkey as report_id, l_linenumber as line, r_name as tenant, s_suppkey as entity, p_type as code,
    'S' || floor(p_size / 10)::bigint as section, o_orderpriority as formation, n_name as rig, p_brand as tool,
    l_quantity::decimal(18,1) as hours, l_shipdate::date as day, p_retailprice as depth, l_returnflag = 'R' as is_loss
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey
), losses as (select * exclude (is_loss) from exposures where is_loss)
"""
