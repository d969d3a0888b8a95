"""Written tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, else the one that ``setCheckpointDir`` set; a local one only where
    neither is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = chosen.get() if chosen.isDefined() else None
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="strataledger-")
    return _own_dirs[app]


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path, if the session can still do so; else the folder belongs to the cluster's cleaner."""
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _hadoop_path(spark: SparkSession, path: str):
    """A path, and the file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Names in a folder, with the time of their last change in milliseconds; nothing for a folder that isn't there."""
    target, files = _hadoop_path(spark, folder)
    if not files.exists(target):
        return []
    return [(f.getPath().getName(), f.getModificationTime()) for f in files.listStatus(target)]


def empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files of no bytes in a folder."""
    target, files = _hadoop_path(spark, folder)
    return [f.getPath().toString() for f in files.listStatus(target) if f.isFile() and f.getLen() == 0]


def bytes_below(spark: SparkSession, path: str) -> int:
    target, files = _hadoop_path(spark, path)
    return files.getContentSummary(target).getLength()


def read_text(spark: SparkSession, path: str) -> str:
    target, files = _hadoop_path(spark, path)
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file whole, or not at all if there is one already: of several writers just one succeeds.

    The text is written under a name of its own, and then linked (on a local disk) or renamed without leave to replace,
    which is one step on HDFS and on stores that rename in one step.
    """
    jvm = spark.sparkContext._jvm
    folder, name = path.rsplit("/", 1)
    own, files = _hadoop_path(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    target, _ = _hadoop_path(spark, path)
    out = files.create(own, False)
    out.write(text.encode())
    out.close()
    try:
        if files.getUri().getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0))
            jvm.java.nio.file.Files.createLink(place(target), place(own))
        else:
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(own, target, options)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        remove(spark, str(own))
    return True


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: lineage is cut, and lost executors lose nothing of it."""
    return written_at(df, label)[0]


def written_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path, for ``remove`` once nothing reads it any more."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: A table of up to so many bytes for each core is dealt out anew before work that takes much longer than moving it.
SMALL = 4 << 20


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over all cores, if it is small: a file of one row group is one task, however many cores there are.

    A table beyond that size has row groups enough, and stays as it is read. Rows and results are the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *by) if size <= cores * SMALL else df
