"""Reading of tables and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shipped(spark: SparkSession) -> None:
    """This package sent to the workers, once per context: they need not find it by themselves."""
    sc = spark.sparkContext
    if getattr(sc, "_hirelode_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else it was itself loaded from a shipped archive
        folder = tempfile.mkdtemp(prefix="hirelode-package-")
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "hirelode-package"), "zip", os.path.dirname(package), os.path.basename(package)))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc._hirelode_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of parts)."""
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for work that is dear by the row.

    A table of ordinary size has more splits than that and passes unchanged; only
    one that lies in fewer, less than a split a core, is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is dear by the row."""
    return spread(table(spark, sf_dir, name))


def version(df: DataFrame) -> tuple:
    """What tells one state of a table on files from another: its files with their sizes and times."""
    spark = df.sparkSession
    jvm, conf, out = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((name, status.getLen(), status.getModificationTime()))
    return (spark.sparkContext.applicationId, *out)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs on one machine (tests) a
    temporary folder is made and set, once per session; on a cluster that is an
    error, as no executor could read another's folder.
    """
    shipped(spark)
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hirelode-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later stages don't recompute it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read again.

    Like :func:`cut`, but columnar: columns that aren't needed aren't read, and
    repeated values take little room.  The folder is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", str(8 << 20)).parquet(path)
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the gateway is gone: nothing left to clean with
            pass

    atexit.register(remove)
    return spark.read.schema(df.schema).parquet(path)
