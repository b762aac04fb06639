"""Session helpers: test sessions, checkpoints in the shared folder, spreading small inputs over the cores."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_BASES: set[str] = set()
_PATHS: dict[int, tuple] = {}
_WITHIN: list[list[DataFrame]] = []
_HOME = str(Path(__file__).resolve().parent.parent)


def find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; a cluster without that folder needs the
    package installed, or sent by SparkContext.addPyFile."""
    env = spark.sparkContext.environment
    if _HOME not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), _HOME]))


def local_session(name: str = "termloom", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TERMLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session's spark.checkpoint.dir; only a local session without one gets
    a folder of its own."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(found)
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(made := tempfile.mkdtemp(prefix="termloom-"))
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes the rows to a table in the shared folder, which outlives lost executors, and reads it.

    A table rather than checkpoint(): its size is known to the optimiser, while a checkpoint keeps the estimates of its
    plan, whose product over the rounds of a loop grows without bound.
    """
    spark = df.sparkSession
    base = f"{checkpoint_dir(spark)}/termloom-{spark.sparkContext.applicationId}"
    if base not in _BASES:
        _BASES.add(base)
        atexit.register(_remove, spark, base)
    path = f"{base}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    if _WITHIN:
        _WITHIN[-1].append(out)
    return out


def cut_from(build: Callable[[], DataFrame]) -> DataFrame:
    """cut() of what ``build`` gives; the tables that it wrote on the way are deleted afterwards."""
    _WITHIN.append(on_the_way := [])
    try:
        df = build()
    finally:
        _WITHIN.pop()
    out = cut(df)
    release(*on_the_way)
    return out


def release(*dfs: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing will read again."""
    for df in dfs:
        ref, path = _PATHS.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner clears it
        pass


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of an input of fewer splits than cores out in turn, so that Python stages use all cores whatever
    the rows' keys. Inputs of more splits keep their partitions: at scale nothing is shuffled here. Neither are inputs
    dealt out that a shuffle has just placed; to count their partitions would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString() or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores)
