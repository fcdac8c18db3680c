"""Small helpers every operator uses: null-safe key joins and the shared scratch folder."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: tables proven to hold at most this many rows / values are broadcast; larger ones are joined
BROADCAST_ROWS = 200_000
BROADCAST_CELLS = 1_000_000


def key_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating null keys as equal; the right key columns are dropped."""
    keys = list(keys)
    if not keys:  # one row on the right, or none: an outer join must keep the left rows
        return left.join(F.broadcast(right), F.lit(True), how)
    names = {k: f"__r_{i}" for i, k in enumerate(keys)}
    right = right.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[names[k]])
        cond = c if cond is None else cond & c
    return left.join(right, cond, how).drop(*names.values())


def as_micros(df: DataFrame) -> DataFrame:
    """Time stamps with a zone as microseconds.  Arrow functions hand them on in the session's zone while a
    result is expected in UTC, so tables go through them in this form."""
    return df.withColumns({f.name: F.unix_micros(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)})


def from_micros(df: DataFrame, like: DataFrame) -> DataFrame:
    """Back to the time stamps of ``like``."""
    return df.withColumns({f.name: F.timestamp_micros(F.col(f.name)) for f in like.schema.fields if isinstance(f.dataType, T.TimestampType)})


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a fresh temporary
    folder only where that is unset and the session runs on this machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(scratch_dir, "_local", None)
        if path is None:
            path = scratch_dir._local = tempfile.mkdtemp(prefix="chronopanel-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"{path.rstrip('/')}/chronopanel-{spark.sparkContext.applicationId}"


#: called when staged files are deleted
on_release: list[Callable[[], None]] = []


def release(spark: SparkSession) -> None:
    """Delete everything this application has staged; call it when its results are written. Panels that
    the session still holds by name are forgotten too, so that they are built anew when asked for."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    for forget in on_release:
        forget()


def send(spark: SparkSession, value) -> Callable:
    """Broadcast an object of this package's classes; tasks call the result to get it. It travels by value
    like the functions do, so workers need no copy of the package."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def stage_all(parts: list[DataFrame], name: str = "stage", at_once: int = 4) -> list[DataFrame]:
    """Stage independent small results, a few jobs at a time."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(lambda d: stage(d, name), parts))


def stage_union(parts: list[DataFrame], name: str = "stage", at_once: int = 4) -> DataFrame:
    """The rows of all ``parts``, each written by a job of its own.  Spark runs the branches of a union that are
    dealt alike in one task, where the sorts and hash tables of all of them add up."""
    return reduce(DataFrame.unionByName, stage_all(parts, name, at_once))


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, survives
    lost executors, and gives later joins an exact size to plan with.  ``by``: a folder for each
    value of this column, so that a filter on it reads its rows only."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
