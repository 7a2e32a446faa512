"""Intermediate tables in the folder that every executor shares.

A table written here is read back as Parquet: its lineage ends at the files,
so a lost executor costs only the tasks that read them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str], list[str]] = {}
_group = ""


def root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if "local" not in spark.sparkContext.master or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{root(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    key = (spark.sparkContext.applicationId, _group)
    if key not in _made:
        _made[key] = []
        atexit.register(release, spark, _group)
    _made[key].append(path)
    return path


def table(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, longer by underscores until none of ``columns`` has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, group: str = "") -> None:
    """Delete the tables that a group made so far in this application.

    Only for callers whose earlier results are all written elsewhere.
    """
    if spark.sparkContext._jsc is None:
        return
    paths = _made.get((spark.sparkContext.applicationId, group), [])
    while paths:
        try:
            delete(spark, paths.pop().rpartition("/")[0])
        except Exception:  # the session is going down; files of a stopped application are swept with its folder
            return


@contextlib.contextmanager
def step(spark: SparkSession, group: str) -> Iterator[None]:
    """A step of a chain whose results are written before the next step begins: what earlier steps left goes first."""
    global _group
    release(spark, group)
    before, _group = _group, group
    try:
        yield
    finally:
        _group = before
