"""Tables in files: Parquet first, and the other formats that Spark reads."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tessera.errors import EngineError

# Schemes and the Hadoop file system that serves each.
SCHEMES = {"": "", "file": "file", "s3": "s3a", "s3a": "s3a", "gs": "gs", "abfs": "abfs", "abfss": "abfss", "az": "abfs", "azure": "abfs", "adl": "adl", "hdfs": "hdfs", "viewfs": "viewfs"}


def resolve_uri(uri: str) -> str:
    """The same place under the scheme that Hadoop knows."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", uri)
    scheme = m[1].lower() if m else ""
    if scheme not in SCHEMES:
        raise EngineError(f"no file system for {uri!r}")
    return uri if not scheme else SCHEMES[scheme] + uri[len(scheme) :]


def scan(spark: SparkSession, uris: str | Sequence[str], schema: StructType | None = None, columns: Sequence[str] | None = None, where: Column | None = None, fmt: str = "parquet", recursive: bool = True, **options: str) -> DataFrame:
    """The rows of files or folders, pruned to ``columns`` and ``where`` at the scan.

    An empty list of places gives an empty table, for which ``schema`` is needed.
    """
    places = [uris] if isinstance(uris, str) else list(uris)
    if not places:
        if schema is None:
            raise EngineError("no files and no schema")
        df = spark.createDataFrame([], schema)
    else:
        reader = spark.read.format(fmt).options(**options)
        if recursive and fmt == "parquet":
            reader = reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true") if not any(p.endswith(".parquet") for p in places) else reader
        df = (reader.schema(schema) if schema is not None else reader).load([resolve_uri(p) for p in places])
    df = df if where is None else df.filter(where)
    return df if columns is None else df.select(*columns)


def list_files(spark: SparkSession, uri: str, suffix: str = ".parquet") -> list[str]:
    """Files under a place, recursively, in order; a file is itself. Names only, for planning."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(resolve_uri(uri))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isFile():
        return [str(path)]
    it, found = fs.listFiles(path, True), []
    while it.hasNext():
        name = it.next().getPath().toString()
        if name.endswith(suffix):
            found.append(name)
    return sorted(found)


#: the reader that answers COUNT, MIN and MAX from footers (where spark.sql.parquet.aggregatePushdown is on)
_BY_METADATA = "org.apache.spark.sql.execution.datasources.v2.parquet.ParquetDataSourceV2"


def by_metadata(spark: SparkSession, uri: str, schema: StructType | None = None) -> DataFrame:
    """A scan whose unconditional counts read footers only. A schema that is known saves a look at the files."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(_BY_METADATA).load(resolve_uri(uri))


def row_count(spark: SparkSession, uris: str | Sequence[str], where: Column | None = None) -> int:
    """Rows of Parquet files; without a condition from their footers."""
    if where is not None:
        return scan(spark, uris, where=where).count()
    return sum(by_metadata(spark, u).count() for u in ([uris] if isinstance(uris, str) else uris))


def adapt(df: DataFrame, target: StructType) -> DataFrame:
    """``df`` with the target's columns in its order and types: absent ones null, others dropped.

    A value that its new type cannot hold raises when it is read.
    """
    return df.select(*((F.col(f"`{f.name}`").cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in target))


def scan_evolving(spark: SparkSession, uris: Iterable[str], target: StructType) -> DataFrame:
    """Files of differing schemas as one table of the target's schema."""
    parts = [adapt(scan(spark, u), target) for u in uris]
    if not parts:
        return spark.createDataFrame([], target)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_sorted(df: DataFrame, uri: str, keys: Sequence[str], files: int, compression: str = "zstd") -> None:
    """Range-partitioned, sorted Parquet: row groups with tight bounds on the keys, which later scans skip by."""
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", compression).parquet(resolve_uri(uri))


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> None:
    """A catalog table bucketed on its join keys: joins and aggregations on them need no shuffle."""
    df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
