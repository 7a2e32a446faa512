"""Sessions with the settings that the engine's plans rely on, and switches for single queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}


def session(master: str | None = None, app: str = "tessera", **extra: str) -> SparkSession:
    """A session with SETTINGS; ``extra`` names settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in extra.items()})
    return (builder.master(master) if master else builder).getOrCreate()


@dataclass(frozen=True)
class Switches:
    """What a query may be run with. Results never depend on them, only how they are come by.

    Memory is no switch: executors are given theirs when they start (``spark.executor.memory``), and spill beyond it.
    """

    #: off: no code generation, no replanning and no pushdown, to tell a fault of the engine's plans from one of a query
    acceleration: bool = True
    #: bytes of files that one task reads at most (none: as the session has it)
    split_bytes: int | None = None
    #: one task for every shuffle: for looking into a query, not for large inputs
    single_task: bool = False

    def settings(self) -> dict[str, str]:
        out = {} if self.split_bytes is None else {"spark.sql.files.maxPartitionBytes": str(self.split_bytes)}
        if self.single_task:
            out["spark.sql.shuffle.partitions"] = "1"
        if not self.acceleration:
            off = ("spark.sql.codegen.wholeStage", "spark.sql.adaptive.enabled", "spark.sql.parquet.filterPushdown", "spark.sql.parquet.aggregatePushdown")
            out |= dict.fromkeys(off, "false")
        return out


def switched(spark: SparkSession, switches: Switches) -> SparkSession:
    """A session with the switches set, over the same executors and files; the given one and its temporary views stay as they are."""
    own = spark.newSession()
    kept = {k: spark.conf.get(k) for k in (*SETTINGS, "spark.sql.shuffle.partitions")}
    for k, v in (kept | switches.settings()).items():
        own.conf.set(k, v)
    return own
