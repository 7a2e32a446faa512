"""Figures of a query's run, one JSON line each."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from tessera.errors import classify


@dataclass(frozen=True)
class QueryStats:
    name: str
    rows: int
    seconds: float
    plan_bytes: int
    error: str | None = None
    #: who has to act on the error (see errors.ErrorClass)
    error_class: str | None = None
    bytes_read: int = 0
    shuffle_bytes: int = 0
    spilled_bytes: int = 0
    stages: int = 0
    tasks: int = 0
    #: executors that ran a task, by id
    executors: tuple[str, ...] = ()
    #: operators of the plan that run outside of generated code or in Python: where the engine's fast path is left
    fallback: tuple[str, ...] = ()

    def line(self) -> str:
        return json.dumps(asdict(self))


_SLOW = ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "BroadcastNestedLoopJoin", "CartesianProduct", "ObjectHashAggregate")


def _work(spark: SparkSession, tag: str) -> dict:
    """What the jobs of a tag did, by the status store. Figures are of the driver's own records: no job is run."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    store, figures, executors = sc.statusStore(), dict.fromkeys(("bytes_read", "shuffle_bytes", "spilled_bytes", "stages", "tasks"), 0), set()
    stages = set()
    for job in sc.statusTracker().getJobIdsForTag(tag):
        ids = store.job(job).stageIds()
        stages |= {ids.apply(i) for i in range(ids.size())}
    for k in stages:
        stage = store.lastStageAttempt(k)
        if str(stage.status()) == "SKIPPED":
            continue
        figures["stages"] += 1
        figures["tasks"] += stage.numCompleteTasks()
        figures["bytes_read"] += stage.inputBytes()
        figures["shuffle_bytes"] += stage.shuffleWriteBytes()
        figures["spilled_bytes"] += stage.diskBytesSpilled()
        by = store.executorSummary(k, stage.attemptId()).keysIterator()
        while by.hasNext():
            executors.add(by.next())
    return figures | {"executors": tuple(sorted(executors))}


def observed(name: str, df: DataFrame, action: Callable[[DataFrame], object], sink: Callable[[str], None] = print) -> object:
    """Run ``action`` on ``df`` and report what it took; an error is reported and raised."""
    spark, tag = df.sparkSession, f"tessera-{uuid.uuid4().hex}"
    watch = Observation(f"rows of {name}")
    seen = df.observe(watch, F.count(F.lit(1)).alias("rows"))
    plans = df._jdf.queryExecution()
    size, physical = len(plans.optimizedPlan().toString()), plans.executedPlan().toString()
    slow = tuple(x for x in _SLOW if x in physical)
    spark.sparkContext.addJobTag(tag)
    began = time.monotonic()
    try:
        out = action(seen)
    except Exception as x:
        sink(QueryStats(name, 0, time.monotonic() - began, size, type(x).__name__, classify(x).value, **_work(spark, tag), fallback=slow).line())
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)
    took = time.monotonic() - began
    sink(QueryStats(name, watch.get["rows"], took, size, **_work(spark, tag), fallback=slow).line())
    return out
