"""Session settings and the two helpers that decide what may be kept small or written out."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its row count was checked against this bound.
BROADCAST_ROWS = 200_000


def build_session(app: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and ISO time zone; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.scheduler.mode": "FAIR",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only when the setting is absent and Spark itself runs on one machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
            folder = tempfile.mkdtemp(prefix="tabloom-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Input per core above which a table has enough partitions of its own.
_SPREAD_BYTES = 128 * 1024 * 1024


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Use all cores on a small input: repartition when Catalyst expects less than 128 MB per core.

    For steps that cost much per row (text, iterative fits), where a table of few row groups would otherwise
    leave most of the cluster idle. Larger inputs, and those of unknown size, are left as they are. Only the
    plan's size estimate is read, so nothing runs. ``by`` are the columns of a join that follows, so that it needs no second exchange.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if expected >= cores * _SPREAD_BYTES:
        return df
    return df.repartition(*by) if by else df.repartition(cores)


def spread_cached(df: DataFrame) -> DataFrame:
    """As ``spread``, for a persisted or checkpointed table, whose partitions are counted instead of estimated."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it has at most ``max_rows`` rows; otherwise leave the join to Catalyst."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def inline_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Evaluate ``df`` once into a broadcast local table if it has at most ``max_rows`` rows; otherwise leave it lazy."""
    rows = df.limit(max_rows + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows)) if rows.num_rows <= max_rows else df
