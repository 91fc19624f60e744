"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Settings every deployment wants; parallelism itself is left to the cluster.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Long texts cross to Python in batches of moderate size.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Checkpoint files go when their table is no longer used.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | None = None, app: str = "annalist", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in {**DEFAULT_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster the
    folder has to outlive any executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(configured)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_cutter(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table below the shared checkpoint folder and reads it back.

    For loops: a plan read from files stays as short in the last round as in the first, while one cut by a checkpoint
    carries what the optimizer knows of it from round to round. Files stay until the folder is cleared.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
    written = iter(range(1 << 62))

    def cut(df: DataFrame) -> DataFrame:
        place = f"{folder}/{next(written)}"
        df.write.parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    return cut
