"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: Rows per Arrow batch: long texts cross to Python in moderate pieces.
BATCH_ROWS = 256

#: The folder that holds this package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of one Arrow batch, so that a batch of long texts stays small, and let Python workers
    find this package.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    make_known(spark)


def make_known(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies on their machine, too."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def words_of(text: str) -> list[bytes]:
    """Words of a text in UTF-8: runs of anything but blanks and the control characters 9 to 13, A-Z in lower case.

    The byte methods know ASCII only, which is what the definition asks for.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def finite_vector(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))
