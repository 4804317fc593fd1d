"""Where intermediate tables go.

``spark.checkpoint.dir`` names a folder that the driver and every executor
share.  It is read from the session; only where it is unset and the master is
local (tests) does this module choose a folder of its own, and removes it at
the end.  On a cluster without the setting it raises an error.

What is written there stays until the caller removes it, as lost executors may
need it again; a cluster that sets spark.cleaner.referenceTracking.cleanCheckpoints
lets Spark delete checkpoints that nothing refers to.
"""

from __future__ import annotations

import atexit
import gc
import itertools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, set for checkpoint() as well."""
    jsc = spark.sparkContext._jsc.sc()
    known = spark.conf.get("spark.checkpoint.dir", None)
    current = jsc.getCheckpointDir()
    if not current.isEmpty():
        return known or current.get()
    if known is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if known is None:
        known = tempfile.mkdtemp(prefix="weft-checkpoint-")
        atexit.register(shutil.rmtree, known, True)
    spark.sparkContext.setCheckpointDir(known)
    return known


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: Checkpoints after which the driver's garbage is collected.
TIDY_EVERY = 8
_made = itertools.count(1)


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage: its heap stays small, and Spark deletes shuffle files that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows survive the loss of any executor.

    Columns get new identities, so the result joins with what it was made from.
    Loops make many, so each ``TIDY_EVERY``-th tidies up.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True).toDF(*df.columns)
    if next(_made) % TIDY_EVERY == 0:
        tidy(df.sparkSession)
    return out


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows (reads max_rows + 1 at most)."""
    return df.limit(max_rows + 1).count() <= max_rows
