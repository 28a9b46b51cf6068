"""Rows written once, for steps that are costly or must not change between uses."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The checkpoint folder all executors share: the one the session names in ``spark.checkpoint.dir``.

    Only a session on one machine, as in tests, may name none; it gets a folder
    of its own, removed when the process ends.  A cluster without a shared folder
    is an error, as each executor would write to its own disk.
    """
    sc = spark.sparkContext
    if at := sc.getCheckpointDir():
        return at
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        import atexit
        import shutil
        import tempfile

        folder = tempfile.mkdtemp(prefix="quarryline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder.

    Cuts lineage and keeps a costly step from running once for each use.  With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the files
    once nothing uses them any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
