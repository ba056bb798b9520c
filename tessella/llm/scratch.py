"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []

#: Has shuffle files deleted when the execution that made them ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder of our own only where it is unset (tests on one machine)."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: a lost executor costs no recomputation, and what was shuffled for df needs no disk any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Deletes the tables written so far. Frames made from them can't be read afterwards."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended
            return


atexit.register(clear)
