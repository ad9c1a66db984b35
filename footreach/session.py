"""Session helpers: a tuned session for local use, and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_passing: ContextVar[str | None] = ContextVar("_passing", default=None)


def local_session(cpus: int | str = "*", app: str = "footreach") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FOOTREACH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; make a local one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of their own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: iterative operators need it")
        configured = tempfile.mkdtemp(prefix="footreach-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def _own_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/footreach-{spark.sparkContext.applicationId}"


def release_tables(spark: SparkSession) -> None:
    """Delete the tables that this application's lineage cuts have written; for when no result of theirs is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that lineage cuts of this thread write inside are deleted at the end: for work whose result is written elsewhere by then."""
    folder = f"{_own_folder(spark)}/passing-{uuid.uuid4().hex}"
    token = _passing.set(folder)
    try:
        yield
    finally:
        _passing.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    A lost executor then costs a re-read, plans stay short in loops, and the next join knows the real size.
    """
    spark = df.sparkSession
    path = f"{_passing.get() or _own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short fixed table as literals in the plan, so that its size is known to Spark."""
    cols = [c.strip().split(" ", 1) for c in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, cols)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
