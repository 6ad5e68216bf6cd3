"""Session helpers: local session for tests and bench, and the lineage cut for loops."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_HELD: list[DataFrame] = []


def local_session(app: str = "surgelens", cpus: str | None = None, memory: str = "12g") -> SparkSession:
    """A local session for tests and bench. A cluster brings its own session."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="surgelens-ckpt-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``. Only a session of one machine may do without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="surgelens-ckpt-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for a written table."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps iterative plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hold(df: DataFrame) -> DataFrame:
    """Keep a table that several branches of one plan read (memory, then disk). Lost blocks
    are recomputed. ``release`` frees what earlier queries held."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _HELD.append(kept)
    return kept


def release() -> None:
    while _HELD:
        _HELD.pop().unpersist()
