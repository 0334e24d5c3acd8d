"""Session construction and the few session-level helpers that operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "lodestrata", cpus: int | str = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark, with a checkpoint folder that goes at its end."""
    folder = tempfile.mkdtemp(prefix="lodestrata-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", folder)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder in use: the one that spark.checkpoint.dir names. Where it is unset, a local session gets a
    temporary folder; on a cluster, whose executors could not read that, the setting is asked for."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lodestrata-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a compressed table into the checkpoint folder and read from there; it goes when the JVM ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """df materialised, for a join: broadcast if it has at most `most_rows` rows, by a shuffle beyond."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give tasks for less than half of them; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once for a context, unless their PYTHONPATH already has it."""
    root, sc = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or any(p.startswith("lodestrata-") for p in map(os.path.basename, sc._python_includes)):
        return
    folder = Path(tempfile.mkdtemp(prefix="lodestrata-code-"))
    shutil.copytree(Path(__file__).resolve().parent, folder / "package" / "lodestrata", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(folder / "lodestrata-code"), "zip", folder / "package"))
