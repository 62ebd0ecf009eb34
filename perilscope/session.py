"""Session helpers: a local session for tests and the bench, and the
checkpoint folder used to cut lineage.

On a cluster the checkpoint folder is the shared one the cluster names in
``spark.checkpoint.dir``; it is only set here when unset and the master is
local (tests, bench), never on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "perilscope", event_log: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, executor_cores: int = 4,
                 executor_memory_gb: int = 16, checkpoint_dir: str | None = None,
                 target_partition_mb: int = 256, shuffle_fraction: float = 0.25
                 ) -> dict[str, str]:
    """Settings for a cluster run sized to the input (e.g. 100 TB).

    * scan splits of ``target_partition_mb`` (parquet row groups permitting);
    * initial shuffle partitions = expected shuffle volume / target size. The
      largest shuffle (the line-item pre-aggregate) carries four pruned
      columns, about ``shuffle_fraction`` of the input, so each partition
      fits in one task's share of executor memory; AQE then coalesces small
      partitions and splits skewed ones;
    * broadcast threshold left at a fixed byte size (never proportional to the
      data), so only genuinely small sides are broadcast;
    * a shared checkpoint folder for :func:`stage` (required off local mode).
    """
    target = target_partition_mb * 1024 * 1024
    partitions = max(200, int(input_bytes * shuffle_fraction // target))
    per_task_mb = executor_memory_gb * 1024 // max(1, executor_cores)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.windowExec.buffer.spill.threshold": str(max(4096, per_task_mb * 64)),
    }
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    return conf


_SHIPPING = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors (once per application), so that
    functions of Python tasks can be imported there. Searches run in threads, so
    only one of them ships."""
    with _SHIPPING:
        _ship(spark.sparkContext)


def _ship(sc) -> None:
    if getattr(sc, "_perilscope_code", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="perilscope-"), "perilscope_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._perilscope_code = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    Reads ``spark.checkpoint.dir`` (or a folder already set on the context).
    Only when none is set and the master is local does it create one under
    the system temp folder; on a cluster an unset folder is an error, because
    a machine-local folder does not survive the loss of an executor. The
    result is always the sub-folder that Spark itself uses, so stages of one
    application share one root.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; set it to a shared folder")
        path = tempfile.mkdtemp(prefix="perilscope-ckpt-",
                                dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/perilscope-stages/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Used where one intermediate feeds several branches of a plan (it is
    computed once instead of once per branch) and where a value computed
    from partition layout must be the same for every later use. The files
    sit in the shared checkpoint folder, so the loss of an executor after
    the write loses nothing.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    # The schema is the one just written: no footer reads to infer it.
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete this library's staged tables under the checkpoint folder.

    Staged tables back lazy DataFrames, so call this only when no DataFrame
    built in the session is used again (end of a job or a bench run).
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    for sub in ("perilscope-stages", "perilscope-io"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{sub}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            fs.delete(path, True)
