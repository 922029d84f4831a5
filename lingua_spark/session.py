"""Session helpers: a local session for tests/bench and the shared checkpoint folder.

On a cluster the session comes from the caller; these helpers only fill in settings
that are unset, never override what the cluster provides.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    # text operators are CPU-bound per row: keep small shuffle outputs spread over the cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(64 * 1024),
}


def local_session(cores: int | str = "*", app: str = "lingua_spark", extra: dict | None = None) -> SparkSession:
    """Local session used by tests and bench.py (one JVM, `cores` task threads)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a scratch one only when none is configured.

    On a cluster `spark.checkpoint.dir` names a shared (distributed) folder and is used as
    is (Spark applies it to the context at start-up). Only when it is unset, as in tests, a
    local scratch folder is set on the context (core configs cannot be changed at runtime).
    A cluster without the setting is refused: a folder of one machine would lose data.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="lingua-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Child names of a folder on any Hadoop file system (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p)]


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote below the shared checkpoint folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_once(df: DataFrame, compression: str | None = None) -> DataFrame:
    """`df` written as Parquet in the shared checkpoint folder and read again: several readers then evaluate it
    once, and each reads only the columns it needs. `compression`: Parquet codec, the session's by default."""
    import uuid
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/lingua-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that a Python worker is given, where the session has Spark's own bound of 64 MB.
BATCH_BYTES = 4 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of texts, unless the session has a bound of its own."""
    if spark.conf.get(_BATCH_KEY).rstrip("b") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


#: Tables up to this size are read by as many tasks as they have splits.
SPREAD_BYTES = 128 * 1024


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Source-side parallelism guard for a freshly read table: a scan with fewer splits
    than the cluster's default parallelism (e.g. one file with one row group) is spread
    round-robin, so per-row text work does not run in a handful of tasks. Large tables
    already have many splits and pass through unchanged. `task_bytes`: bytes of files from which a task reads at
    most, for work that takes long per byte; a task's time then does not grow with the table."""
    try:
        n = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
        size = sum(f.getLen() for f in _file_statuses(df))
        n = max(n, -(-size // task_bytes)) if task_bytes else n
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the scan as is
        return df
    return df.repartition(n) if parts < n and size > SPREAD_BYTES else df


def _file_statuses(df: DataFrame) -> list:
    """File statuses of the files a freshly read table consists of."""
    sc = df.sparkSession.sparkContext
    out = []
    for f in df.inputFiles():
        p = sc._jvm.org.apache.hadoop.fs.Path(f)
        out.append(p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p))
    return out


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
