"""SparkSession construction and the checkpoint folder.

The settings here are the ones the plans rely on:

* AQE on, with partition coalescing and skew-join splitting, so a key that holds a third of
  a table is split at run time instead of landing in one task.
* ``spark.sql.sources.partitionOverwriteMode=dynamic`` so a snapshot rerun replaces only the
  partitions it writes (the default, STATIC, would wipe the history).
* Session time zone UTC; all event times are interpreted in UTC and converted explicitly.
* The UI stays off (no listening web server).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # no stack trace kept for every column expression: it takes longer than building the plan
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


GB = 1024 ** 3
MB = 1024 ** 2


def recommended_conf(input_bytes: int, total_cores: int) -> dict:
    """Shuffle and scan sizing from the size of the inputs (compressed Parquet bytes) and the
    cluster's cores.

    * ``spark.sql.shuffle.partitions``: about one reducer per 2 GB of input, at least two per
      core, at most 50 000 -- so a reducer handles a few GB with spilling instead of one huge
      partition, and the map side does not write millions of shuffle blocks.  AQE then
      coalesces small partitions (``advisoryPartitionSizeInBytes`` = 256 MB) and splits skewed
      ones.
    * ``spark.sql.files.maxPartitionBytes``: 256 MB scan splits above 1 TB of input (fewer,
      fuller scan tasks), the 128 MB default below.
    For 100 TB on 8 000 cores this gives 50 000 shuffle partitions and 256 MB scan splits; at
    the test scale (sf0.1, 8 cores) it gives 16 partitions.
    """
    parts = max(2 * total_cores, min(50_000, -(-int(input_bytes) // (2 * GB))))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * MB),
        "spark.sql.files.maxPartitionBytes": str(256 * MB if input_bytes > 1024 * GB else 128 * MB),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * MB),
    }


def build_session(master: str | None = None, app_name: str = "solera",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    ``master`` defaults to ``local[N]`` with ``N`` from ``$BENCH_CPUS`` or the machine's cores;
    on a cluster pass ``master=None`` through spark-submit and the launcher's value wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and not os.environ.get("SPARK_MASTER") and "PYSPARK_SUBMIT_ARGS" not in os.environ:
        master = f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this must be a shared folder set by whoever launches the job; we only read it.
    Only when it is unset *and* the session runs in local mode (tests, the bench) do we create
    a scratch folder of our own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="solera-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint (written to the shared checkpoint folder, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df, name: str):
    """Write ``df`` once as a Parquet table under ``<checkpoint dir>/tables/`` and read it back.

    Used where several jobs (or several branches of one plan) need the same expensive
    intermediate -- e.g. the fact built from three joins that all fifteen quality checks read.
    The written table cuts the lineage (an executor loss re-reads files instead of recomputing
    the joins) and, unlike an RDD checkpoint, stays columnar so each reader prunes columns.
    """
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
