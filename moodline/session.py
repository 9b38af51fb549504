"""Session construction and the shared scratch location.

Jobs never invent a machine-local folder on a cluster: intermediate tables,
checkpoints, model versions and stream sinks all live under the directory the
cluster names in ``spark.checkpoint.dir``. Only a local-mode session without
that setting (tests, laptops) gets a fresh temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Defaults sized for the local[8] test box; on a cluster they are overridden by
# the submit configuration (shuffle partitions ~ 2-3x total cores, AQE on so
# that partitions are coalesced / split at run time).
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def build_session(master: str | None = None, app: str = "moodline",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The value configured by the cluster wins. Only when nothing is configured
    and the session runs in local mode is a fresh temporary folder used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    local = sc.master.startswith("local[") or sc.master == "local"
    if not configured:
        if not local:
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a shared folder for "
                "checkpoints and intermediate tables")
        configured = tempfile.mkdtemp(prefix="moodline-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/moodline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder for a written table of this application."""
    return f"{scratch_root(spark)}/{kind}/{uuid.uuid4().hex}"


def shared_path(spark: SparkSession, kind: str) -> str:
    """A folder that later applications find again (models, stream jobs)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/moodline/{kind}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of ``path`` in the session's Hadoop configuration."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def clean_up(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; DataFrames that were
    returned and not yet written must not be used afterwards. Models and named
    stream jobs stay."""
    fs, path = hadoop_path(spark, scratch_root(spark))
    fs.delete(path, True)
