"""Session helpers shared by tests, the bench and the query catalogue."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "hireframe-code"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so tasks can import it wherever the
    driver found it."""
    sc = spark.sparkContext
    if any(os.path.basename(f).startswith(_SHIPPED) for f in sc._python_includes):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="hireframe-"), f"{_SHIPPED}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(top, "hireframe")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
    sc.addPyFile(path)


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "hireframe") -> SparkSession:
    """Session used by tests and the bench: AQE on, UI off, UTC."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HIREFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the cluster (a folder every executor
    can reach).  Only a local-mode session without the setting gets a fresh
    folder of its own, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it to a shared folder")
        conf_dir = tempfile.mkdtemp(prefix="hireframe-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared folder (for written tables and models)."""
    base = shared_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized for a cluster run of the text jobs.

    * shuffle partitions: about one per ``target_partition_bytes`` of input
      (token-level shuffles are about as large as the texts), at least
      three waves of the cluster's cores; AQE coalesces the small stages.
    * file splits: ``target_partition_bytes`` so a scan task holds a bounded
      amount of text.
    * skew: AQE skew-join splitting for hot employers and frequent tokens.
    ``spark.checkpoint.dir`` must name a shared folder and is set by the cluster.
    """
    cores = max(executors * cores_per_executor, 1)
    parts = max(3 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }
