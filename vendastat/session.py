"""Session defaults and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even if the next step then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_session(app: str, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library was tuned with; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**DEFAULTS, **(conf or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def cluster_conf(input_bytes: int, target: int = 256 * 1024**2) -> dict[str, str]:
    """Settings that keep partitions near ``target`` bytes for input of the given size.

    The views shuffle far less than they read, so a shuffle gets one partition per sixteen
    of the input, and no more than map outputs can be tracked for. Small ones are merged at
    run time.
    """
    partitions = str(min(20_000, max(200, -(-input_bytes // (16 * target)))))
    return {
        "spark.sql.files.maxPartitionBytes": str(target),
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": partitions,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target // 2),
    }


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such a folder
    would live on one machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vendastat-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def scan_bytes(df: DataFrame) -> int:
    """Total size of everything ``df`` reads, by Catalyst's statistics of its leaf scans.

    An upper bound for results of filters, projections and lookups by unique key. In-memory
    tables of unknown size count as unbounded.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    total = 0
    while leaves.hasNext():
        total += int(str(leaves.next().stats().sizeInBytes()))
    return total


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and unlike a cached
    DataFrame keeps column pruning for the passes that follow.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/vendastat/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
