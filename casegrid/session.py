"""Session settings and shared working folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the jobs rely on. AQE coalesces small shuffle partitions, splits skewed join
# partitions and turns a join into a broadcast only after the side's size has been measured.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}

# Settings a session can only be started with. Recording the Python call site of every column
# expression costs more than building the expression.
START_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

# Bounds of the files that a step of intermediate rows writes.
FILES_PER_CORE, PARTITIONS_PER_FILE = 2, 8


def build_session(app_name: str = "casegrid", **extra: str) -> SparkSession:
    """Session for ``spark-submit``: the master and the sizing come from the submit command."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | str = 8, memory: str = "8g", app_name: str = "casegrid-local") -> SparkSession:
    """Single-machine session for tests, checks and the benchmark."""
    local = {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return build_session(app_name, **local)


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the settings on a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="casegrid-")
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/casegrid-{name}-{uuid.uuid4().hex}"


def in_few_files(df):
    """The rows in as many partitions as a step's scratch files may be: two a core, or one for 8 shuffle partitions.

    Partitions may be many and small, and every file has a price: on a local file system Hadoop starts
    ``chmod`` for it and for its checksums, and until that runs, the new process counts with all of the JVM's memory.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, partitions // PARTITIONS_PER_FILE))


def cut_lineage(df, few: bool = False):
    """Write the rows to the checkpoint folder and continue from there.

    ``few`` bounds the files; leave it out where partitions have a meaning.

    Reliable storage, so a lost executor costs a re-read rather than a recomputation, and rows that
    depend on a sampled range partitioning are fixed once.
    """
    shared_folder(df.sparkSession)
    return (in_few_files(df) if few else df).checkpoint(eager=True)
