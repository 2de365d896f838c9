"""Session start-up and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# HotSpot does not compile methods above this size; beyond it Spark's own split
# projections are faster than one fused method (3 times on the attribution plans).
JIT_LIMIT = ("spark.sql.codegen.hugeMethodLimit", "8000")


def tune(spark: SparkSession) -> SparkSession:
    """Apply the JIT limit unless the session has chosen its own."""
    key, value = JIT_LIMIT
    if spark.conf.get(key, None) in (None, "65535"):
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "churnspark") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder: on a cluster that
    folder would be invisible to the other machines.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="churnspark-")
    return _LOCAL[application]


#: Folders of local applications without a setting; the setting itself cannot be changed in a running application.
_LOCAL: dict[str, str] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once and continue from the written table.

    Used before iterative work: the expensive upstream plan runs once, readers
    get column pruning, and a lost executor only costs a re-read.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def written(df: DataFrame, name: str) -> str:
    """Write df to a new folder among the shared ones and return it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def iterative_session(spark: SparkSession, partitions: int, blobs: bool = False) -> SparkSession:
    """A session of the same application for hundreds of equal small aggregates: nothing is left to re-plan at run time.

    blobs: rows hold blocks of megabytes, so few of them are read and handed to Python at a time.
    """
    session = tune(spark.newSession())
    if blobs:
        session.conf.set("spark.sql.parquet.columnarReaderBatchSize", "2")
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return session
