"""Session, table access and checkpoints: the few things that depend on where the code runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings of a session made here. A session that already exists keeps its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(app: str = "quotemill", master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with DEFAULTS, for tests, benchmarks and scripts."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root`; only the columns a plan uses are read."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets a temporary folder, deleted at exit."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quotemill-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    folder = configured
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def bounded_rows(df: DataFrame, most: int) -> list | None:
    """df's rows if there are at most `most` of them, else None. For small tables whose size must be proven."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def broadcast_if_small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else df: the planner then joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
