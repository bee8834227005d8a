"""Session settings and the few driver-side checks the operators share."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Largest relation handed to broadcast(), in rows. Every broadcast in the
# package is either proven smaller than this or checked against it first.
BROADCAST_ROWS = 200_000


def build_session(master: str | None = None, app: str = "hearthlog", **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            **conf,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _local_folder(master: str) -> str:
    """A folder of this machine, which only a session on this machine alone may use."""
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder the cluster names.

    A folder is made up only when the session names none, as in local tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or _local_folder(sc.master))
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for streaming state and sinks, beside the checkpoint folder."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        import uuid

        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return os.path.join(_local_folder(sc.master), name)


def stored(df: DataFrame, name: str = "rounds") -> DataFrame:
    """A small frame written and read. A checkpoint would keep its constraints, which multiply from round to round in the planner."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df` has at most `rows` rows; reads no more than rows + 1 of them."""
    return df.limit(rows + 1).count() <= rows


SPREAD_BYTES_PER_CORE = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of an input too small to occupy the cores out over them.

    Meant for per-row work that costs more than moving the rows. Inputs with
    enough splits of their own are left alone, so no shuffle is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES_PER_CORE else df


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint when it is checked small, else unchanged.

    Unhinted, the join becomes a shuffle join that AQE may still split on skew.
    """
    return F.broadcast(df) if is_small(df, rows) else df

