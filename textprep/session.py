"""Session settings and the two helpers that touch cluster storage or the driver."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# What a session for this library wants beyond Spark's defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files go once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # per-document collect_list meets far more than 128 keys in a task
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


def build_session(
    app: str = "textprep", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The reliable checkpoint folder.

    It is the one the cluster names in ``spark.checkpoint.dir``; only a local session
    without one gets a folder of its own.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="textprep-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Partition by ``key`` over all cores if the frame has fewer partitions than that.

    For stored frames in front of per-row work that outweighs reading them, which would
    leave most cores idle. Later groupings by the key then need no exchange. A frame of
    enough partitions is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def stable(df: DataFrame, key: str | None = None) -> DataFrame:
    """Write the frame once to the shared folder and read it from there.

    Cuts the lineage before a result is used several times, and survives lost
    executors. With ``key`` a small result is spread over the cores (and written again,
    small as it is).
    """
    shared_folder(df.sparkSession)
    kept = df.checkpoint(eager=True)
    if key is None:
        return kept
    wide = spread(kept, key)
    return kept if wide is kept else wide.checkpoint(eager=True)


PINNED_BYTES = 256 << 20


def pin_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hold a small table on the driver and mark it for broadcast.

    At most ``max_rows + 1`` rows are fetched. A table of more rows, or of more than
    :data:`PINNED_BYTES`, is returned as it is, unmarked, so joins with it shuffle instead.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > PINNED_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
