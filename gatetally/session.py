"""Session settings the jobs are meant to run with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

SETTINGS = {
    # Small shuffle partitions are merged and uneven ones split while a batch query runs.
    "spark.sql.adaptive.enabled": "true",
    # Lines are counted as they are read, so large splits need no more memory than small ones, and
    # they keep the number of map tasks, and of blocks to shuffle, low.
    "spark.sql.files.maxPartitionBytes": "512m",
    # Report queries of one session share the executors evenly.
    "spark.scheduler.mode": "FAIR",
    # Window state is kept on executor disk, not on the heap, and saved as changes.
    STATE_STORE: (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


# A smaller input is cut into this many splits per core, so that no core waits long for the last.
SPLITS_PER_CORE = 4
MIN_SPLITS = "spark.sql.files.minPartitionNum"


def get_session(
    name: str = "gatetally", settings: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with ``SETTINGS`` and, over them, the given ones.

    Master and resources come from ``spark-submit``. The number of shuffle partitions of a
    streaming query is fixed by its first start, so ``spark.sql.shuffle.partitions`` is to be
    chosen for the cluster before that.
    """
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if spark.conf.get(MIN_SPLITS, None) is None:
        spark.conf.set(MIN_SPLITS, SPLITS_PER_CORE * spark.sparkContext.defaultParallelism)
    return spark
