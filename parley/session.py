"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# State that lives in RocksDB spills to disk, so one hot key does not have to
# fit in the heap of an executor.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Files of an exchange go when the query that wrote them has ended, and not once
# the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_local_roots: dict[str, str] = {}


def build_session(app: str = "parley", master: str | None = None, partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the configured checkpoint folder.

    A folder of this machine stands in only where driver and executors are one
    process, as in tests. A cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id", "local")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="parley-")
    return _local_roots[app]


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of few splits enough tasks for costly per-row work.

    Text work on one large row group would run in one task. Scans that already
    have a task per core, as any large table does, are left without a shuffle.
    ``keys`` should identify a row, so that no key can pile up.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` to as many tasks as the session shuffles to.

    Adaptive execution puts partitions together by their bytes as compressed,
    so that of rows that compress well a task gets more than its share of
    memory. A number that was asked for is left as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder."""
    return f"{shared_root(spark)}/parley/{name}-{uuid.uuid4().hex}"


def settle(spark: SparkSession, df: DataFrame, name: str, **options: str) -> DataFrame:
    """Cut lineage by writing ``df`` to the shared folder and reading it back. ``options`` are those of the writer."""
    path = scratch(spark, name)
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)
