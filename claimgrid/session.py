"""Session settings and the shared staging folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Sizes (shuffle partitions, memory) belong to
# the cluster; adaptive execution coalesces and splits around them.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "claimgrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Settings a job needs on whatever session it is given. Generated methods above
# 8000 bytes are never compiled by the JVM, so such stages are better off as
# separate, smaller projections.
JOB_CONF = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Of equal keys in a JSON object the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def entry_tables(spark: SparkSession) -> str:
    """Folder of the tables that the flagship query reads, a setting of the session."""
    return spark.conf.get("claimgrid.entry.tables", "/root/testdata/sf0.001")


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    return spark


_LOCAL_STAGE: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, because there every task sees that disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_STAGE:
        _LOCAL_STAGE[app] = tempfile.mkdtemp(prefix="claimgrid-stage-")
    return _LOCAL_STAGE[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back, if the session names a shared folder.

    Used where several consumers need one expensive result: the table survives
    lost executors, and readers still prune its columns. Without
    ``spark.checkpoint.dir`` nothing is written, and each consumer computes it.
    """
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df
    return written(df, name, "zstd")


# Staged folders with the JVM and the Hadoop settings they were written with.
_WRITTEN: dict[str, tuple] = {}


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table under ``stage_root``, which an operator needs written in any case."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under ``stage_root``; ``release`` deletes what is written there."""
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    return path


def release() -> None:
    """Delete all staged tables and scratch folders of this process, once their consumers have run.

    Called by itself when the process ends; a long-lived service calls it after
    each run.
    """
    for path in list(_WRITTEN):
        jvm, conf = _WRITTEN.pop(path)
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


atexit.register(release)
